"""N-gram join, vector search and archive on small tables against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import jaccard, vectors, warc
from tidegauge.llm.common import bit_set, in_bit_set, ranked


def _sets(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def _components(rows, size, percent):
    nodes = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            nodes.setdefault(doc_id, []).append(_sets(text, size))
    label = {k: k for k in nodes}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    listed = sorted(nodes)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in nodes[a] for y in nodes[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: root(k) for k in nodes}


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_components(spark, documents, size, percent, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy), "s"))
    rows += [(len(rows) + i, t, "s") for i, t in enumerate(["", None, "a", "A", "a b", "a B c d", "a b c d e", "x\ty"])]
    # rows of one id are one node, also where their texts differ
    rows += [(500, rows[0][1], "s"), (500, rows[0][1], "s"), (500, "x y", "s"), (None, rows[0][1], "s"), (None, None, "s")]
    rng.shuffle(rows)
    found = jaccard.linked(documents(rows), size, percent).toPandas()
    expected = _components(rows, size, percent)
    assert len(found) == len(rows)
    named = found[found.doc_id.notna()].astype(int)
    assert {k: v for k, v in zip(named.doc_id, named.component_id, strict=True)} == expected
    assert sorted(zip(named.doc_id, named.n_shingles, strict=True)) == sorted((i, len(_sets(t, size))) for i, t, _ in rows if i is not None)
    nameless = found[found.doc_id.isna()]
    assert nameless.component_id.isna().all() and len(nameless) == 2
    docs = documents(rows)
    kept = jaccard.kept(docs, size, percent)
    assert kept.columns == docs.columns
    assert set(kept.filter("doc_id is not null").toPandas().doc_id) == set(expected.values())


def test_large_buckets_are_joined_block_by_block(spark, documents, monkeypatch):
    # no leaders, all buckets large, blocks of a few documents or n-grams
    for name, value in (("STARS", 0), ("MANY", 1), ("BLOCK", 6), ("BLOCK_NGRAMS", 500)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(7)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(100)] = f"own{i}"
        rows.append((i, " ".join(copy), "s"))
    rows += [(3, rows[9][1] + " end", "s"), (3, rows[3][1], "s"), (70, " ".join(base[:60]), "s"), (71, "other words in this one", "s")]
    found = jaccard.linked(documents(rows)).toPandas()
    expected = _components(rows, jaccard.WORDS, jaccard.PERCENT)
    assert dict(zip(found.doc_id, found.component_id, strict=True)) == expected
    assert len(found) == len(rows) and 2 < len(set(expected.values())) < 60


def test_overlap_by_fragments(monkeypatch):
    rng = np.random.default_rng(3)
    for fragment in (1, 7, 4096):
        monkeypatch.setattr(jaccard, "FRAGMENT", fragment)
        for _ in range(100):
            x = np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64))
            y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 60, 5).astype(np.uint64)]))
            both = len(set(x.tolist()) & set(y.tolist()))
            for percent in (50, 80, 85):
                assert jaccard._alike(x, y, percent) == (100 * both >= percent * (len(x) + len(y) - both))


def test_rows_of_one_id_are_compared_each_on_its_own(spark, documents):
    rows = []

    def text(*blocks):
        return " ".join(f"{name}x{k}" for name, length in blocks for k in range(length))

    for f in range(4):
        for shared in (49, 63, 78):  # 46, 60 and 75 of 100 n-grams: 0.3, 0.43 and 0.6 alike
            own, at = 103 - shared, len(rows) * 10
            one, two, other, partner = (text((f"s{at}", shared), (f"{end}{at}", own)) for end in ("a", "b", "c", "p"))
            # repeated at one end, at both ends, and one id with two texts whose sets have one size
            rows += [(at, one), (at, one), (at + 1, partner)]
            rows += [(at + 2, two), (at + 2, two), (at + 3, other), (at + 3, other)]
            rows += [(at + 4, text((f"s{at}", shared), (f"d{at}", own))), (at + 4, text((f"s{at}", shared), (f"e{at}", own)))]
            # holds all their n-grams, so that none stands in one text only
            rows += [(at + 5, " ".join(t for i, t in rows if at <= i < at + 5))]
    # and one pair that is alike by one of its texts
    near = text(("s", 103))
    rows += [(9000, text(("z", 103))), (9000, near), (9000, near), (9001, near + " more")]
    rows = [(i, t, "s") for i, t in rows]
    found = jaccard.linked(documents(rows)).toPandas()
    assert len(found) == len(rows)
    assert dict(zip(found.doc_id, found.component_id, strict=True)) == _components(rows, jaccard.WORDS, jaccard.PERCENT)
    assert jaccard.kept(documents(rows)).count() == len(rows) - 1


def test_one_row_of_each_group(spark, documents):
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(100 + i, f"{t} end", "t") for i, t in enumerate(base[:10])]
    rows += [(0, base[0], "s")] * 5 + [(3, base[20], "s"), (3, base[3], "other")]  # repeated rows, one id with two texts
    rows += [(None, base[1], "s"), (None, base[29] + " x", None), (None, "of no one else at all", "s"), (None, "of no one else at all", "s")]
    rows += [(200, None, "s"), (200, None, "s"), (201, "", "s"), (None, None, None)]
    rng.shuffle(rows)
    docs = documents(rows).repartition(7)
    out = jaccard.one_of_each(docs, 5, 80)
    assert out.dtypes == docs.dtypes
    found = out.toPandas()
    ids = [None if i != i else int(i) for i in found.doc_id]
    assert sorted((i for i in ids if i is not None)) == sorted([*range(20), *range(21, 30), 3, 200, 200, 201])
    assert sorted(found.text[found.doc_id.isna()].dropna()) == ["of no one else at all"] and ids.count(None) == 2
    assert jaccard.one_of_each(documents([]), 5, 80).count() == 0


def test_words_that_agree_modulo_a_power_of_two_are_no_link(spark, documents, twins):
    found = jaccard.linked(documents([(i, t, "s") for i, t in enumerate([*twins, twins[0], f"a b {twins[0]} c", f"a b {twins[1]} c"])])).toPandas()
    assert dict(zip(found.doc_id, found.component_id, strict=True)) == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_no_documents_no_links(spark, documents):
    assert jaccard.linked(documents([])).count() == 0
    found = jaccard.linked(documents([(1, "a b c d e f", "s"), (2, None, "s")])).toPandas()
    assert dict(zip(found.doc_id, found.component_id, strict=True)) == {1: 1, 2: 2}


def _nearest(rows, k, every):
    whole = []
    for vec_id, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((vec_id, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)))
    out = []
    for i, (query, q) in enumerate(whole):
        if query is None or query % every:
            continue
        others = [(-int(q @ v), vec_id is None, vec_id or 0) for j, (vec_id, v) in enumerate(whole) if j != i and len(v) == len(q)]
        out += [(query, r + 1, None if none else vec_id, -score) for r, (score, none, vec_id) in enumerate(sorted(others)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # equal vectors
    rows += [(20, rows[20][1]), (20, rows[20][1]), (30, rows[3][1]), (None, rows[3][1]), (None, rows[5][1])]
    rows += [(300, None), (310, [1.0, None] * 3), (320, [float("nan")] * 6), (330, [float("inf")] * 6), (340, [1.0, 2.0]), (350, [2.0, 1.0]), (360, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    found = vectors.nearest(df, 7, 10).collect()
    assert sorted([tuple(r) for r in found], key=str) == _nearest([r for r in rows if r[1] != []], 7, 10)
    assert vectors.nearest(df.limit(0), 7, 10).count() == 0


def test_nearest_at_the_end_of_the_range(spark):
    rng = np.random.default_rng(5)
    near = (8.5e5 * rng.choice([-1, 1], (60, 6)) * rng.uniform(0.999, 1, (60, 6))).tolist()  # squares add up to almost 2^62
    rows = [(i, v) for i, v in enumerate(near)] + [(100 + i, rng.normal(size=6).tolist()) for i in range(40)]
    beyond = [(200, [8.7e5] * 6), (210, [1e30] + [0.0] * 5), (220, [-3e38] * 6), (230, [9e6] * 16)]
    df = spark.createDataFrame(rows + beyond, "vec_id long, embedding array<float>")
    found = vectors.nearest(df, 7, 10).collect()
    assert sorted([tuple(r) for r in found], key=str) == _nearest(rows, 7, 10)
    assert vectors.nearest(spark.createDataFrame(beyond, df.schema), 7, 10).count() == 0


PAGES = "page_id long, url string, html string, record_type string"


def test_archive_round_trip(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (9, "u\r\nX: y", "same"), (4, None, None), (5, "v", ""), (6, "w", "ünï\r\n\r\n"), (6, "w", "ünï\r\n\r\n"), (6, "z", "other"), (None, "q", "same"), (None, "q", "alone")]
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES)
    path = warc.archive(df)
    found = warc.read_back(spark, path).toPandas()
    digest = {h or "": base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in rows}
    text = {d: h for h, d in digest.items()}
    assert sorted((str(p), digest[h or ""]) for p, _, h in rows) == sorted((str(None if np.isnan(p) else int(p)), d) for p, d in zip(found.page_id, found.payload_digest, strict=True))
    for d, group in found.groupby("payload_digest"):
        assert (group.payload_bytes == len(text[d].encode())).all()
        response = group[group.record_type == "response"]
        assert len(response) == 1
        largest = max((p for p, _, h in rows if (h or "") == text[d] and p is not None), default=None)
        assert str(response.page_id.iloc[0]) == str(float("nan") if largest is None else float(largest))
        if largest is not None:
            assert (group[group.record_type == "revisit"].refers_to == largest).all()
        assert response.refers_to.isna().all()
    assert spark.read.parquet(f"{path}/payloads").count() == len(digest)
    assert warc.read_back(spark, warc.archive(df.limit(0))).count() == 0


def test_archive_keeps_small_payloads_each(spark):
    df = spark.createDataFrame([(i, "u", t, "x") for i, t in enumerate(["ab", "ab", "abcd", "abcd"])], PAGES)
    found = warc.read_back(spark, warc.archive(df, least_bytes=3)).toPandas().set_index("page_id").record_type
    assert found.to_dict() == {0: "response", 1: "response", 2: "revisit", 3: "response"}


def test_wrong_bytes_are_noticed():
    header = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab"
    block = header.split("\r\n\r\n", 1)[1]
    with pytest.raises(ValueError):
        warc.parsed((header.replace("40", str(len(block))) + "\r\n\r\n").encode())


def _altered(spark, path, folder, payloads, headers):
    for name, change in (("payloads", payloads), ("headers", headers)):
        change(spark.read.parquet(f"{path}/{name}")).write.parquet(f"{folder}/{name}")
    return warc.read_back(spark, str(folder))


def test_digests_of_all_records_are_compared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARE", 2)  # several shares of one payload
    df = spark.createDataFrame([(i, "u", "same", "x") for i in range(9)] + [(20, "u", None, "x"), (21, "u", "", "x")], PAGES)
    path = warc.archive(df)
    bodies = warc.records(spark, path).collect()
    # every revisit gets its payload back
    assert sorted(warc.record(r.header, r.packed)["payload"] for r in bodies) == [b""] * 2 + [b"same"] * 9
    same, zero = F.lit(hashlib.sha256(b"same").digest()), F.lit(bytes(32))
    false_key = F.when(F.col("key") == same, zero).otherwise(F.col("key"))
    other = F.when(F.col("key") == same, F.lit(zlib.compress(b"sane"))).otherwise(F.col("packed"))
    as_is, revisits = (lambda d: d), (lambda d: d.filter("record_type = 'revisit'"))
    cases = {
        "false key": (lambda d: d.withColumn("key", false_key), lambda d: d.withColumn("key", false_key)),
        "false key of revisits": (lambda d: d.withColumn("key", false_key), lambda d: revisits(d).withColumn("key", false_key)),
        "other bytes": (lambda d: d.withColumn("packed", other), revisits),
        "lost payload": (lambda d: d.filter(F.col("key") != same), revisits),
        "lost empty payload": (lambda d: d.filter(F.col("key") == same), as_is),
    }
    assert _altered(spark, path, tmp_path / "same", as_is, as_is).count() == 11
    for name, (payloads, headers) in cases.items():
        with pytest.raises(Exception, match="SHA-256|no payload"):
            _altered(spark, path, tmp_path / name.replace(" ", "-"), payloads, headers).collect()


def test_ranks_have_no_gaps(spark):
    df = spark.createDataFrame([(i % 3 and 1, i) for i in range(500)] + [(2, 7)] * 3, "k long, v long")
    found = ranked(df, ["k"], ["v"], 503).toPandas()
    for _, group in found.groupby("k"):
        assert sorted(group["rank"]) == list(range(len(group)))


def test_bit_sets(spark):
    values = [0, 5, -1, 1 << 40, (1 << 40) + 77, -(1 << 62)]
    bits = bit_set(spark.createDataFrame([(v,) for v in values], "v long"), "v", 20)
    assert in_bit_set(bits, np.array(values)).all() and len(bits) == 1 << 17
    assert not in_bit_set(bits, np.array([1, 6, 1 << 19])).any()


def test_a_bit_set_is_read_in_few_jobs(spark):
    """Its blocks are few; a job for each shuffle partition would cost more than the set."""
    import numpy as np

    from tidegauge.llm import common

    given = np.random.default_rng(3).integers(0, 1 << 40, 3_000)
    values = spark.createDataFrame([(int(v),) for v in given], "v long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("bits", "bits")
    try:
        found = common.bit_set(values, "v", 22)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bits")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert common.in_bit_set(found, given).all() and np.unpackbits(found).sum() == len(set((given & ((1 << 22) - 1)).tolist()))
    assert len(jobs) < 10
