"""Clustering, hard negatives and fingerprints on small tables against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidegauge.llm import centroids, fingerprints, negatives

VECTORS = "vec_id long, embedding array<float>, label int, row string, cluster string, v int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in rows], VECTORS)


def _whole(v, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


def _lloyd(rows, k, rounds, dims, scale):
    kept = [(i, _whole(v, scale)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 1e5 for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    out = []
    for i, d, j in found:
        digest = hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()
        out.append((i, j, d, sum(x for _, x, o in found if o == j), sum(x for _, x, _ in found), digest))
    return sorted(out, key=str)


ODD = [(301, None, 1), (302, [1.0, None] * 4, 1), (303, [float("nan")] * 8, 1), (304, [float("inf")] * 8, 1), (305, [1e30] * 8, 2), (306, [], 1), (307, [1.0, 2.0], 3)]


@pytest.mark.parametrize(("seed", "k", "blocks"), [(1, 5, 3), (2, 8, 1), (3, 40, 8)])
def test_clusters(spark, seed, k, blocks):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).round(2).tolist(), 0) for i in range(200)]
    rows += [(500 + i, rows[3][1], 0) for i in range(60)] + [(7, rows[7][1], 0), (7, rows[8][1], 0), (None, rows[9][1], 0)] + ODD
    found = centroids.clustered(_table(spark, rows), k, 6, 8, 1024, blocks=blocks)
    assert sorted([tuple(r) for r in found.collect()], key=str) == _lloyd(rows, k, 6, 8, 1024)


def test_clusters_of_few_rows(spark):
    rows = [(1, [0.5] * 8, 0), (2, [0.5] * 8, 0), (None, [1.0] * 8, 0)]
    found = centroids.clustered(_table(spark, rows), 8, 3, 8).collect()
    assert sorted([tuple(r) for r in found], key=str) == _lloyd(rows, 8, 3, 8, 1024)
    assert centroids.clustered(_table(spark, rows[:0])).count() == 0
    assert centroids.clustered(_table(spark, ODD), dims=8).count() == 0


def test_clusters_at_the_end_of_the_range(spark):
    limit = int((2**63 - 1) // 32) ** 0.5 / 1024
    rows = [(i, [s * limit * 0.99 for s in signs], 0) for i, signs in enumerate([[1] * 8, [-1] * 8, [1] * 8])] + [(9, [limit * 1.01] * 8, 0)]
    found = {r["vec_id"]: r for r in centroids.clustered(_table(spark, rows), 1, 1, 8).collect()}
    assert set(found) == {0, 1, 2}
    center = sum(_whole(rows[i][1], 1024)[0] for i in range(3)) // 3
    assert found[1]["distance"] == 8 * (_whole(rows[1][1], 1024)[0] - center) ** 2
    total = sum(r["distance"] for r in found.values())
    assert found[1]["inertia"] == (total if total < 2**63 else None)


def test_many_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(2).tolist(), 0) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = centroids.clustered(_table(spark, rows).repartition(5), 4, 3, 8)
        assert sorted([tuple(r) for r in found.collect()], key=str) == _lloyd(rows, 4, 3, 8, 1024)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _mined(rows, positives, count, low, high, every):
    kept = []
    for vec_id, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) or abs(x) > 1e6 for x in v):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, _whole(v, 256)))
    out = []
    for i, (anchor, label, v) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c is None, c or 0, o == label) for j, (c, o, w) in enumerate(kept) if j != i and len(w) == len(v))
        for bar, none, positive, _ in [s for s in scored if s[3]][:positives]:
            hard = [s for s in scored if not s[3] and low * -bar <= 100 * -s[0] <= high * -bar][:count]
            out += [(anchor, None if none else positive, r + 1, None if s[1] else s[2], -bar, -s[0]) for r, s in enumerate(hard)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "scale"), [(1, 1.0), (2, 300.0), (3, 1000000.0)])
def test_hard_negatives(spark, seed, scale):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=6) * 0.3 + 0.3).clip(-1, 1).round(2).tolist(), int(rng.integers(0, 4))) for i in range(160)]
    rows += [(200 + i, rows[3][1], i % 2) for i in range(50)]  # equal vectors
    rows += [(20, rows[20][1], 1), (20, rows[20][1], 1), (None, rows[3][1], 1), (None, rows[5][1], 2), (40, rows[5][1], None), (60, [-0.5] * 6, 3)]
    rows = [(i, [x * scale for x in v], label) for i, v, label in rows]
    rows += [*ODD, (310, [1.0, 2.0], 2), (320, [2.0, 1.0], 3), (330, [], 5), (340, [], 6)]
    found = negatives.mined(_table(spark, rows), 4, 7, 30, 90, 10).collect()
    assert sorted([tuple(r) for r in found], key=str) == _mined(rows, 4, 7, 30, 90, 10)


def test_no_negatives_without_rows(spark):
    assert negatives.mined(_table(spark, [])).count() == 0
    assert negatives.mined(_table(spark, [(100, [1.0] * 8, 1)])).count() == 0


@pytest.mark.parametrize("top", [1, 1 << 14, 1 << 28, (1 << 30) - 1])
def test_packed_products_are_exact(top):
    rng = np.random.default_rng(top)
    values = rng.integers(-top, top + 1, (37, 4))
    values[0], values[1] = top, -top
    pack = negatives.Pack(values)
    for anchor in ([top] * 4, [-top] * 4, [0] * 4, rng.integers(-top, top + 1, 4).tolist()):
        bias = -min(0, *anchor)
        found = pack.scores(anchor, sum(anchor), bias, max(0, *anchor) + bias)
        assert found.tolist() == [sum(a * int(b) for a, b in zip(anchor, row, strict=True)) for row in values]


def _counts(data):
    padded = data + b"\xff" * 4
    counts = [0] * fingerprints.BUCKETS
    for i in range(len(data)):
        for places, (j, k) in zip(fingerprints._PLACES, fingerprints._TRIPLETS, strict=True):
            a, b, c = (int(t[x]) for t, x in zip(fingerprints._TABLES, (padded[i], padded[i + j], padded[i + k]), strict=True))
            counts[int(places[a ^ b ^ c])] += 1
    return counts


def _quarters(data):
    counts = _counts(data)
    q = sorted(counts)
    return [sum(c > q[fingerprints.BUCKETS * n // 4 - 1] for n in (1, 2, 3)) for c in counts]


def _read(fingerprint):
    body = bytes.fromhex(fingerprint)
    return body[:3], [b >> s & 3 for b in body[3:] for s in (6, 4, 2, 0)]


@pytest.mark.parametrize("size", [0, 1, 4, 5, 300, 70_000])
def test_digest(size):
    data = random.Random(size).choice(["abc ünd ", "the cat "]).encode() * (size // 8) + b"x" * (size % 8)
    assert fingerprints.bucket_counts(data).tolist() == _counts(data)
    head, quarters = _read(fingerprints.digest(data))
    assert quarters == _quarters(data)
    assert head[1] == fingerprints.length_code(len(data)) and fingerprints.likeness(fingerprints.digest(data), fingerprints.digest(data)) == 1


def test_difference():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (rng.randbytes(3 + fingerprints.BUCKETS // 4).hex() for _ in range(2))
        (x, p), (y, q) = _read(a), _read(b)
        apart = sum([0, 1, 2, 6][abs(i - j)] for i, j in zip(p, q, strict=True)) + (x[0] != y[0]) + 2 * min(16, abs(x[1] - y[1]))
        apart += 2 * abs(x[2] // 16 - y[2] // 16) + 2 * abs(x[2] % 16 - y[2] % 16)
        assert fingerprints.difference(a, b) == fingerprints.difference(b, a) == min(fingerprints.BOUND, apart)
        assert 0 <= fingerprints.likeness(a, b) <= 1
    assert [fingerprints.length_code(n) for n in (0, 1, 2, 3, 8, 9)] == [0, 8, 16, 20, 32, 33]
    codes = [fingerprints.length_code(n) for n in range(1, 5000)]
    assert codes == sorted(codes)


def _expected(rows):
    listed = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, (doc_id, text, _) in enumerate(listed):
        text, other = text or "", listed[(i + 1) % len(listed)][1] or ""
        new = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        own, of_new, of_next = (fingerprints.digest(t.encode()) for t in (text, new, other))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, of_new, fingerprints.likeness(own, of_new), fingerprints.likeness(own, of_next)))
    return sorted(out, key=str)


def test_fingerprints(spark, documents):
    rng = random.Random(3)
    words = ["ünï", "cat", "the", "🙂", "mat", "of", "\n"]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200))), "s") for i in range(80)]
    rows += [(1, "", "s"), (2, None, "s"), (4, "a", "s"), (5, "ab", "s"), (9000, "long text " * 250_000, "s"), (None, "none", "s")]
    rows += [(7000, "twice the same", "s")] * 5
    rng.shuffle(rows)
    for shuffled in (documents(rows).repartition(7), documents(rows[:1]), documents([(None, None, "s")])):
        held = [(r["doc_id"], r["text"], "s") for r in shuffled.collect()]
        found = fingerprints.fingerprinted(shuffled)
        assert sorted([tuple(r) for r in found.collect()], key=str) == _expected(held)
    assert fingerprints.fingerprinted(documents([])).count() == 0


def test_fingerprints_over_many_ranges(spark, documents):
    rows = [(i, f"text {i} " * (i % 7), "s") for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "90")
    try:
        found = fingerprints.fingerprinted(documents(rows))
        assert sorted([tuple(r) for r in found.collect()], key=str) == _expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_have_equal_fingerprints_and_halves_are_near():
    a, b = ("".join(random.Random(s).choices("etaoin shrdlu", k=4000)).encode() for s in (1, 2))
    own = fingerprints.digest(a)
    assert own == fingerprints.digest(bytes(a))
    assert fingerprints.likeness(own, fingerprints.digest(a[:2000] + b[:2000])) > fingerprints.likeness(own, fingerprints.digest(b))
