"""Packing and mixing: whole results, odd rows, small brute-force forms."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import mixing, packing, words

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (1, "Hello, world. It's 12 o'clock <|endoftext|> now", "a"),
    (2, None, "b"),
    (3, "", None),
    (4, "word " * 5000, "a"),
    (4, "word " * 5000, "a"),
    (None, "É É caña x\u0085y über.Straße", "a"),
    (5, "x" * 3000, "b"),
    (6, "\t \n", "c"),
]


def test_every_id_lies_in_one_piece(spark, documents):
    found = packing.packed(documents(TEXTS), PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text, _ in TEXTS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 4096):
            part = ids[start : start + 4096]
            expected.append((-1 if doc_id is None else doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
    got = found[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].fillna(-1).astype(int)
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(expected)
    for _, pieces in found.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]]
        assert pieces.length.sum() <= 4096
    assert sorted(found.sequence_id.unique()) == list(range(found.sequence_id.nunique()))


def test_words_that_agree_modulo_a_power_of_two_have_their_own_ids(spark, documents, twins):
    tokenizer = Tokenizer.from_file(PATH)
    found = packing.packed(documents([(i, t, "a") for i, t in enumerate(twins)]), PATH).toPandas().set_index("doc_id")
    for i, text in enumerate(twins):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert found.ids_crc32[i] == zlib.crc32(ids.tobytes())


def test_words_that_share_a_hash_are_encoded_on_their_own(monkeypatch):
    texts = ["one two three", "One, two. Ünï 12", None, "x" * 500]
    expected = [x.ids for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    true = words.Words.hashes
    monkeypatch.setattr(words.Words, "hashes", lambda self, a=None, b=None, salt=0: true(self, a, b, salt) % np.uint64(3 if salt == 0 else 1 << 63))
    got = [ids.tolist() for ids in packing.Encoder(PATH).encode(pa.array(texts))]
    assert got == expected


def test_hashes_of_words_and_spans():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(3000)] + ["a" * n for n in range(140)]
    found = words.words_of(pa.array(texts))
    by_word = {}
    for start, end, h in zip(found.starts, found.ends, found.hashes(), strict=True):
        by_word.setdefault(found.data[start:end].tobytes(), set()).add(int(h))
    assert all(len(h) == 1 for h in by_word.values())
    assert len(set.union(*by_word.values())) == len(by_word)
    # the same bytes have the same hash wherever they lie
    moved = words.words_of(pa.array(["zz " + t for t in texts if t]))
    assert set(moved.hashes().tolist()) - set.union(*by_word.values()) == {int(words.words_of(pa.array(["zz"])).hashes()[0])}
    assert not set(found.hashes(salt=1).tolist()) & set.union(*by_word.values())


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_all_lengths(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(30)} | {1: 10**12}
    found = packing.patterns(histogram, 64)
    held: dict[int, int] = {}
    for count, runs in found:
        assert sum(length * times for length, times in runs) <= 64
        for length, times in runs:
            held[length] = held.get(length, 0) + count * times
    assert held == histogram


def test_shortest_pack_takes_the_next_length():
    # 7 opens a pack, 5 another; 4 goes to the emptier one, then 2 to the one left with more room
    assert packing.patterns({7: 1, 5: 1, 4: 1, 2: 1}, 10) == [(1, [(5, 1), (4, 1)]), (1, [(7, 1), (2, 1)])]


def test_a_length_over_the_capacity_is_an_error():
    with pytest.raises(ValueError):
        packing.patterns({65: 1}, 64)


def test_padding_is_small(spark):
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.minimum(rng.lognormal(6, 1, 50_000).astype(int) + 1, 4096), return_counts=True)
    found = packing.patterns(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    assert sum(n for n, _ in found) * 4096 < 1.01 * (lengths * counts).sum()


def test_nothing_to_pack(spark, documents):
    assert packing.packed(documents([]), PATH).count() == 0


def _targets(sizes, weights, cap):
    """Shares out step by step: who would pass the cap stops there, the rest share what is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = float(sum(sizes.values())), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= full


def test_sources_come_near_their_targets(spark, documents):
    rng = random.Random(3)
    rows = [
        (i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(1500)
    ] + [(9000, "one two", "tiny"), (9001, None, "a"), (None, "w w", "b"), (7, "w w w", "b"), (7, "w w w", "b")]
    found = mixing.mixed(documents(rows)).toPandas()
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    expected = _targets(sizes, mixing.WEIGHTS, mixing.CAP)
    assert len(found) == len(rows)
    assert (found.taken <= 3 * found["size"]).all() and (found.taken % found["size"].where(found["size"] > 0, 1) == 0).all()
    goal = {sizes[s]: t for s, t in expected.items()}  # sizes differ here
    assert len(goal) == len(sizes) and set(found.source_size) == set(goal)
    for size, part in found.groupby("source_size"):
        assert np.allclose(part.target, goal[size]) and abs(part.taken.sum() - goal[size]) <= 60
    assert np.isclose(sum(expected.values()), sum(sizes.values()))
    again = mixing.mixed(documents(rows)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert found[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_rounding_is_carried_in_words(spark, documents):
    rng = random.Random(4)
    # a few long documents and many short ones
    rows = [(i, " ".join(["w"] * (rng.randint(200, 900) if i % 9 == 0 else rng.randint(1, 8))), "abc"[i % 3]) for i in range(600)]
    found = mixing.mixed(documents(rows)).toPandas()
    for _, part in found.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 8  # a short one at most


def test_rates_grow_or_fall_with_size(spark, documents):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "a" if i % 2 else "b") for i in range(2000)]
    found = mixing.mixed(documents(rows)).toPandas()
    found["rate"] = found.taken / found["size"]
    for target, part in found.groupby("target"):
        slope = np.polyfit(part["size"], part.rate, 1)[0]
        assert slope > 0 if target > part.source_size.iloc[0] else slope < 0


def test_no_documents_no_mix(spark, documents):
    assert mixing.mixed(documents([])).count() == 0
    assert mixing.mixed(documents([(1, None, "a"), (2, " ", None)])).toPandas().taken.tolist() == [0, 0]


def test_repeated_rows_keep_their_columns(spark, documents):
    docs = documents([(i, "a b c", "s" if i % 2 else "t") for i in range(40)])
    taken = mixing.mixed(docs).toPandas().set_index("doc_id").copies
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert out.toPandas().groupby("doc_id").size().to_dict() == taken[taken > 0].to_dict()


def test_copies_belong_to_rows(spark, documents):
    rows = [(None, f"n{i} b c", "s") for i in range(20)] + [(5, "two texts of", "t"), (5, "one id here", "t"), (6, "x y z", None)]
    rows += [(7, "a b c", "s")] * 30 + [(None, None, "s"), (8, " ", "s")]
    docs = documents(rows)
    found = mixing.mixed(docs)
    out = mixing.repeated(docs).toPandas()
    assert len(out) == found.agg({"copies": "sum"}).first()[0]
    by_id = found.toPandas().groupby("doc_id").copies.sum()
    assert out.groupby("doc_id").size().to_dict() == by_id[by_id > 0].to_dict()
    assert out.doc_id.isna().any() and not out.text.isna().any()


def test_no_convergence_is_an_error(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "a" if i % 2 else "b") for i in range(200)]
    with pytest.raises(RuntimeError):
        mixing.mixed(documents(rows))
