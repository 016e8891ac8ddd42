"""Packing documents into token sequences of one length: shortest pack first, over the histogram of lengths.

Tokens are cut into pieces where a document is longer than a sequence. Only the histogram of piece lengths (at most one
entry for each length up to the capacity) reaches the driver, which places the lengths, longest first, each into the
packs with the most room, as counts of packing patterns. The patterns then meet the pieces again by rank: the r-th
piece of a length takes the r-th slot of that length.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ranked, small_batches, written
from tidegauge.llm.words import SLICE_BYTES, Words, release, sliced, words_of

CAPACITY = 4096
END_ID = 2
CACHED_WORDS = 300_000  # words whose ids a task keeps before it begins anew; only time depends on it

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# bytes of plain Latin words, which lower-casing and composing leave one for one, and of the punctuation behind them
_LETTER, _SECOND, _MARK = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SECOND[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True  # behind 0xC3: À to ÿ without the two signs
_MARK[list(b".,;:!?")] = True
_SLOW_SALT = np.uint64(0xA24BAED4963EE407)


def _spans(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in one of some spans that do not overlap."""
    steps = np.zeros(n + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8) > 0


class Encoder:
    """The ids of texts as a tokenizer gives them, without special tokens, from each distinct word once.

    For tokenizers that drop white space before the merges and mark word ends, so the ids of a text are those of its words
    between white space in a row. A word of plain letters skips the tokenizer's slow normal form, which would not change it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.full.model)  # one vocabulary for both
        if self._slow(["a b"])[0] != [*self._slow(["a"])[0], *self._slow(["b"])[0]]:
            raise ValueError("the tokenizer keeps white space; words can't be encoded on their own")
        self.suffix = self.plain.model.end_of_word_suffix
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.full.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(self.suffix)]] = True
        self.clear()
        release()  # what reading the file took

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known hashes in order, and where their words are
        self.checks = array("Q")
        self.starts, self.sizes, self.ids = array("q"), array("q"), array("I")

    def _slow(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Keeps ids of new words that lie one behind the other, each up to its end; ``keys`` are in order."""
        sizes = np.diff(ends, prepend=0)
        if len(sizes) != len(keys):
            raise ValueError(f"the tokenizer made {len(sizes)} words of {len(keys)}")
        before = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, before, keys)
        self.places = np.insert(self.places, before, np.arange(len(self.starts), len(self.starts) + len(keys)))
        self.starts.extend((ends - sizes + len(self.ids)).tolist())
        self.sizes.extend(sizes.tolist())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())

    def _learn(self, keys: np.ndarray, checks: np.ndarray, texts: list[bytes], plain: np.ndarray) -> None:
        fast = np.flatnonzero(plain).tolist()
        self.checks.frombytes(np.concatenate([checks[plain], checks[~plain]]).tobytes())
        if fast:
            ids = np.array(self.plain.encode(b" ".join([texts[i] for i in fast]).decode(), add_special_tokens=False).ids)
            self._add(keys[plain], ids, np.flatnonzero(self.last[ids]) + 1)
        rest = np.flatnonzero(~plain).tolist()
        if rest:
            found = self._slow([texts[i].decode() for i in rest])
            self._add(keys[~plain], np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([len(x) for x in found]))

    def _units(self, words: Words) -> tuple[np.ndarray, ...]:
        """Cuts words between white space into units that are encoded on their own.

        A plain word is its letters in lower case and the punctuation behind them, any other word is one unit. Gives hashes, bytes
        (lower case for plain letters), bounds, which units are plain letters, and the units of each word.
        """
        data = words.data
        after_lead = np.zeros(len(data), bool)
        after_lead[1:] = data[:-1] == 0xC3
        second = after_lead & _SECOND[data]
        letter = _LETTER[data] | second
        letter[:-1] |= second[1:]  # the lead of an allowed pair
        mark = _MARK[data]
        bad = ~(letter | mark)
        bad[1:] |= letter[1:] & mark[:-1]  # letters behind punctuation
        bads, letters = (np.concatenate([[0], np.cumsum(x)]) for x in (bad, letter))
        starts, ends = words.starts, words.ends
        plain = (bads[ends] - bads[np.minimum(starts + 1, ends)] == 0) & letter[starts]
        if not self.suffix:
            plain[:] = False
        middle = np.where(plain, starts + letters[ends] - letters[starts], ends)
        lower = data.copy()
        lower[(data >= 0x41) & (data <= 0x5A)] += 32
        lower[second & (data >= 0x80) & (data <= 0x9E)] += 32
        many = 1 + (middle < ends)
        first = np.cumsum(many) - many
        unit_starts, unit_ends = np.empty(many.sum(), np.int64), np.empty(many.sum(), np.int64)
        unit_starts[first], unit_ends[first] = starts, middle
        more = first[many == 2] + 1
        unit_starts[more], unit_ends[more] = middle[many == 2], ends[many == 2]
        letters_only = np.zeros(len(unit_starts), bool)
        letters_only[first] = plain
        # the bytes that are encoded
        encoded = replace(words, data=np.where(_spans(unit_starts[letters_only], unit_ends[letters_only], len(data)), lower, data))
        kind = np.where(letters_only, np.uint64(0), _SLOW_SALT)
        h, check = (encoded.hashes(unit_starts, unit_ends, salt) + kind for salt in (0, 1))
        return h, check, lower, unit_starts, unit_ends, letters_only, many

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column. Words are found by one 64-bit hash and compared by a second one of their bytes; should
        two words share the first, the texts are encoded without what is known of words."""
        words = words_of(column)
        if not len(words.starts):
            yield from (np.zeros(0, np.uint32) for _ in range(len(column)))
            return
        h, check, lower, starts, ends, plain, many = self._units(words)
        keys, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) and len(self.keys) + len(keys) > CACHED_WORDS:
            self.clear()
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
        if len(new):
            raw, small, of = words.data.tobytes(), lower.tobytes(), index[new]
            texts = [
                (small if p else raw)[a:b]
                for a, b, p in zip(starts[of].tolist(), ends[of].tolist(), plain[of].tolist(), strict=True)
            ]
            self._learn(keys[new], check[of], texts, plain[of])
        at = self.places[np.searchsorted(self.keys, keys)][inverse]
        if (np.frombuffer(self.checks, np.uint64)[at] != check).any():
            yield from (np.array(ids, np.uint32) for ids in self._slow([t or "" for t in column.to_pylist()]))
            return
        sizes = np.frombuffer(self.sizes, np.int64)[at]
        upto = np.cumsum(sizes)
        place = np.repeat(np.frombuffer(self.starts, np.int64)[at] - (upto - sizes), sizes) + np.arange(upto[-1])
        ids = np.frombuffer(self.ids, np.uint32)[place]
        units = np.concatenate([[0], np.cumsum(many)])[words.firsts]
        cuts = np.concatenate([[0], upto])[units].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield ids[a:b]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: ``doc_id, start, length, ids_crc32, doc_tokens``.

    A document is its ids and ``end_id``; pieces of full capacity are cut from its start and one is left over. Null text
    is empty and gives one piece of one id; null ids stay; repeated rows give repeated pieces. Other columns are
    not read. ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in sliced(batches, "text", SLICE_BYTES // 2):
            rows = [[] for _ in range(5)]
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(ids_of, encoder.encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    for values, value in zip(
                        rows, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True
                    ):
                        values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often each packing pattern is used, and its runs ``(length, times)``.

    Lengths are placed longest first. Each goes to the packs with the most room, all packs of one pattern at once; new
    packs open only where none has room. The number of patterns depends on the capacity, not on the counts: each step
    moves whole patterns and splits at most one.
    """
    room: list[tuple[int, int, int, tuple | None]] = []
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a sequence of {capacity}")
        while left:
            if room and -room[0][0] >= length:
                space, _, count, runs = heapq.heappop(room)
                space = -space
                used = min(left, count)
                if used < count:
                    order += 1
                    heapq.heappush(room, (-space, order, count - used, runs))
                more = (length, runs[1] + 1, runs[2]) if runs[0] == length else (length, 1, runs)
                order += 1
                heapq.heappush(room, (length - space, order, used, more))
                left -= used
            else:
                fit = capacity // length
                for times, count in ((fit, left // fit), (left % fit, 1)):
                    if times and count:
                        order += 1
                        heapq.heappush(room, (times * length - capacity, order, count, (length, times, None)))
                left = 0
    out = []
    for _, _, count, runs in sorted(room, key=lambda x: x[1]):
        parts = []
        while runs:
            parts.append((runs[0], runs[1]))
            runs = runs[2]
        out.append((count, parts[::-1]))
    return out


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows ``length, first rank, times, first sequence, offset`` sorted by length and rank: which ranks a run takes."""
    rows, taken, sequence = [], {}, 0
    for count, runs in found:
        offset = 0
        for length, times in runs:
            rank = taken.get(length, 0)
            rows.append((length, rank, times, sequence, offset))
            taken[length] = rank + count * times
            offset += length * times
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` (from 0) and ``offset`` to pieces (a written table with ``length``, ``doc_id``, ``start``).

    All rows stay. Of a table without rows nothing is packed. The broadcast slots are bounded by the capacity.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = slots(patterns(histogram, capacity))
    held = cut.sparkSession.sparkContext.broadcast(where)
    columns = [c for c in cut.columns if c not in ("sequence_id", "offset", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        # ranks of one length stay below 2^50, lengths below 2^13
        keys = (rows[:, 0] << 50) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = rows[np.searchsorted(keys, (length << 50) + rank, "right") - 1]
            nth = rank - run[:, 1]
            added = [run[:, 3] + nth // run[:, 2], run[:, 4] + nth % run[:, 2] * length]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(x) for x in added], [*columns, "sequence_id", "offset"]
            )

    order = [c for c in ("doc_id", "start", "doc_tokens", "ids_crc32") if c in columns]
    with_rank = ranked(cut.select(*columns), ["length"], order, sum(histogram.values()))
    schema = cut.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return with_rank.mapInArrow(place, schema)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document of ``docs`` (``doc_id, text``) cut, packed and placed."""
    with small_batches(docs.sparkSession):
        cut = written(pieces(docs, tokenizer_path, capacity), "pieces")
    return pack(cut, capacity)
