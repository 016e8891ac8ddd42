"""Words and shingles of whole Arrow columns in numpy, without a loop over words.

A word is a run of bytes other than space and the five ASCII white-space controls; A-Z count as a-z where asked.
Hashes take in eight bytes at a time and mix all bits after each, so no regular text makes words fall together; the bytes of long words
go through a cryptographic hash. Equal words always agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SLICE_BYTES = 1 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
SHORT_BYTES = 64  # longer words are hashed one by one


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of unsigned 64-bit numbers over all bits; reversible, so nothing new falls together."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offset of each text (one more than texts); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Gives freed memory back to the system: Spark's Python workers live on, and would keep the most that any task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each has about ``limit`` bytes of text, or one row; frees memory before and behind each batch."""
    for batch in batches:
        release()
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
    release()


@dataclass
class Words:
    """The words of some texts: byte bounds in ``data``, and where the words of each text begin (one more than texts)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of the given byte spans; another ``salt`` gives another, independent one."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        sizes = ends - starts
        h = mix(sizes.astype(np.uint64) + np.uint64((salt + 1) * _STEP & (1 << 64) - 1))
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.data, np.zeros(8, np.uint8)]), 8)
        rows = np.flatnonzero((sizes > 0) & (sizes <= SHORT_BYTES))
        done = 0
        while len(rows):
            left = sizes[rows] - done
            part = eight[starts[rows] + done].view("<u8")[:, 0]
            part = part & (np.uint64((1 << 64) - 1) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64))
            h[rows] = mix(h[rows] ^ part) + np.uint64(_STEP)
            done += 8
            rows = rows[left > 8]
        for i in np.flatnonzero(sizes > SHORT_BYTES).tolist():
            digest = blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little"))
            h[i] = int.from_bytes(digest.digest(), "little")
        return h


def words_of(column: pa.Array, lower: bool = False, is_word: np.ndarray = _IS_WORD) -> Words:
    """The words of every text of a column; ``is_word`` says for each byte whether it belongs to words."""
    data, offsets = flat(column)
    if lower:
        data = _LOWER[data]
    inside = is_word[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1], after[:-1] = False, inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``size`` words as sorted hashes; shorter texts give their whole sequence."""
    h, firsts = words.hashes(), words.firsts
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    salt = 1
    for k in range(size):
        salt = (salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) | 1
        part = h[k:] * np.uint64(salt & (1 << 64) - 1)
        rolled[: max(0, n - k)] += part ^ (part >> np.uint64(29))
    rolled = mix(rolled)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= size:
            one = np.sort(rolled[a : b - size + 1])
            keep = np.empty(len(one), bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        elif b > a:
            whole = 0
            for x in h[a:b].tolist():
                whole = (whole * _STEP + x) & (1 << 64) - 1
            out.append(mix(np.array([whole ^ (b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
