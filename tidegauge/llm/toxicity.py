"""Toxic spans and documents by a linear-chain conditional random field over words.

Words are toxic or clean. Training tokens come from labelled documents: in toxic ones, words whose form or beginning
stands in toxic documents far more often than in clean ones are labelled toxic, all others clean. The field is fitted on a
bounded sample, then every word of every text gets its marginal by forward and backward passes; the marginals of a document
give its score and the spans that offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import small_batches
from tidegauge.llm.words import mix, release, sliced, words_of

SAMPLE_DOCS = 2000  # of each label, those with the least hash of their id
SAMPLE_WORDS = 1500  # longer documents are left out of the fit (never of the scoring)
LEAST_DOCS = 5  # documents of the sample in which a feature must stand to have a weight
PREFIXES = (4, 5, 6)
KINDS = 1 + len(PREFIXES)
LEAST_EVIDENCE = 30.0  # likelihood ratio from which a feature marks toxic tokens
LEAST_RATIO = 30.0  # and how many times more often it stands in toxic documents than in clean ones
STEPS = 60
SEGMENT = 128  # words of a training sequence
FIT_DOCS = 256  # documents of the sample whose words are scored at a time
REST = 10  # of the training sequences without a telling word each such one is fitted, and counts as many times

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def held_out(doc_id: Column) -> Column:
    """Whether a document is for testing only: a fifth, by the checksum of its id."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def features(words) -> np.ndarray:
    """For each word a row of 64-bit feature keys: its form and its first bytes, each kind told apart."""
    out = np.empty((len(words.starts), KINDS), np.uint64)
    for kind in range(KINDS):
        ends = words.ends if not kind else np.minimum(words.ends, words.starts + PREFIXES[kind - 1])
        out[:, kind] = mix(words.hashes(words.starts, ends) + np.uint64(kind))
    return out


@dataclass
class Field:
    """The fitted field: keys of features in order and their weights, a bias, the 2 x 2 moves between clean and toxic, and how scores follow."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    score: np.ndarray


def marginals(emissions: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chances that words are toxic, for sequences in columns sorted by length, longest first.

    ``emissions`` is log odds by (place, sequence). With two states each pass carries one number for a sequence, the odds of
    toxic against clean. Also gives both passes.
    """
    steps, n = emissions.shape
    e = np.exp(np.clip(emissions, -30, 30))
    a = np.exp(moves)
    forward, backward = np.zeros((steps, n)), np.ones((steps, n))
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t
    forward[0] = e[0]
    for t in range(1, steps):
        k = active[t]
        r = forward[t - 1, :k]
        forward[t, :k] = e[t, :k] * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        q = e[t + 1, :k] * backward[t + 1, :k]
        backward[t, :k] = (a[1, 0] + a[1, 1] * q) / (a[0, 0] + a[0, 1] * q)
    odds = forward * backward
    return odds / (1 + odds), forward, backward


def _columns(counts: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Groups of sequences of like length, longest first, so that little of a matrix is empty."""
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    first = 0
    while first < len(order):
        longest = int(counts[order[first]])
        last = first + max(1, int(np.searchsorted(-counts[order[first:]], -(longest // 2), "left")))
        last = min(last, first + max(1, (1 << 19) // longest))
        yield order[first:last], longest
        first = last


def word_marginals(field: Field, emissions: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The chance of each word of each text to be toxic; texts lie one behind the other, from ``firsts``."""
    counts, out = np.diff(firsts), np.zeros(len(emissions))
    for group, longest in _columns(counts):
        sizes = counts[group]
        at = np.arange(longest)[:, None]
        inside = at < sizes
        place = np.where(inside, firsts[group] + at, 0)
        p, _, _ = marginals(emissions[place], field.moves, sizes)
        out[place[inside]] = p[inside]
    return out


def aggregates(p: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each text: one, the log of the squared chances of its words (many doubtful words add little), the largest chance."""
    n = len(firsts) - 1
    out = np.zeros((n, 3))
    out[:, 0] = 1
    full = np.flatnonzero(np.diff(firsts) > 0)
    if len(full):
        out[full, 1] = np.log1p(np.add.reduceat(p**2, firsts[full]))
        out[full, 2] = np.maximum.reduceat(p, firsts[full])
    return out


def emitted(field: Field, of: np.ndarray) -> np.ndarray:
    at = np.searchsorted(field.keys, of)
    at[at == len(field.keys)] = 0
    return np.where(field.keys[at] == of, field.weights[at], 0).sum(1) + field.bias


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, n: float, m: float) -> np.ndarray:
    """How strongly shares a / n and b / m differ (twice the log of the likelihood ratio)."""
    both = (a + b) / (n + m)

    def fit(k, total, share):
        return k * np.log(np.maximum(share, 1e-12)) + (total - k) * np.log(np.maximum(1 - share, 1e-12))

    return 2 * (fit(a, n, a / n) + fit(b, m, b / m) - fit(a, n, both) - fit(b, m, both))


def _telling(docs: list[np.ndarray], toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of features 0 to size - 1: in how many documents each stands, and which tell toxic ones."""
    seen = np.zeros((2, size))
    for of, label in zip(docs, toxic, strict=True):
        seen[int(label), np.unique(of)] += 1
    n, m = toxic.sum(), (~toxic).sum()
    strong = (seen[1] / n > LEAST_RATIO * seen[0] / m) & (_likelihood_ratio(seen[1], seen[0], n, m) > LEAST_EVIDENCE)
    return seen.sum(0), strong


def _without_copies(docs: list[np.ndarray], toxic: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Leaves one of each group of copies, so that the words of a text that was copied don't count again and again.

    Texts are taken for copies if they agree in the least key of their three-word runs, under any of four orders.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, of in enumerate(docs):
        words = of[:, 0]
        runs = mix(words[:-2] + mix(words[1:-1] + mix(words[2:]))) if len(words) > 2 else words
        least = {(k, int(mix(runs + np.uint64(k)).min())) for k in range(4)}
        if not least & seen:
            kept.append(i)
        seen |= least
    return [docs[i] for i in kept], toxic[kept]


def fit(docs: list[np.ndarray], toxic: np.ndarray, prior: float) -> Field:
    """The field from feature rows of labelled documents; ``prior`` is the share of toxic ones among all labelled."""
    docs, toxic = _without_copies(docs, toxic)
    if not len(docs) or toxic.all() or not toxic.any():
        # without both labels nothing can be told apart: every score is the share of toxic ones
        sure = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Field(np.zeros(1, np.uint64), np.zeros(1), -10.0, np.zeros((2, 2)), np.array([sure, 0.0, 0.0]))
    # what a step needs is gone before the next begins, and texts go one by one: arrays of all words would fill the driver
    field = _weighed(docs, toxic)
    release()
    parts = []
    for first in range(0, len(docs), FIT_DOCS):
        some = docs[first : first + FIT_DOCS]
        firsts = np.concatenate([[0], np.cumsum([len(x) for x in some])])
        parts.append(aggregates(word_marginals(field, np.concatenate([emitted(field, x) for x in some]), firsts), firsts))
    field.score = _logistic(np.concatenate(parts), toxic.astype(float))
    share = toxic.mean()
    field.score[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return field


def _segments(docs: list[np.ndarray], toxic: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of ``keys`` the used ones; then the training sequences, longest first, by number of key, which of their words are toxic, and for how many each stands."""
    local = [np.searchsorted(keys, x).astype(np.int32) for x in docs]
    stands, strong = _telling(local, toxic, len(keys))
    # of the segments without a telling word each REST-th stands for REST of them
    nr, telling, rest, kept = -1, set(), [], {}
    for of, label in zip(local, toxic, strict=True):
        tells = strong[of].any(1)
        for nr, first in enumerate(range(0, len(of), SEGMENT), nr + 1):
            if tells[first : first + SEGMENT].any():
                telling.add(nr)
            else:
                rest.append(nr)
            if nr in telling or len(rest) % REST == 1:
                kept[nr] = of[first : first + SEGMENT].copy(), tells[first : first + SEGMENT] & label
    chosen = sorted([*telling, *rest[::REST]], key=lambda i: -len(kept[i][1]))
    stands_for = np.array([1.0 if i in telling else REST for i in chosen])
    return np.flatnonzero(stands >= LEAST_DOCS), [kept[i][0] for i in chosen], [kept[i][1] for i in chosen], stands_for


def _weighed(docs: list[np.ndarray], toxic: np.ndarray) -> Field:
    """The field without the weights of its score."""
    keys = np.unique(np.concatenate([np.unique(x) for x in docs]))
    used, pieces, labels, stands_for = _segments(docs, toxic, keys)
    to_used = np.full(len(keys), len(used))
    to_used[used] = np.arange(len(used))  # the rest share a place whose weight stays 0
    lengths = np.array([len(x) for x in pieces])
    steps = int(lengths[0])
    inside = np.arange(steps)[:, None] < lengths
    of = np.zeros((steps, len(pieces), KINDS), np.int32)
    y = np.zeros((steps, len(pieces)))
    for k, (piece, label) in enumerate(zip(pieces, labels, strict=True)):
        of[: lengths[k], k], y[: lengths[k], k] = piece, label
    where = to_used.astype(np.int32)[of[inside]]
    del of, pieces, labels
    release()
    w, bias, moves = np.zeros(len(used) + 1), -3.0, np.zeros((2, 2))
    squares, bias_square, move_squares = np.full(len(used) + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    times = np.broadcast_to(stands_for, inside.shape)
    n, follows, following = times[inside].sum(), inside[1:], times[1:][inside[1:]]
    pairs = [[(((y[:-1] == i) & (y[1:] == j))[follows] * following).sum() for j in (0, 1)] for i in (0, 1)]
    emissions = np.zeros((steps, len(lengths)))
    for _ in range(STEPS):
        emissions[inside] = w[where].sum(1) + bias
        p, forward, backward = marginals(emissions, moves, lengths)
        lack = (y - p)[inside] * times[inside]
        gradient = np.bincount(where.ravel(), np.repeat(lack, KINDS), len(used) + 1) - 0.05 * w
        a, q = np.exp(moves), np.exp(np.clip(emissions[1:], -30, 30)) * backward[1:]
        forward = forward[:-1]
        joint = {(0, 0): lambda: a[0, 0] + 0 * q, (0, 1): lambda: a[0, 1] * q, (1, 0): lambda: a[1, 0] * forward, (1, 1): lambda: a[1, 1] * forward * q}
        whole = joint[0, 0]()
        for k in ((0, 1), (1, 0), (1, 1)):
            whole += joint[k]()
        expected = [[((joint[i, j]() / whole)[follows] * following).sum() for j in (0, 1)] for i in (0, 1)]
        bias_step = lack.sum() / n
        move_step = (np.array(pairs) - np.array(expected)) / n - 1e-4 * moves
        squares += gradient**2
        bias_square += bias_step**2
        move_squares += move_step**2
        w += 0.5 * gradient / np.sqrt(squares)
        w[-1] = 0
        bias += 0.1 * bias_step / np.sqrt(bias_square)
        moves += 0.1 * move_step / np.sqrt(move_squares)
    return Field(keys[used] if len(used) else np.zeros(1, np.uint64), w[: max(1, len(used))], float(bias), moves, np.zeros(3))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, slightly drawn to 0, by Newton steps."""
    w, hold = np.zeros(x.shape[1]), np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + hold @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Feature rows and labels of the sample, and the share of toxic rows among all labelled training rows."""
    marked = (
        labels.filter("toxic in (0, 1) and doc_id is not null")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros(0, bool), 0.0
    prior = counts.get(1, 0) / sum(counts.values())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [marked.filter(F.col("toxic") == k).orderBy(*order).limit(SAMPLE_DOCS) for k in (0, 1)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = words_of(batch.column("text"), True, _LETTERS)
            of = features(words)
            rows = [
                of[a:b].tobytes() if b - a <= SAMPLE_WORDS else None
                for a, b in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary())], ["doc_id", "toxic", "of"]
            )

    # at most 2 * SAMPLE_DOCS rows are broadcast, and as many (of SAMPLE_WORDS words) come back
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    with small_batches(docs.sparkSession):
        found = (
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(few.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
            .select("doc_id", "toxic", "text")
            .mapInArrow(read, "doc_id long, toxic int, of binary")
            .filter("length(of) > 0")
            .groupBy("doc_id", "toxic")
            .agg(F.max("of").alias("of"))  # of different texts under one id always the same
            .toArrow()
            .sort_by("doc_id")
        )
    rows = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, KINDS) for x in found["of"]]
    return rows, np.array(found["toxic"].to_pylist(), bool), prior


def trained(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits the field on labelled rows outside the held-out fifth."""
    field = fit(*_sample(docs, labels))
    release()  # the driver lives on, and would keep what the fit took
    return field


SCORED = "doc_id long, score double, predicted int, spans string"


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, score, predicted, spans`` for every row of ``docs`` (``doc_id, text``).

    ``spans`` lists start:end, in code points, of stretches of words more likely toxic than clean. Null and empty texts have
    the score of a text without toxic words. Null ids and repeated rows stay rows of their own; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(astuple(field))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*held.value)
        for batch in sliced(batches, "text"):
            words = words_of(batch.column("text"), True, _LETTERS)
            chance, p = _chances(model, words)
            spans = [""] * batch.num_rows
            hits = np.flatnonzero(p >= 0.5)
            for row in np.unique(np.searchsorted(words.firsts, hits, "right") - 1).tolist():
                spans[row] = _spans(words, p, row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(chance), pa.array((chance >= 0.5).astype(np.int32)), pa.array(spans, pa.string())],
                ["doc_id", "score", "predicted", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCORED)


def without_toxic(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs``, with all columns, that aren't predicted toxic. Null and empty texts stay."""
    held = docs.sparkSession.sparkContext.broadcast(astuple(field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*held.value)
        for batch in sliced(batches, "text"):
            yield batch.filter(pa.array(_chances(model, words_of(batch.column("text"), True, _LETTERS))[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def _chances(model: Field, words) -> tuple[np.ndarray, np.ndarray]:
    """The score of each text and the chance of each of its words."""
    p = word_marginals(model, emitted(model, features(words)), words.firsts)
    return 1 / (1 + np.exp(-np.clip(aggregates(p, words.firsts) @ model.score, -30, 30))), p


def _spans(words, p: np.ndarray, row: int) -> str:
    """The toxic stretches of one text: neighbouring toxic words are one."""
    a, b = words.firsts[row], words.firsts[row + 1]
    begin, end = words.offsets[row], words.offsets[row + 1]
    points = np.concatenate([[0], np.cumsum((words.data[begin:end] & 0xC0) != 0x80)])
    bad = np.concatenate([[False], p[a:b] >= 0.5, [False]])
    edges = np.flatnonzero(bad[1:] != bad[:-1]).reshape(-1, 2)
    starts, ends = words.starts[a + edges[:, 0]] - begin, words.ends[a + edges[:, 1] - 1] - begin
    return ",".join(f"{s}:{e}" for s, e in zip(points[starts].tolist(), points[ends].tolist(), strict=True))
