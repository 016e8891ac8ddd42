"""Documents whose sets of n-grams are alike: candidates from prefixes of one global order of n-grams, overlaps summed over fragments.

The order: n-grams of one text come first and those of many texts last, by counts over all texts. Two alike sets share an n-gram among the first few
of each (the prefix), so only documents of one such bucket are compared. Equal sets are one node. A pair is checked by
fragments, ranges of the n-gram hash: each gives a partial overlap, and the sum per pair decides. Documents of a bucket first meet leaders
only, in a few rounds. All members meet only where the rounds left components apart: in small buckets as pairs, in large ones
block by block, where whole sets are compared at once and only links that join two components leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import bit_set, in_bit_set, small_batches, written
from tidegauge.llm.words import mix, shingle_sets, sliced, words_of

WORDS = 4
PERCENT = 85
MANY = 32  # an n-gram in more texts stands last in the order
BITS = 26  # log of the bits in a set of documents that goes to every task
MOST_BITS = 30  # the same for sets of n-grams, which have a bit for every two n-grams up to this bound
HELD = 1 << 21  # n-grams that a task counts at a time
FRAGMENT = 4096  # n-grams of the largest set in a fragment of the order, about
BLOCK = 512  # documents of a bucket that meet another such block in one task, about
BLOCK_NGRAMS = 1 << 19  # n-grams of such a block, about
STARS = 3  # rounds in which documents of a bucket meet leaders only
TRIES = 8  # leaders of a document from large buckets in one round


def _sets(
    docs: DataFrame, size: int, rows: Callable[[list, list[np.ndarray]], dict[str, pa.Array]], schema: str, only: np.ndarray | None = None,
    then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, after: str = "",
) -> DataFrame:
    """Runs ``rows`` over ids and n-gram sets of the documents with an id; ``only`` is a bit set of ids to look at.

    ``then`` goes on with what a task found, into rows of the schema ``after``.
    """
    held = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            if held is not None:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(in_bit_set(held.value, ids)))
                if not batch.num_rows:
                    continue
            sets = shingle_sets(words_of(batch.column("text"), lower=True), size)
            found = rows(batch.column("doc_id").to_pylist(), sets)
            yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        (lambda batches: then(run(batches))) if then else run, after if then else schema
    )


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if len(values) else np.zeros(0, np.int64))


def _signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit signature of each set."""
    sums = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
    mixed = np.array([np.bitwise_xor.reduce(mix(x + np.uint64(1))) if len(x) else 0 for x in sets], np.uint64)
    return sums, mixed


def signatures(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``doc_id, n, s1, s2``: size and 128-bit signature of each document's set."""

    def rows(ids: list, sets: list[np.ndarray]) -> dict[str, pa.Array]:
        s1, s2 = _signature(sets)
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "n": pa.array([len(x) for x in sets], pa.int64()),
            "s1": _signed(s1),
            "s2": _signed(s2),
        }

    return _sets(docs, size, rows, "doc_id long, n long, s1 long, s2 long")


def _identity(tokens: np.ndarray, fragment_bits: int) -> np.ndarray:
    """The leading bits by which n-grams are counted: 32 and those that name the fragment."""
    return tokens >> np.uint64(32 - fragment_bits)


def token_classes(docs: DataFrame, size: int, only: np.ndarray, fragment_bits: int) -> DataFrame:
    """``token, many`` for the leading bits of n-grams in two texts or more; ``many``: in more than MANY.

    Every task counts its own n-grams first and sends them by fragment of the order, packed; a fragment then meets
    about 2^20 of them, a frequent n-gram once for each task.
    """

    def count(tokens: np.ndarray) -> pa.RecordBatch:
        found, times = np.unique(_identity(tokens, fragment_bits), return_counts=True)
        fragments = (found >> np.uint64(32)).astype(np.int64)
        low = found.astype(np.uint32)
        rows = []
        for fragment, begin in zip(*np.unique(fragments, return_index=True), strict=True):
            end = np.searchsorted(fragments, fragment, "right")
            one = times[begin:end] == 1
            part, often = low[begin:end], times[begin:end][~one].astype(np.uint32)
            rows.append((int(fragment), part[one].tobytes(), part[~one].tobytes(), often.tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], ["fragment", "once", "often", "times"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            tokens = np.frombuffer(batch.column("tokens")[0].as_py(), np.uint64)
            held.append(tokens)
            many += len(tokens)
            if many > HELD:
                yield count(np.concatenate(held))
                held, many = [], 0
        if many:
            yield count(np.concatenate(held))

    def tally(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, times = [], []
        for batch in groups:
            for once, often, n in zip(*(batch.column(c).to_pylist() for c in ("once", "often", "times")), strict=True):
                one, more = np.frombuffer(once, np.uint32), np.frombuffer(often, np.uint32)
                low += [one, more]
                times += [np.ones(len(one), np.int64), np.frombuffer(n, np.uint32).astype(np.int64)]
        found, where = np.unique(np.concatenate(low), return_inverse=True)
        texts = np.bincount(where, np.concatenate(times))
        shared = np.flatnonzero(texts > 1)
        token = (key[0].as_py() << 32) + found[shared].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(texts[shared] > MANY)], ["token", "many"])

    def all_tokens(ids: list, sets: list[np.ndarray]) -> dict[str, pa.Array]:
        return {"tokens": pa.array([np.concatenate(sets).tobytes()], pa.binary())}

    packed = _sets(docs, size, all_tokens, "tokens binary", only, rows, "fragment long, once binary, often binary, times binary")
    return packed.groupBy("fragment").applyInArrow(tally, "token long, many boolean")


def prefixes(docs: DataFrame, size: int, percent: int, only: np.ndarray, total: int) -> DataFrame:
    """``token, doc, n, first``: the n-grams of each prefix that may stand in another text, and how long the prefix is.

    The order of n-grams: those in one text, those in a few, those in many, each by hash. ``total`` counts all n-grams of all texts.
    """
    fragment_bits = min(24, max(4, (total >> 20).bit_length()))
    bits = min(MOST_BITS, max(20, (total >> 1).bit_length()))
    classes = written(token_classes(docs, size, only, fragment_bits), "ngram-classes")
    # bit sets of bounded size: n-grams that share a bit by chance only come later in the order, for all texts alike
    held = docs.sparkSession.sparkContext.broadcast(
        (bit_set(classes, "token", bits), bit_set(classes.filter("many"), "token", bits))
    )

    def rows(ids: list, sets: list[np.ndarray]) -> dict[str, pa.Array]:
        shared, many = held.value
        lengths = np.array([len(x) for x in sets])
        tokens = np.concatenate(sets)
        identity = _identity(tokens, fragment_bits)
        meets = in_bit_set(shared, identity)
        late = meets.astype(np.int8) + in_bit_set(many, identity)
        ends = np.cumsum(lengths)
        out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        takes = lengths - (percent * lengths + 99) // 100 + 1
        alone = np.concatenate([[0], np.cumsum(~meets)])
        for i, (a, b, take) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), takes.tolist(), strict=True)):
            if alone[b] - alone[a] >= take:
                continue  # the whole prefix stands in no other text
            order = np.argsort(late[a:b], kind="stable")[:take] + a
            order = order[meets[order]]
            out.append(tokens[order])
            of.append(np.full(len(order), i))
        of = np.concatenate(of)
        return {
            "token": _signed(np.concatenate(out)),
            "doc": pa.array(np.array(ids, np.int64)[of]),
            "n": pa.array(lengths[of].astype(np.int64)),
            "first": pa.array(takes[of].astype(np.int64)),
        }

    return _sets(docs, size, rows, "token long, doc long, n long, first long", only)


def _alike_size(percent: int) -> Column:
    return F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent


def _leaders(buckets: DataFrame, turn: int, percent: int) -> DataFrame:
    """``a, b``: for each document leaders of other components whom it meets in most of its buckets.

    The leader of a bucket has the least of a random order that changes with ``turn``. Documents of large buckets, which may be
    near copies of one text that are alike only here and there, get a leader from each such bucket, up to TRIES; the others get one.
    """

    def least(*of) -> Column:
        return F.min(F.struct(F.xxhash64("doc", *of, F.lit(turn)).alias("nth"), "doc", "n", "component"))

    found = buckets.groupBy("token").agg(
        (F.count("*") > MANY).alias("large"), least().alias("usual"), least("token").alias("own")
    )
    leader = F.when(F.col("large"), F.col("own")).otherwise(F.col("usual"))
    leaders = found.select(
        "token",
        "large",
        leader["doc"].alias("doc2"),
        leader["n"].alias("n2"),
        leader["component"].alias("component2"),
    )
    met = buckets.join(leaders, "token").filter(F.col("component") != F.col("component2")).filter(_alike_size(percent))
    counts = met.groupBy("doc", "doc2").agg(F.count("*").alias("times"), F.max("large").alias("large"))
    # one document meets at most as many leaders as its prefix has n-grams
    nth = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("times").desc(), "doc2"))
    few = counts.withColumn("nth", nth).filter((F.col("nth") == 1) | (F.col("large") & (F.col("nth") <= TRIES)))
    return few.select(F.col("doc").alias("a"), F.col("doc2").alias("b"))


def _shared(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values that stand in two lists or more, in order, and which list has which (a row for each list)."""
    values, where, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.cumsum(times > 1) - 1
    several = times[where] > 1
    has = np.zeros((len(lists), int((times > 1).sum())), np.float32)
    has[rows[several], column[where[several]]] = 1
    return values[times > 1], has


def _apart(docs: DataFrame, buckets: DataFrame, size: int, percent: int, largest: int) -> DataFrame:
    """``a, b``: links that join all components which alike documents of the buckets leave apart.

    ``buckets`` has the buckets of two components or more, and so all that such pairs share. Behind the shorter-reaching prefix a pair
    can share at most what that prefix leaves of its set. Pairs that meet in large buckets are compared there, all others come from
    small ones only, so the counts of both are whole where they decide.
    """
    counts = buckets.groupBy("token").agg(F.count("*").alias("docs"), F.sum("n").alias("ngrams"))
    sized = written(buckets.join(counts, "token"), "sized-buckets")
    pairs = written(_of_small(sized.filter(F.col("docs") <= MANY), percent), "pairs")
    few = verified(docs, pairs, size, percent, largest)
    large = sized.filter(F.col("docs") > MANY)
    ids = written(large.select("doc").distinct(), "large-docs")
    if ids.isEmpty():
        return few
    # a list is as long as the prefix of its document at most
    shares = sized.join(ids, "doc", "left_semi").groupBy("doc", "n").agg(
        F.collect_list("token").alias("shares"), F.collect_list(F.when(F.col("docs") > MANY, F.col("token"))).alias("wide")
    )
    members = large.join(shares.join(whole_sets(docs, size, bit_set(ids, "doc", BITS)), ["doc", "n"]), ["doc", "n"])
    return few.union(_of_large(members, percent))


def whole_sets(docs: DataFrame, size: int, only: np.ndarray) -> DataFrame:
    """``doc, n, tokens``: the different n-gram sets of each id in the bit set ``only``, packed in order."""

    def rows(ids: list, sets: list[np.ndarray]) -> dict[str, pa.Array]:
        s1, s2 = _signature(sets)
        return {
            "doc": pa.array(ids, pa.int64()),
            "n": pa.array([len(x) for x in sets], pa.int64()),
            "s1": _signed(s1),
            "s2": _signed(s2),
            "tokens": pa.array([x.tobytes() for x in sets], pa.binary()),
        }

    found = _sets(docs, size, rows, "doc long, n long, s1 long, s2 long, tokens binary", only)
    return found.dropDuplicates(["doc", "n", "s1", "s2"]).select("doc", "n", "tokens")


def _of_small(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of buckets of at most MANY documents, with the n-grams counted that they share there."""
    other = buckets.select("token", *[F.col(c).alias(f"{c}2") for c in ("doc", "n", "first", "component")])
    met = (
        buckets.join(other, "token")
        .filter((F.col("component") < F.col("component2")) & _alike_size(percent))
        .groupBy("doc", "doc2", "n", "n2", "first", "first2")
        .agg(F.count("*").alias("both"))
    )
    most = F.col("both") + F.greatest(F.col("n") - F.col("first"), F.col("n2") - F.col("first2"))
    enough = most * (100 + percent) >= percent * (F.col("n") + F.col("n2"))
    return met.filter(enough).select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (in order) are alike: overlaps of fragments are summed until what is left cannot change the answer."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    both = at = 0
    for begin in range(0, len(x), FRAGMENT):
        part = x[begin : begin + FRAGMENT]
        end = int(np.searchsorted(y, part[-1], "right"))
        both += len(np.intersect1d(part, y[at:end], assume_unique=True))
        at = end
        if both + min(len(x) - begin - len(part), len(y) - end) < need:
            return False
    return both >= need


def _of_large(buckets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between documents of large buckets, whose rows hold the whole set of the document in ``tokens``.

    A bucket is cut into blocks of about BLOCK documents and BLOCK_NGRAMS n-grams, and each two blocks meet in a group of their own; of
    the large buckets that a pair shares, the one of the least n-gram compares it. A group gives a link only if it joins two
    components that its links before left apart, so it has fewer rows than documents.
    """
    blocks = F.greatest(F.ceil(F.col("docs") / F.lit(BLOCK)), F.ceil(F.col("ngrams") / F.lit(BLOCK_NGRAMS))).cast("int")
    dealt = buckets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    keyed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "doc", "n", "first", "component", "shares", "wide", "tokens",
    )

    def links(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(groups))
        token, low, high = (k.as_py() for k in key)
        block, doc, n, first, component = (rows.column(c).to_numpy() for c in ("block", "doc", "n", "first", "component"))
        if component.min() == component.max():
            return
        _, has = _shared([np.array(x, np.int64) for x in rows.column("shares").to_pylist()])
        values, wide = _shared([np.array(x, np.int64) for x in rows.column("wide").to_pylist()])
        before = wide[:, : np.searchsorted(values, token)]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        both = has[left] @ has[right].T
        a, b = n[left][:, None], n[right][None, :]
        rest = np.maximum(a - first[left][:, None], b - first[right][None, :])
        keep = (
            (component[left][:, None] != component[right][None, :])
            & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            & ((both + rest) * (100 + percent) >= percent * (a + b))
            & (before[left] @ before[right].T == 0)
        )
        if low == high:
            keep &= doc[left][:, None] < doc[right][None, :]
        i, j = np.nonzero(keep)
        likely = np.argsort(-both[i, j], kind="stable")  # pairs that come later are mostly joined by then
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        label = {c: c for c in component.tolist()}

        def root(c: int) -> int:
            while label[c] != c:
                label[c] = c = label[label[c]]
            return c

        found: list[tuple[int, int]] = []
        for x, y in zip(left[i[likely]].tolist(), right[j[likely]].tolist(), strict=True):
            one, two = root(component[x]), root(component[y])
            if one != two and _alike(sets[x], sets[y], percent):
                label[one] = two
                found.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
        pair = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return keyed.groupBy("token", "low", "high").applyInArrow(links, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int, largest: int) -> DataFrame:
    """``a, b`` of the pairs (a written table) whose sets are alike: overlaps are counted per fragment and summed.

    Of rows that share an id each different set, told by its signature, is compared once and on its own. ``largest`` is the size of the largest set, which gives the number of fragments.
    """
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    only = bit_set(ids, "doc", BITS)
    fragments = largest // FRAGMENT + 1
    bounds = np.array([2**64 // fragments * k for k in range(1, fragments)], np.uint64)

    def rows(doc_ids: list, sets: list[np.ndarray]) -> dict[str, pa.Array]:
        out: dict[str, list] = {"doc": [], "fragment": [], "n": [], "s1": [], "s2": [], "tokens": []}
        signed = (x.view(np.int64).tolist() for x in _signature(sets))
        for doc_id, tokens, s1, s2 in zip(doc_ids, sets, *signed, strict=True):
            for k, part in enumerate(np.split(tokens, np.searchsorted(tokens, bounds))):
                for column, value in zip(out.values(), (doc_id, k, len(tokens), s1, s2, part.tobytes()), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return {name: pa.array(column, kind) for (name, column), kind in zip(out.items(), kinds, strict=True)}

    segments = _sets(docs, size, rows, "doc long, fragment int, n long, s1 long, s2 long, tokens binary", only)
    segments = segments.dropDuplicates(["doc", "fragment", "n", "s1", "s2"])
    named = ("n", "s1", "s2")
    left = segments.select(F.col("doc").alias("a"), "fragment", *[F.col(c).alias(f"{c}_a") for c in named], F.col("tokens").alias("left"))
    right = segments.select(F.col("doc").alias("b"), "fragment", *[F.col(c).alias(f"{c}_b") for c in named], F.col("tokens").alias("right"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    keys = ["a", "b", *[f"{c}_{end}" for end in "ab" for c in named]]

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [
                len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(counts, pa.int64())], [*keys, "part"])

    parts = both.select(*keys, "left", "right").mapInArrow(overlap, ", ".join(f"{c} long" for c in [*keys, "part"]))
    whole = parts.groupBy(*keys).agg(F.sum("part").alias("both"))
    return whole.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``doc, component`` for every end of a link (a written table ``a, b``): the least id that links reach.

    Every node takes the least of the labels around it and the label of its own label, until nothing changes.
    """
    edges = links.select(F.col("a").alias("doc"), F.col("b").alias("other")).union(links.select(F.col("b").alias("doc"), F.col("a").alias("other")))
    edges = written(edges.distinct(), "edges")
    labels = written(edges.groupBy("doc").agg(F.least(F.min("doc"), F.min("other")).alias("component")), "labels")
    while True:
        around = edges.join(labels.select(F.col("doc").alias("other"), F.col("component").alias("near")), "other")
        near = around.groupBy("doc").agg(F.min("near").alias("near"))
        far = labels.select(F.col("doc").alias("component"), F.col("component").alias("far"))
        step = labels.join(near, "doc").join(far, "component").select(
            "doc", F.least("near", "far").alias("next"), F.col("component").alias("old")
        )
        moved = written(step.select("doc", F.least("next", "old").alias("component"), "old"), "labels")
        labels = moved.select("doc", "component")
        if moved.filter("component <> old").isEmpty():
            return labels


def linked(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    Sets are the distinct ``size``-word shingles of the text in lower case (A-Z); a shorter text is one shingle, a text without
    words or null has none and is linked with nothing. Rows that share an id are one node, linked where any of their texts is. Rows with a
    null id keep their ``n_shingles`` and have no component. An empty table gives no rows; other columns are not read.
    Texts, and the sets of pairs, reach Python in small batches.
    """
    with small_batches(docs.sparkSession):
        return _linked(docs.select("doc_id", "text"), size, percent)


def _linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    sets = written(signatures(docs, size), "signatures")
    classes = written(
        sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc")), "classes"
    )
    own = sets.filter("n > 0").join(classes, ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    links = written(own.filter("a <> b").distinct(), "links")
    only = bit_set(classes, "doc", BITS)
    total, largest = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    prefix = written(prefixes(docs, size, percent, only, total).distinct(), "prefixes")  # repeated rows once
    met = prefix.groupBy("token").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("token")
    buckets = written(prefix.join(met, "token").withColumn("component", F.col("doc")), "buckets")
    found = links.limit(0)
    for turn in range(STARS):
        if buckets.isEmpty():
            break
        pairs = written(_leaders(buckets, turn, percent), "pairs")
        if not pairs.isEmpty():
            found = written(found.union(verified(docs, pairs, size, percent, largest)), "links")
        if found.isEmpty():
            continue
        # buckets of one component need no more pairs
        now = written(components(found), "labels")
        moved = (
            buckets.drop("component")
            .join(now, "doc", "left")
            .select("token", "doc", "n", "first", F.coalesce("component", "doc").alias("component"))
        )
        mixed = moved.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        buckets = written(moved.join(mixed.filter("low < high").select("token"), "token"), "buckets")
    if not buckets.isEmpty():
        found = found.union(_apart(docs, buckets, size, percent, largest))
    final = components(written(links.union(found).distinct(), "links"))
    rows = sets.join(final, sets["doc_id"] == final["doc"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
    nameless = docs.filter("doc_id is null")
    return rows.unionByName(_nameless(nameless, size)) if not nameless.isEmpty() else rows


def _nameless(docs: DataFrame, size: int) -> DataFrame:
    """The rows without an id."""
    numbered = docs.withColumn("doc_id", F.lit(0).cast("long"))
    none = F.lit(None).cast("long")
    return signatures(numbered, size).select(
        none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id")
    )


def kept(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all columns, that stand for their component: of linked documents the one with the least id.

    Texts without words and rows without an id are linked with nothing and stay. Of rows that share an id all stay.
    """
    found = linked(docs.filter("doc_id is not null"), size, percent).filter("doc_id <> component_id")
    gone = written(found.select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def one_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all columns, without copies: of linked rows the one with the least id stays, ids before null.

    Other than in :func:`kept` a row stands for itself, not for its id: rows that share an id or have none are compared like all
    others, so of repeated rows one stays. Rows without words are linked with nothing and stay. An empty table gives no rows.
    """
    rows = F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")
    dealt = written(docs.select(F.monotonically_increasing_id().alias("at"), rows), "rows")
    part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = (dealt.agg(F.max(part)).first()[0] or 0) + 1
    # numbers near each other, as sets of them are folded onto few bits
    numbered = dealt.select((nth * parts + part).alias("nr"), "row")
    found = linked(numbered.select(F.col("nr").alias("doc_id"), F.col("row.text").alias("text")), size, percent)
    groups = written(found.select(F.col("doc_id").alias("nr"), "component_id"), "groups")
    # most rows are a group of one; of the others ids decide
    several = groups.filter("nr <> component_id").select("component_id").distinct()
    ids = numbered.select("nr", F.col("row.doc_id").alias("doc_id")).join(groups.join(several, "component_id"), "nr")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nr")
    stays = ids.groupBy("component_id").agg(F.min(order)["nr"].alias("nr"))
    gone = ids.join(stays, ["component_id", "nr"], "left_anti").select("nr")
    return numbered.join(written(gone, "copies"), "nr", "left_anti").select("row.*")
