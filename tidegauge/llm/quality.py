"""Quality rules: figures of each text, and lines that too many documents of one host share. Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import written

GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MOST_DOCS = 20  # a line is common from so many documents of its host on, whatever the size of the host
SHARE_PCT = 10.0  # or, in smaller hosts, from this share of the documents of its host
MIN_DOCS = 5  # and at least so many of them
LEFT_PCT = 50  # a document with less than this share of its words left is depleted
SALTS = 32


def _words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(F.btrim(text, F.lit(SPACES)), GAP), "")


def _neighbours(values: str, step: int) -> Column:
    """Each value hashed with the one ``step`` further on; the last ``step`` values have none and go."""
    left = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), left), F.slice(values, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))


def _twice(pairs: str) -> Column:
    """Of sorted pairs (hash, start), the starts whose hash occurs twice or more, in order of start."""
    last = F.size(pairs) - 1
    kept = F.transform(
        pairs,
        lambda p, k: F.when(
            ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])) | ((k < last) & (F.get(pairs, k + 1)["h"] == p["h"])), p["i"]
        ),
    )
    return F.array_sort(F.array_compact(kept))


def _covered(starts: str, window: int) -> Column:
    """How many words lie in windows of ``window`` words that begin at the sorted ``starts``."""
    each = F.transform(starts, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window))))
    return F.aggregate(each, F.lit(0).cast("long"), lambda total, c: total + c)


def figures(docs: DataFrame) -> DataFrame:
    """Adds to ``docs`` (with ``text``) ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Null text has no words. Windows are compared by 64-bit hashes inside one text; only texts with a repeated window sort
    theirs. Each array is a column of its own, so nothing is worked out twice.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    steps = (
        docs.withColumn("_words", _words(text))
        .withColumn("_full", full)
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_two", _neighbours("_hashes", 1))
        .withColumn("_four", _neighbours("_two", 2))
        .withColumn("_windows", _neighbours("_four", 4))
        .withColumn(
            "_pairs",
            F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"),
                F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .withColumn("_starts", _twice("_pairs"))
    )
    out = steps.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": F.coalesce(_covered("_starts", WINDOW), F.lit(0).cast("long")),
        }
    ).drop("_words", "_full", "_hashes", "_two", "_four", "_windows", "_pairs", "_starts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


KEY = ("host", "doc", "text_hash")  # what tells documents apart: rows that agree in it have one verdict


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds KEY to ``doc_id, source, text``: host and document as texts, null apart from every value, and a hash of the text."""
    host = F.coalesce(F.concat(F.lit("h"), F.col("source").cast("string")), F.lit("null"))
    doc = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("null"))
    return docs.withColumns({"host": host, "doc": doc, "text_hash": F.xxhash64(F.coalesce("text", F.lit("")))})


def lines_of(docs: DataFrame) -> DataFrame:
    """KEY, ``nth, line, chars`` for each line that isn't blank: its place and a hash of the trimmed line in lower case."""
    each = F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")).alias("nth", "line")
    return (
        docs.select(*KEY, each)
        .withColumn("line", F.btrim("line", F.lit(SPACES)))
        .filter("line <> ''")
        .select(*KEY, "nth", F.xxhash64("line").alias("line"), F.length("line").cast("long").alias("chars"))
    )


def common_lines(lines: DataFrame, most_docs: int = MOST_DOCS, share_pct: float = SHARE_PCT, min_docs: int = MIN_DOCS) -> DataFrame:
    """``host, line`` of the lines that stand in too many documents of a host: a fixed number, or a share of a smaller host."""
    # a pair of line and document goes once, so what meets for one line is a count from each task
    per_line = lines.select(*KEY, "line").distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    hosts = lines.select(*KEY).distinct().groupBy("host").agg(F.count("*").alias("all_docs"))
    many = (F.col("docs") >= most_docs) | (100 * F.col("docs") >= share_pct * F.col("all_docs"))
    return per_line.join(hosts, "host").filter(many).select("host", "line")


def removed_chars(docs: DataFrame) -> DataFrame:
    """KEY, ``removed``: characters in lines that the rule removes, for documents that lose any."""
    lines = written(lines_of(docs), "lines")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc", "text_hash"), F.lit(SALTS)).cast("int"))
    # each common line stands in MIN_DOCS documents or more, so the copies for the salts stay near the rows of lines
    common = common_lines(lines).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    # the place of a line makes repeated rows of a document one
    gone = salted.join(common, ["host", "line", "salt"]).select(*KEY, "nth", "chars").distinct()
    return gone.groupBy(*KEY).agg(F.sum("chars").alias("removed"))


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, the figures of :func:`figures`, ``removed_chars`` and ``kept`` for every row of ``docs``.

    A document fails by its own figures, or if the lines that its host repeats leave less than LEFT_PCT per cent of its
    word characters. Hosts are the values of ``source``; null is one of its own. Rows that agree in id, source and text are one document
    and have one verdict however often they come; other rows, also with one id or without, are documents of their own. So
    copies under other ids count for a line. An empty table gives no rows; other columns are not read.
    """
    keyed = _keyed(docs.select("doc_id", "source", "text"))
    own = figures(keyed).drop("text", "source")
    rows = own.join(removed_chars(keyed), list(KEY), "left")
    removed = F.coalesce("removed", F.lit(0).cast("long"))
    # a line's characters include the single spaces between its words
    depleted = 100 * removed > (100 - LEFT_PCT) * (F.col("word_chars") + F.col("n_words"))
    return rows.select(
        *[c for c in own.columns if c not in KEY], removed.alias("removed_chars"), (~(F.col("base_failed") | depleted)).alias("kept")
    )
