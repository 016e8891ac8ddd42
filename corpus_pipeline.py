"""From raw documents to packed training sequences, in stages that each keep the columns of ``documents``.

Stages that hand whole texts to Python keep the session at small record batches: a caller writes their results, and the executors of one
run keep what each stage needed at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import jaccard, mixing, packing, secrets, toxicity
from tidegauge.llm.common import table, use_small_batches, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the field finds toxic; it is fitted on the labelled ones among ``docs``."""
    use_small_batches(spark)
    field = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, field)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that shares 0.8 of its five-word shingles, directly or over others; repeated rows are such a group."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of a secret in its place."""
    use_small_batches(spark)
    return secrets.redacted(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents, or leaves them out, as the mix takes them."""
    return mixing.repeated(docs)


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into pieces and packs them; the result is a row for each piece."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", to_target_weights),
    ("packing", to_sequences),
]

# fitting and packing are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
