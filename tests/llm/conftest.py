import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text, source), with columns whose names operators use for results."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        for name in ("size", "length", "rank", "n", "key", "token", "kept", "score", "copies", "labels", "spans", "doc"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def twins():
    """Two different words of 1,024 letters that every polynomial modulo 2^64 takes for one."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))
