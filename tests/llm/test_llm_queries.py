"""The registered queries of the folder against their SQL, and the pipeline."""

import compare
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR).toArrow()
    assert found.num_rows > 0
    assert compare.same(found, duck.sql(ORACLE[name]).to_arrow_table()) is None


def test_all_operators():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), "test-stage")
        assert docs.columns == columns, name
        if name == "near copies":
            assert docs.count() == docs.select("doc_id").distinct().count() <= ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.filter("start = 0").count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()


def test_pipeline_of_odd_rows(spark, documents, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "toxic": pa.array([], pa.int32())}), tmp_path / "labels.parquet")
    docs = documents([(1, None, None), (2, "", "a"), (None, "a b c", "a"), (3, "a b c d e f", None), (4, "a b c d e f", "a"), (3, "a b c d e f", None)])
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test-stage")
    assert docs.count() > 0
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test-stage")
    assert docs.count() == 0
