"""What the stages of the pipeline hold in memory at once."""

import tracemalloc

import corpus_pipeline
import numpy as np
import pytest

from tidegauge.llm import common, jaccard, toxicity

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def large_batches(spark):
    """The session with Spark's own size of record batches."""
    before = spark.conf.get(NAME)
    spark.conf.set(NAME, "10000")
    yield
    spark.conf.set(NAME, before)


@pytest.mark.parametrize("stage", ["toxicity", "secrets"])
def test_stages_run_later_in_small_batches(spark, documents, tmp_path, large_batches, stage):
    """A caller writes the result of a stage; with 10,000 whole texts in a batch executors went over their limit."""
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents([(i, f"text {i}", "a") for i in range(3)])
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert int(spark.conf.get(NAME)) == common.BATCH_ROWS
    assert found.count() == 3


def test_smaller_batches_of_the_session_stay(spark, large_batches):
    spark.conf.set(NAME, "7")
    common.use_small_batches(spark)
    assert spark.conf.get(NAME) == "7"
    spark.conf.set(NAME, "0")  # without a bound
    common.use_small_batches(spark)
    assert int(spark.conf.get(NAME)) == common.BATCH_ROWS


def test_near_copies_in_small_batches(spark, documents, monkeypatch, large_batches):
    """A batch of pairs holds both sets of each."""
    seen = []

    def spied(df, folder):
        seen.append(int(spark.conf.get(NAME)))
        return common.written(df, folder)

    monkeypatch.setattr(jaccard, "written", spied)
    docs = documents([(i, "one two three four five six seven eight nine ten " * 3 + ("x" if i % 2 else ""), "a") for i in range(4)])
    rows = jaccard.linked(docs).collect()
    assert {r.component_id for r in rows} == {0} and len(rows) == 4
    assert set(seen) == {common.BATCH_ROWS} and spark.conf.get(NAME) == "10000"


def test_fit_holds_the_sample_few_times():
    """The driver fits the sample; sorting all of its words at once, and looking all of them up at once, took many times its size."""
    random = np.random.default_rng(3)
    docs = [toxicity.mix(random.integers(0, 20_000, (1500, toxicity.KINDS)).astype(np.uint64)) for _ in range(400)]
    toxic = np.arange(400) % 2 > 0
    for of, label in zip(docs, toxic, strict=True):
        of[::1000, 0] = 7 if label else 8
    tracemalloc.start()
    field = toxicity.fit(docs, toxic, 0.5)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert np.isfinite(field.weights).all()
    assert peak < 5 * sum(x.nbytes for x in docs)


def test_fit_lets_go_of_what_a_step_needed():
    """Counting, fitting and scoring the sample come one behind the other; together they took over one and a half times its size."""
    random = np.random.default_rng(1)
    docs = [random.zipf(1.3, (1000, toxicity.KINDS)).astype(np.uint64) % np.uint64(20_000) + np.uint64(10) for _ in range(400)]
    toxic = np.arange(400) % 2 > 0
    for i in range(1, 400, 2):
        docs[i][::50] = 1
    tracemalloc.start()
    field = toxicity.fit(docs, toxic, 0.5)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert np.isfinite(field.weights).all()
    assert peak < 1.1 * sum(x.nbytes for x in docs)


def test_driver_gives_freed_memory_back_behind_each_table(spark, documents, monkeypatch):
    """The driver's JVM kept what its jobs had freed, from table to table."""
    given = []
    release = common.release_jvm
    monkeypatch.setattr(common, "release_jvm", lambda session: given.append(release(session)))
    docs = documents([(1, "a b", "a"), (2, None, None)])
    assert common.written(docs, "test-table").count() == 2
    assert given == [True]
    assert release(None) is False
