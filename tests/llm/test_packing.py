"""How texts reach the packer."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tidegauge.llm import common, packing


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """A batch lies in an executor's memory several times; of 10,000 whole texts at once it took the executor over its limit."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)

    def spied(df, folder):
        seen.append(int(spark.conf.get(name)))
        return common.written(df, folder)

    monkeypatch.setattr(packing, "written", spied)
    docs = spark.range(1_300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).coalesce(1)
    assert packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id").distinct().count() == 1_300
    assert seen == [common.BATCH_ROWS] and spark.conf.get(name) == before

    with common.small_batches(spark, 200):
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 1_300 and max(r.n for r in sizes) <= 200
