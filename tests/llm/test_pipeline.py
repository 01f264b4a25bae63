"""The pipeline's stages take effect on what each has received."""

from pyspark.sql import functions as F

import corpus_pipeline
from tablegauge.llm import secrets
from tablegauge.llm.common import stored
from tests.conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3]
    assert not any(secrets.base_spans(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    try:
        spark.conf.set(key, 10_000)
        corpus_pipeline.without_secrets(spark, docs.withColumn("n_chars", F.lit(5)), "")
        assert int(spark.conf.get(key)) == corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(key, before)
