"""A corpus from raw documents to packed sequences.

Each stage takes what the one before has kept; all but the last return the columns of
documents. They bound the session's Arrow batches by ``BATCH_ROWS``. Empty input gives empty output; a null text is clean, has no words and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import mixing, ngrams, packing, secrets, toxicity
from tablegauge.llm.common import BATCH_ROWS, in_small_batches, stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose expected severity is below the limit."""
    in_small_batches(spark)
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return docs.filter(toxicity.severity(model) < toxicity.LIMIT)


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8."""
    in_small_batches(spark)
    return ngrams.one_of_each(docs, 5, 80)


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, its secrets replaced by a mask; n_chars follows the text."""
    in_small_batches(spark)
    clean = docs.withColumn("text", secrets.redacted(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each source as often as its target weight asks."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 1024 tokens."""
    in_small_batches(spark)
    return packing.place(docs, 1024, 2)


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_copies),
    ("secret scan", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]
#: Tokenizing, regression and random rounding have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
