"""The operators as named queries over the tables of one folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import (
    chat, html, merkle, mixing, ngrams, nndescent, outliers, packing, pivots, secrets, sharding,
    survival, toxicity,
)
from tablegauge.llm.audit_sql import AUDIT_SQL, MERKLE_SQL
from tablegauge.llm.common import table


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.place(table(spark, folder, "documents"), 1024, 2)


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op3_ring_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.deal(table(spark, folder, "documents"), 40)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    spans = secrets.scan(table(spark, folder, "documents")).withColumn(
        "base", F.filter("spans", lambda s: s["kind"] != "format"))
    return spans.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (table(spark, folder, name) for name in ("documents", "labels"))
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.join(table(spark, folder, "documents"), 3, 90)


#: A conversation of control strings, added to the table.
PROBE = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"))
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    out = chat.format_rows(rows.unionByName(probe))
    said = F.concat_ws("", F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id", F.size(chat.parse(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256",
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op9_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return nndescent.search(rows, rows.filter("vec_id % 100 = 0"), 10)


def op10_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_equal(table(spark, folder, "embeddings"), 0.95)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audited(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return survival.audit(*(table(spark, folder, name) for name in ("documents", "labels")))


def op13_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")


def _escaped_sql(text: str) -> str:
    sql = f"replace({text}, '\\', '\\\\')"
    for control in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        sql = f"replace({sql}, '{control}', '{control[0]}\\.{control[1:]}')"
    return sql


CHAT_SQL = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), whole as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, role, text)
      filter (where role = 'assistant'), '') as learnt,
    sum(32 + length({_escaped_sql('role')}) + length({_escaped_sql('text')})) as chars
  from said group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(learnt) as loss_chars,
  sha256(learnt) as loss_sha256, cast(chars as bigint) as formatted_chars
from whole
"""

QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_html_extraction, op3_ring_sharding, op4_secret_scan,
    op5_source_mixing, op6_toxicity, op7_ngram_jaccard_join,
    op8_chat_formatting, op9_nn_descent, op10_embedding_near_dedup,
    op11_merkle_manifest, op12_filter_audit, op13_quality_outliers,
)}
ORACLES = {
    "op8_chat_formatting": CHAT_SQL, "op11_merkle_manifest": MERKLE_SQL,
    "op12_filter_audit": AUDIT_SQL,
}
