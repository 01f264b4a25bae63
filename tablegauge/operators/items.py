"""Improvement items: the ranked to-do list that fits the gap of each scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge import constants as K
from tablegauge.functions.bands import grouped, whole
from tablegauge.functions.names import TABLE_KEY
from tablegauge.operators.composite import covered_cr_keys, cr_keys, relevant_views
from tablegauge.operators.consumption import SCOPED_KEY, with_cr_flag
from tablegauge.params import ScanParams

ITEM_COLUMNS = ("scope", "item_rank", "item_type", "target", "detail", "recommendation")
#: Gaps whose items are about places, which the summary names.
TARGET_GAPS = ("BUILD_CR_TABLES", "BUILD_SVS", "EXPAND_SV_COVERAGE")


def _items(df: DataFrame, item_type: str, order: list[Column], limit: int) -> DataFrame:
    """Best rows per scope. The rank filter is applied before the shuffle as well as after."""
    ranked = df.withColumn(
        "item_rank", F.row_number().over(Window.partitionBy("scope").orderBy(*order))
    ).where(F.col("item_rank") <= limit)
    return ranked.withColumn("item_type", F.lit(item_type)).select(*ITEM_COLUMNS)


def items_schema_gap(scores: DataFrame, params: ScanParams) -> DataFrame:
    """Schemas with the most reads on tables that are not consumption-ready."""
    ready = F.col("is_cr")
    schemas = with_cr_flag(scores, params).groupBy("scope", "database_name", "schema_name").agg(
        F.sum("reads").alias("reads"),
        F.sum("n_rows").alias("tables"),
        F.sum(F.when(ready, F.col("n_rows")).otherwise(0)).alias("cr_tables"),
        F.sum(F.when(ready, 0).otherwise(F.col("reads"))).alias("missed"),
    ).where(F.col("reads") >= params.min_schema_reads)
    described = schemas.select(
        "scope", "missed",
        F.concat_ws(".", "database_name", "schema_name").alias("target"),
        F.format_string(K.SCHEMA_DETAIL, grouped(F.col("reads")), "tables", "cr_tables")
        .alias("detail"),
        F.concat(grouped(F.col("missed")), F.lit(" reads miss ready tables"))
        .alias("recommendation"),
    )
    return _items(described, "SCHEMA_GAP", [F.desc("missed"), F.col("target")], params.max_items)


def items_uncovered_cr(scores: DataFrame, quality: DataFrame, params: ScanParams) -> DataFrame:
    """Most read CR tables that no semantic view is based on."""
    uncovered = cr_keys(scores, params).join(
        covered_cr_keys(scores, quality, params), list(SCOPED_KEY), "left_anti"
    )
    described = scores.join(uncovered, list(SCOPED_KEY), "left_semi").select(
        "scope", "analytical_reads", "full_table_name",
        F.concat_ws(".", *TABLE_KEY).alias("target"),
        F.format_string(K.TABLE_DETAIL, grouped(F.col("analytical_reads")), "distinct_users")
        .alias("detail"),
        F.lit("not in any view").alias("recommendation"),
    )
    order = [F.desc("analytical_reads"), F.col("target"), F.col("full_table_name")]
    return _items(described, "UNCOVERED_CR_TABLE", order, params.max_items)


def missing_parts() -> Column:
    """What a view lacks, in the fixed order: absent flags, or no verified query."""
    return F.array_compact(F.array(*[
        F.when(F.col(column).cast("int") == 0, label) for column, label in K.MISSING_PARTS
    ]))


def items_sv_quality(scores: DataFrame, quality: DataFrame, params: ScanParams) -> DataFrame:
    """Weakest views among those that touch a CR table."""
    weak = relevant_views(scores, quality, params).where(F.col("quality_score") < K.GAP_CUT)
    parts = F.slice(missing_parts(), 1, K.MAX_MISSING_PARTS)
    described = weak.select(
        "scope", "quality_score", F.col("sv_fqn").alias("target"),
        F.format_string(K.VIEW_DETAIL, whole(F.col("quality_score") * 100)).alias("detail"),
        F.when(F.size(parts) > 0, F.concat(F.lit("without "), F.array_join(parts, ", ")))
        .otherwise("thin comments or few verified queries").alias("recommendation"),
    )
    order = [F.col("quality_score"), F.col("target")]
    return _items(described, "SV_QUALITY_GAP", order, params.max_items)


def improvement_items(
    composite: DataFrame, scores: DataFrame, quality: DataFrame, params: ScanParams
) -> DataFrame:
    """Items of the one kind that fits each scope's gap; none for a healthy scope."""
    wanted = composite.select("scope", "gap")

    def of(*gaps: str) -> DataFrame:
        """Scores of the scopes with these gaps only, so that no others are grouped or ranked."""
        return scores.join(wanted.where(F.col("gap").isin(*gaps)), "scope", "left_semi")

    fitting = (
        items_schema_gap(of("BUILD_CR_TABLES"), params),
        items_uncovered_cr(of("BUILD_SVS", "EXPAND_SV_COVERAGE"), quality, params),
        items_sv_quality(of("IMPROVE_SV_QUALITY"), quality, params),
    )
    return reduce(DataFrame.unionByName, fitting)


def top_targets(
    composite: DataFrame, items: DataFrame, params: ScanParams
) -> DataFrame:
    """Composite rows with the first targets as a list; empty for quality gaps and healthy."""
    first = items.where(F.col("item_rank") <= params.max_targets).groupBy("scope").agg(
        F.sort_array(F.collect_list(F.struct("item_rank", "target"))).alias("ranked")
    )
    some = F.col("ranked").isNotNull() & F.col("gap").isin(*TARGET_GAPS)
    targets = F.when(some, F.col("ranked.target")).otherwise(F.array().cast("array<string>"))
    return (
        composite.join(first, "scope", "left")
        .withColumn("top_targets", targets).drop("ranked")
    )
