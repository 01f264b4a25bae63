"""Composite scores per scope: demand, semantic-view coverage and quality, and the gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge import constants as K
from tablegauge.functions import scoring
from tablegauge.functions.bands import whole
from tablegauge.functions.names import TABLE_KEY
from tablegauge.operators.consumption import SCOPED_KEY, with_cr_flag
from tablegauge.operators.semantic import BASE_KEY, QUALITY_FLAGS
from tablegauge.params import ALL_DATABASES, ScanParams


def demand_coverage(scores: DataFrame, params: ScanParams) -> DataFrame:
    """Share of reads on CR tables per scope; NULL when there are too few reads to tell."""
    per_scope = with_cr_flag(scores, params).groupBy("scope").agg(
        F.sum("n_rows").alias("n_all_scored"),
        F.count_if("is_cr").alias("n_cr_tables"),
        F.sum("reads").alias("total_reads"),
        F.sum(F.when(F.col("is_cr"), F.col("reads")).otherwise(0)).alias("reads_on_cr"),
    )
    enough = F.col("total_reads") >= params.min_total_reads
    return per_scope.withColumn(
        "pct_demand", F.when(enough, F.col("reads_on_cr") / F.col("total_reads"))
    )


def cr_keys(scores: DataFrame, params: ScanParams) -> DataFrame:
    """Distinct CR tables per scope."""
    return with_cr_flag(scores, params).where("is_cr").select(*SCOPED_KEY)


def _based_on(quality: DataFrame, *columns: str) -> DataFrame:
    """Base tables of views under the table key; an unknown name is the empty one."""
    key = [
        F.coalesce(base, F.lit("")).alias(name) for base, name in zip(BASE_KEY, TABLE_KEY)
    ]
    return quality.select(*key, *columns)


def covered_cr_keys(scores: DataFrame, quality: DataFrame, params: ScanParams) -> DataFrame:
    """CR tables per scope that at least one semantic view is based on."""
    based = _based_on(quality).distinct()
    return cr_keys(scores, params).join(based, list(TABLE_KEY), "left_semi")


def relevant_views(scores: DataFrame, quality: DataFrame, params: ScanParams) -> DataFrame:
    """Per scope, each view that touches a CR table, once."""
    columns = ("sv_fqn", *QUALITY_FLAGS, "n_verified_queries", "quality_score")
    touched = cr_keys(scores, params).join(_based_on(quality, *columns), list(TABLE_KEY))
    return touched.groupBy("scope", "sv_fqn").agg(
        *[F.bool_or(flag).alias(flag) for flag in QUALITY_FLAGS],
        F.max("n_verified_queries").alias("n_verified_queries"),
        F.max("quality_score").alias("quality_score"),
    )


def sv_coverage(scores: DataFrame, quality: DataFrame, params: ScanParams) -> DataFrame:
    """Share of CR tables with a semantic view; 0 in a scope without CR tables."""
    totals = demand_coverage(scores, params).select("scope", "n_cr_tables")
    covered = covered_cr_keys(scores, quality, params).groupBy("scope").agg(
        F.count("*").alias("n_sv_covered")
    )
    share = scoring.ratio(F.col("n_sv_covered"), F.col("n_cr_tables"))
    return (
        totals.join(covered, "scope", "left").na.fill(0, ["n_sv_covered"])
        .withColumn("pct_sv_coverage", F.coalesce(share, F.lit(0.0)))
    )


def sv_quality_avg(relevant: DataFrame) -> DataFrame:
    """Mean quality and share of each flag over the relevant views."""
    return relevant.groupBy("scope").agg(
        F.avg("quality_score").alias("avg_sv_quality"),
        *[F.avg(F.col(flag).cast("int")).alias(f"share_{flag}")
          for flag, _ in K.MISSING_DIMENSIONS],
    )


def missing_dims() -> Column:
    """Names of the flags that fewer than half of the relevant views have."""
    return F.array_compact(F.array(*[
        F.when(F.col(f"share_{flag}") < K.GAP_CUT, label) for flag, label in K.MISSING_DIMENSIONS
    ]))


def composite_scores(
    scores: DataFrame, quality: DataFrame, params: ScanParams, scopes: DataFrame | None = None
) -> DataFrame:
    """One row per scope with its scores, gap and counters.

    ``scopes`` lists databases to report even if nothing in them was read.
    """
    demand = demand_coverage(scores, params)
    if scopes is not None:
        demand = scopes.select("scope").distinct().join(demand, "scope", "left")
    coverage = sv_coverage(scores, quality, params).select(
        "scope", "n_sv_covered", "pct_sv_coverage"
    )
    relevant = sv_quality_avg(relevant_views(scores, quality, params))
    n_views = quality.agg(F.count_distinct("sv_fqn")).scalar()
    joined = (
        demand.join(coverage, "scope", "left").join(relevant, "scope", "left")
        .na.fill(0, ["n_all_scored", "n_cr_tables", "n_sv_covered",
                     "pct_sv_coverage", "avg_sv_quality"])
        .withColumn("n_sv", n_views)
        .withColumn("missing_dims", missing_dims())
    )
    demand_share, cover, depth = (
        F.col("pct_demand"), F.col("pct_sv_coverage"), F.col("avg_sv_quality")
    )

    def percent(share: Column, name: str) -> Column:
        return F.round(share * 100, 2).alias(name)

    return joined.select(
        "scope",
        percent(scoring.ai_readiness(demand_share, cover, depth), "ai_readiness"),
        percent(F.coalesce(demand_share, F.lit(0.0)), "demand_coverage"),
        percent(scoring.sv_readiness(cover, depth), "sv_readiness"),
        percent(cover, "sv_coverage"),
        percent(depth, "sv_quality"),
        "n_cr_tables",
        scoring.gap_class(demand_share, F.col("n_cr_tables"), cover, depth).alias("gap"),
        "n_all_scored", "n_sv", "n_sv_covered",
        demand_share.alias("pct_demand_raw"),
        cover.alias("pct_sv_coverage_raw"),
        depth.alias("avg_sv_quality_raw"),
        "missing_dims",
    )


def estate_scopes(databases: DataFrame) -> DataFrame:
    """Every database of a ``database_name`` column, and the estate as a whole."""
    return databases.select(
        F.explode(F.array(F.lit(ALL_DATABASES), F.upper("database_name"))).alias("scope")
    ).distinct()


def recommendation_text(account_name: str) -> Column:
    """A line of facts about a composite row that carries its top_targets.

    Every measure is given with its grade: strong, fair or weak. Coverage is left out where there
    is nothing to cover, depth where there are no views. The line ends with what fits the gap.
    """
    n_cr, targets, missing = F.col("n_cr_tables"), F.col("top_targets"), F.col("missing_dims")
    demand = F.coalesce("pct_demand_raw", F.lit(0.0))
    cover, depth = F.col("pct_sv_coverage_raw"), F.col("avg_sv_quality_raw")

    def fact(name: str, value: Column, grade: Column, *more: Column) -> Column:
        return F.concat(F.lit(f"{name} "), value, F.lit(" ("), F.concat_ws(", ", grade, *more),
                        F.lit(")"))

    def percent(share: Column) -> Column:
        return F.concat(whole(share * 100), F.lit("%"))

    def grade(share: Column, strong: float = K.GAP_CUT) -> Column:
        return F.when(share >= strong, "strong").when(share >= K.GAP_CUT, "fair").otherwise("weak")

    lacking = F.when((depth < K.GAP_CUT) & (F.size(missing) > 0), F.concat(
        F.lit("lacking "), F.array_join(missing, " and ")))
    todo = F.create_map(*[F.lit(x) for pair in K.NEXT_STEPS.items() for x in pair])[F.col("gap")]
    where = F.when(F.size(targets) > 0, F.concat(F.lit(" in "), F.array_join(targets, ", ")))
    return F.concat_ws(
        "; ",
        F.concat(F.lit(f"{account_name}: "), whole(F.col("ai_readiness")), F.lit(" of 100")),
        fact("reads on ready tables", percent(demand), grade(demand, K.STRONG_DEMAND),
             F.concat(n_cr.cast("string"), F.lit(" ready"))),
        F.when(n_cr > 0, fact("ready tables in views", percent(cover), grade(cover), F.concat(
            F.col("n_sv_covered").cast("string"), F.lit(" of "), n_cr.cast("string")))),
        F.when(depth > 0, fact("depth of views", F.format_number(depth, 2), grade(depth), lacking)),
        F.concat(F.lit("to do: "), todo, F.coalesce(where, F.lit(""))),
    )
