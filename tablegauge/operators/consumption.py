"""Consumption readiness (CR): one score per table and scope from four signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import scoring
from tablegauge.functions.names import TABLE_KEY, in_scope, per_scope, upper_key
from tablegauge.functions.ranks import with_percent_ranks
from tablegauge.operators.reads import reads_joined, reads_per_table
from tablegauge.params import ScanParams
from tablegauge.session import settle
from tablegauge.sources.relations import since_days_ago

#: Identity of a scored table within a scope.
SCOPED_KEY = ("scope", *TABLE_KEY)


def table_ages(tables: DataFrame, params: ScanParams) -> DataFrame:
    """Days since the last change, for live base tables changed within the freshness window."""
    recent = since_days_ago(
        tables.where(F.col("deleted").isNull() & (F.col("table_type") == "BASE TABLE")),
        "last_altered", params, params.freshness_days,
    )
    today = F.lit(str(params.today)).cast("date")
    ages = recent.select(
        *upper_key("table_catalog", "table_schema", "table_name"),
        F.datediff(today, F.to_date("last_altered")).alias("days_since_update"),
    )
    return in_scope(ages, "database_name", params)


def with_freshness(reads: DataFrame, tables: DataFrame, params: ScanParams) -> DataFrame:
    """Attach the age of each read table; NULL when it is unknown or too old."""
    return reads.join(table_ages(tables, params), list(TABLE_KEY), "left")


def cr_inputs(
    access: DataFrame, queries: DataFrame, sessions: DataFrame, tables: DataFrame,
    params: ScanParams,
) -> DataFrame:
    """Read counts, median latency and age per table: all that the logs are needed for."""
    reads = reads_joined(access, queries, sessions, params)
    return with_freshness(reads_per_table(reads, params), tables, params)


def cr_percent_ranks(inputs: DataFrame, params: ScanParams) -> DataFrame:
    """Rank reads, users and BI reads within every scope a table belongs to."""
    return with_percent_ranks(per_scope(inputs, params), "scope", {
        "analytical_reads": "activity_pctile",
        "distinct_users": "user_pctile",
        "app_reads": "app_pctile",
    })


def cr_scores(
    access: DataFrame, queries: DataFrame, sessions: DataFrame, tables: DataFrame,
    params: ScanParams,
) -> DataFrame:
    """Score every read table, in its own database and in the whole estate."""
    return scores_of_inputs(settle(cr_inputs(access, queries, sessions, tables, params)), params)


def scores_of_inputs(inputs: DataFrame, params: ScanParams) -> DataFrame:
    """Scores from settled :func:`cr_inputs` of the same scope or of the whole estate."""
    return score_tables(cr_percent_ranks(in_scope(inputs, "database_name", params), params))


def score_tables(ranked: DataFrame) -> DataFrame:
    signals = {
        "activity": F.col("activity_pctile"),
        "consumption": F.greatest("user_pctile", "app_pctile"),
        "speed": scoring.speed(F.col("p50_execution_ms")),
        "freshness": scoring.freshness(F.col("days_since_update")),
    }
    return ranked.select(
        *SCOPED_KEY, "full_table_name",
        "analytical_reads", "distinct_users", "app_reads", "distinct_app_tools",
        *[F.round(signal, 4).alias(f"{name}_score") for name, signal in signals.items()],
        F.round(scoring.consumption_readiness(**signals), 4)
        .alias("consumption_readiness_score"),
    )


def by_score(scores: DataFrame) -> DataFrame:
    """Scored tables, best first."""
    return scores.orderBy(
        F.desc("consumption_readiness_score"), *SCOPED_KEY, "full_table_name"
    )


def cr_tables(scores: DataFrame, params: ScanParams) -> DataFrame:
    """Consumption-ready tables: those whose rounded score reaches the threshold."""
    return scores.where(
        F.col("consumption_readiness_score") >= params.cr_threshold
    ).select(*SCOPED_KEY).distinct()


def with_cr_flag(scores: DataFrame, params: ScanParams) -> DataFrame:
    """One row per scope and table, with its rows, reads and whether it is consumption-ready.

    Letter-case variants of one table share the flag: if one passes, all its reads count.
    """
    ready = F.col("consumption_readiness_score") >= params.cr_threshold
    return scores.groupBy(*SCOPED_KEY).agg(
        F.count("*").alias("n_rows"),
        F.sum("analytical_reads").alias("reads"),
        F.bool_or(ready).alias("is_cr"),
    )
