"""Report data of stored runs: stages, bands, texts, peers and opportunities."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge import constants as K
from tablegauge.functions import bands


def dimension_scores(runs: DataFrame) -> DataFrame:
    """One row per run and dimension, with the dimension's display name."""
    named = runs.select("run_id", *[
        F.coalesce(column, F.lit(0.0)).alias(dimension)
        for dimension, column in K.DIMENSION_COLUMNS.items()
    ])
    return named.unpivot(["run_id"], list(K.DIMENSION_COLUMNS), "dimension", "score")


def dimension_interpretation(runs: DataFrame) -> DataFrame:
    """What each dimension's score means, with its stage and colour band."""
    score = F.col("score")
    text = F.lit(None).cast("string")
    for dimension in K.DIMENSION_TEXTS:
        is_this = F.col("dimension") == dimension
        text = F.when(is_this, bands.dimension_text(dimension, score)).otherwise(text)
    return dimension_scores(runs).select(
        "run_id", "dimension", "score", bands.score_band(score).alias("band"),
        text.alias("interpretation"),
    )


def peer_medians(spark: SparkSession) -> DataFrame:
    """The fixed table of peer medians: dimensions x peers, 50 rows."""
    rows = [
        (dimension, peer, median)
        for dimension, medians in K.PEER_MEDIANS.items()
        for peer, median in zip(K.PEERS, medians)
    ]
    return spark.createDataFrame(rows, "dimension string, peer string, peer_median double")


def axis_max() -> Column:
    """Common end of all five scales of a run: its best score or the best peer's, rounded up."""
    own = [F.round(F.coalesce(c, F.lit(0.0)), 1) for c in K.DIMENSION_COLUMNS.values()]
    best_peer = max(chain.from_iterable(K.PEER_MEDIANS.values()))
    return F.ceil(F.greatest(F.lit(best_peer), *own))


def axis_position(value: Column, end: Column) -> Column:
    """Place of a value on the scale, in percent, kept within it."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value / end * 100))


def peer_comparison(runs: DataFrame, digits: int | None = None) -> DataFrame:
    """Each run's scores beside the medians of its peers, with positions on a common scale.

    A run gives 50 rows, so the runs are spread over the tasks before they are multiplied, however
    few files they come from. ``digits`` rounds the positions.
    """
    def position(value: Column, end: Column) -> Column:
        place = axis_position(value, end)
        # Places lie within 0 and 100: a whole number and a division take a tenth of round()'s time.
        return place if digits is None else F.floor(place * 10 ** digits + 0.5) / 10.0 ** digits

    ends = runs.select("run_id", axis_max().alias("axis_max"), *[
        F.round(F.coalesce(column, F.lit(0.0)), 1).alias(dimension)
        for dimension, column in K.DIMENSION_COLUMNS.items()
    ]).repartition("run_id")
    own = ends.select("run_id", "axis_max", F.inline(F.array(*[
        F.struct(F.lit(dimension).alias("dimension"), F.col(dimension).alias("score"))
        for dimension in K.DIMENSION_COLUMNS
    ])))
    peers = F.broadcast(peer_medians(runs.sparkSession))  # 50 fixed rows
    end = F.col("axis_max")
    placed = own.withColumn("score_pos", position(F.col("score"), end))
    return placed.join(peers, "dimension").select(
        "run_id", "dimension", "axis_max", "score", "score_pos", "peer", "peer_median",
        position(F.col("peer_median"), end).alias("peer_pos"),
    )


def report_opportunities(items: DataFrame) -> DataFrame:
    """The first items of every run, under their display tag."""
    order = Window.partitionBy("run_id").orderBy("item_rank", "item_type", "target")
    return items.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= K.MAX_REPORT_ITEMS
    ).select(
        "run_id", "position", bands.item_tag(F.col("item_type")).alias("tag"),
        "target", "detail", "recommendation",
    )


def report_payload(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Everything a report of a run shows, one row per stored run."""
    opportunities = report_opportunities(items).groupBy("run_id").agg(
        F.sort_array(F.collect_list(
            F.struct("position", "tag", "target", "detail", "recommendation")
        )).alias("opportunities")  # at most MAX_REPORT_ITEMS per run
    )
    score = F.coalesce("ai_readiness", F.lit(0.0))
    gap = F.coalesce("gap", F.lit("BUILD_CR_TABLES"))
    sample = F.when(
        F.col("sample_pct") > 0, F.concat(F.col("sample_pct").cast("string"), F.lit("% sample"))
    ).otherwise("Full scan")
    dimensions = F.array(*[
        F.struct(
            F.lit(dimension).alias("dimension"),
            F.round(F.coalesce(column, F.lit(0.0)), 1).alias("score"),
            bands.dimension_text(dimension, F.coalesce(column, F.lit(0.0))).alias("text"),
        )
        for dimension, column in K.DIMENSION_COLUMNS.items()
    ])
    return runs.join(opportunities, "run_id", "left").select(
        "run_id",
        F.substring("run_id", 1, 8).alias("run_short"),
        F.date_format("run_ts", "yyyy-MM-dd").alias("run_date"),
        "account_name", "role_name",
        F.coalesce("database_filter", F.lit("All databases")).alias("database_filter"),
        sample.alias("sample_label"),
        score.alias("ai_readiness"),
        bands.score_stage(score).alias("stage"),
        bands.stage_title(score).alias("stage_title"),
        bands.score_band(score).alias("band"),
        F.coalesce("n_cr_tables", F.lit(0)).alias("n_cr_tables"),
        bands.gap_label(gap).alias("gap_label"),
        "recommendation_text",
        axis_max().alias("axis_max"),
        dimensions.alias("dimensions"),
        "opportunities",
    )
