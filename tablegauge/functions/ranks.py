"""Percent ranks of counts within scopes of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.session import settle

#: Distinct values up to which they are sent to every task; a row is some 50 bytes.
MAX_BROADCAST = 200_000
#: Cells that the rows of one value are spread over beyond that.
SALTS = 32


def ladder(df: DataFrame, scope: str, values: tuple[str, ...]) -> DataFrame:
    """The distinct values of each measure and scope with their percent rank.

    Equal values are counted first and only the distinct ones are put in order: distinct counts
    that add up to R reads number at most sqrt(2 R), however many tables there are.
    """
    measures = F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("long").alias("value")) for v in values])
    steps = df.select(scope, F.inline(measures)).groupBy(scope, "measure", "value").agg(
        F.count("*").alias("ties"))
    everyone = Window.partitionBy(scope, "measure")
    running = everyone.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.sum("ties").over(running) - F.col("ties")
    others = F.sum("ties").over(everyone) - 1
    rank = F.when(others > 0, below / others).otherwise(0.0)
    return steps.select(scope, "measure", "value", rank.alias("rank"))


def with_percent_ranks(
    df: DataFrame, scope: str, ranks: dict[str, str], most: int = MAX_BROADCAST
) -> DataFrame:
    """Add percent_rank() over (partition by scope order by value) for each value: alias.

    A plain window would sort the whole estate in one task, and a join by value would put all
    tables that nobody uses into one. The distinct values of all measures are counted in one
    pass; while there are at most ``most``, they go to the rows, which stay where they are.
    Beyond that they are joined in cells, so that no value's rows meet in one task.
    """
    steps = settle(ladder(df, scope, tuple(ranks)))
    small = steps.count() <= most
    if not small:
        df = df.withColumn("_cell", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        steps = steps.withColumn(
            "_cell", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for value, alias in ranks.items():
        own = steps.where(F.col("measure") == value).drop("measure").withColumnsRenamed(
            {"value": value, "rank": alias})
        key = [c for c in own.columns if c != alias]
        df = df.join(F.broadcast(own) if small else own, key)
    return df.drop("_cell")
