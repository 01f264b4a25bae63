"""Vectors that can be compared, equal ones once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import hashed, stored


def _usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def classes(
    rows: DataFrame, key: str, vector: str, ids: int
) -> tuple[DataFrame, DataFrame]:
    """(class, node, times, ids, vector) per different vector, and (id, class) per row.

    node is the least id of the class, ids its ``ids`` least ones. A row whose vector cannot be
    compared, has no id, or has another dimension than most has a null class. Ids are counted
    once even if their row is repeated.
    """
    wide = rows.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    usable = F.coalesce(_usable(F.col("vector")), F.lit(False)) & F.col("id").isNotNull()
    sizes = wide.filter(usable).groupBy(F.size("vector").alias("d")).count()
    most = sizes.orderBy(F.desc("count"), "d").first()
    dimension = most["d"] if most else -1
    wide = wide.withColumn("class", F.when(
        usable & (F.size("vector") == dimension),
        F.concat_ws(":", hashed(51, F.col("vector")), hashed(52, F.col("vector")))))
    every = stored(wide.select("id", "class"))
    members = every.filter("class is not null").distinct()
    least = members.groupBy("class").agg(
        F.min("id").alias("node"), F.count(F.lit(1)).alias("times"))
    found = (
        wide.filter("class is not null").groupBy("class").agg(F.first("vector").alias("vector"))
        .join(least, "class"))
    if ids > 1:
        found = found.join(_least_ids(members, ids), "class")
    else:
        found = found.withColumn("ids", F.array("node"))
    return stored(found), every


def _least_ids(members: DataFrame, ids: int) -> DataFrame:
    """The least ids of every class: of each of its slices first, so no class is gathered."""
    from pyspark.sql import Window

    def least(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("id")
        return df.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= ids).drop("k")

    sliced = members.withColumn("slice", F.pmod(hashed(53, F.col("id")), F.lit(64)))
    return least(least(sliced, "class", "slice"), "class").groupBy("class").agg(
        F.array_sort(F.collect_list("id")).alias("ids"))
