"""The two logs as tables laid out by date and by query id.

A scan's window then reads only its own dates, and the access log, the largest relation, meets
its queries where it lies: both logs are cut into the same buckets by query id, so joining them
moves no access row, and no query row either while the sessions are small enough to broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.sources.relations import LOG_DATE, Estate
from tablegauge.sources.schemas import INPUTS, LOG_TIMES

#: Both logs are cut and sorted by it.
QUERY_ID = "query_id"
#: Rows of the larger log that one bucket holds at first; one task sorts and joins them.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: int, least: int = 1) -> int:
    """Buckets for logs of which the larger one has so many rows.

    A bucket is sorted by one task when it is written and joined by one when it is read, so their
    number follows the rows. Both logs, and all later appends, take the same number.
    """
    return max(least, -(-rows // BUCKET_ROWS))


def _declared(spark: SparkSession, root: str, name: str, buckets: int) -> str:
    """Name under which this session knows the table in ``root``/``name``."""
    path = f"{root}/{name}"
    table = f"tablegauge_{hashlib.md5(path.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in INPUTS[name].fields)
    spark.sql(
        f"create table if not exists {table} ({columns}, {LOG_DATE} date) using parquet "
        f"partitioned by ({LOG_DATE}) clustered by ({QUERY_ID}) sorted by ({QUERY_ID}) "
        f"into {buckets} buckets location '{path}'")
    return table


def append_log(df: DataFrame, root: str, name: str, buckets: int) -> None:
    """Append rows to a log. Every append to one log must name the same number of buckets.

    A task holds the rows of one bucket, so that a date has one file per bucket and append.
    """
    spark, columns = df.sparkSession, INPUTS[name].fields
    table = _declared(spark, root, name, buckets)
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])
    rows.withColumn(LOG_DATE, F.to_date(LOG_TIMES[name])).repartition(buckets, QUERY_ID).write.mode(
        "append").partitionBy(LOG_DATE).bucketBy(buckets, QUERY_ID).sortBy(QUERY_ID).format(
        "parquet").saveAsTable(table)


class StoredEstate(Estate):
    """An estate whose logs were written by :func:`append_log`; other relations are Parquet folders."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, absent: tuple[str, ...] = ()):
        super().__init__(spark, root, absent)
        self._buckets = buckets

    def __getitem__(self, name: str) -> DataFrame:
        if name not in LOG_TIMES or name not in self:
            return super().__getitem__(name)
        table = _declared(self._spark, self._root, name, self._buckets)
        self._spark.catalog.refreshTable(table)
        return self._spark.table(table)
