"""Reads counted day by day as the logs arrive, so that a scan need not read them again.

A scan looks at the same dates as the scan before it but one. A stream follows the three logs;
whenever rows arrive, it finds the dates whose reads they change and counts those dates anew
from the logs. What is kept of a date are partial facts that add up over dates: how often a
table was read at each latency, by each user and through each tool, apart by the date of the
query's own log row, and a histogram of the latencies. A scan adds up the histograms of its
dates, finds the buckets that hold a table's median, and refines those from the latencies.

Nothing is too late: a row that arrives after its date was counted replaces that date's facts,
whatever the time between a query and its accesses. Counting a date twice gives the same facts,
so a batch that is repeated after a failure does no harm. Facts carry a stamp of the parameters
that shaped them, and a scan adds up facts of its own stamp only. The window may move forward
from scan to scan, not back: a date is counted with queries logged since the window's start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablegauge.operators.reads import (
    BUCKET, LATENCY, NAME, bucket_counts, read_facts, reads_joined, summarise_buckets,
)
from tablegauge.params import ScanParams
from tablegauge.sources.relations import LOG_DATE, Relations, in_dates

#: The parameters that decide which reads there are and how they are labelled.
SHAPING = ("sample_pct", "single_scope", "service_user_type", "internal_tables", "hosted_clients")
#: Kind of fact that counts the latencies of a bucket together.
HISTOGRAM = "histogram"
#: Dates on which a read's access and its query were logged; facts are stored by (day, fact).
DAY, QUERY_DAY = "day", "query_day"
FACT_COLUMNS = (f"{QUERY_DAY} date, {NAME} string, label string, {BUCKET} int, ms double, n long, "
                f"{DAY} date, fact string")


def stamp(params: ScanParams) -> str:
    """Names the facts that scans with these parameters share; thresholds play no part in it."""
    values = [getattr(params, name) for name in SHAPING]
    return hashlib.md5(repr(values).encode()).hexdigest()


def dated_facts(logs: Relations, params: ScanParams) -> DataFrame:
    """Facts and histograms of all reads since the window's start, by the dates of both rows."""
    reads = reads_joined(
        logs["access_history"], logs["query_history"], logs["sessions"], params,
        days=True, open_end=True)
    facts = read_facts(reads, DAY, QUERY_DAY)
    # The test on n is one on the bucket that stays above the grouping, which both parts share.
    latencies = facts.where("if(bucket < 0, 0, n) > 0")
    histogram = latencies.groupBy(DAY, QUERY_DAY, NAME, BUCKET).agg(F.sum("n").alias("n"))
    return facts.unionByName(
        histogram.withColumn("fact", F.lit(HISTOGRAM)), allowMissingColumns=True)


def arrivals(streams: Relations) -> DataFrame:
    """Rows of the three log streams as (kind, id, seen): what is needed to find their dates."""
    def rows(log: str, kind: str, key: str, seen: Column) -> DataFrame:
        return streams[log].select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"),
            seen.cast("timestamp_ntz").alias("seen"))

    return (
        rows("access_history", "access", "query_id", F.col("query_start_time"))
        .unionByName(rows("query_history", "query", "query_id", F.lit(None)))
        .unionByName(rows("sessions", "session", "session_id", F.lit(None)))
    )


def changed_days(new: DataFrame, logs: Relations, params: ScanParams) -> list[str]:
    """Dates since the window's start whose reads are changed by new log rows.

    ``new`` is a batch of :func:`arrivals`. An access row changes its own date. A query or
    session row changes the dates of the accesses it belongs to, which are looked up by id, but
    among the dates only that no new access changes anyway: when there are none, no log is joined.
    The result has at most one entry per date.
    """
    def ids(kind: str) -> DataFrame:
        return new.where(F.col("kind") == kind).select("id").distinct()

    def days(rows: DataFrame, seen: str) -> list:
        return [row[DAY] for row in rows.select(F.to_date(seen).alias(DAY)).distinct().collect()]

    own = days(in_dates(
        new.where(F.col("kind") == "access"), "seen", params, open_end=True), "seen")
    accesses = _of_days(
        in_dates(logs["access_history"], "query_start_time", params, open_end=True), own, False)
    if accesses.isEmpty():
        return sorted(map(str, own))
    new = new.persist()
    try:
        queries = in_dates(logs["query_history"], "start_time", params, open_end=True)
        named = queries.join(ids("session"), F.col("session_id") == F.col("id"), "left_semi")
        touched = ids("query").unionByName(named.select(F.col("query_id").alias("id")).distinct())
        found = accesses.join(touched, F.col("query_id") == F.col("id"), "left_semi")
        return sorted(map(str, own + days(found, "query_start_time")))
    finally:
        new.unpersist()


def _of_days(access: DataFrame, days: list, inside: bool) -> DataFrame:
    """Accesses of the given dates, or of all others; a log laid out by date is pruned."""
    dates = [F.lit(str(day)).cast("date") for day in days]
    for column in (F.to_date("query_start_time"), *(
            [F.col(LOG_DATE)] if LOG_DATE in access.columns else [])):
        access = access.where(column.isin(dates) if inside else ~column.isin(dates))
    return access


def store_days(logs: Relations, days: list[str], folder: str, params: ScanParams) -> None:
    """Count the given dates from the logs and replace their facts."""
    if not days:
        return
    facts = dated_facts({
        "access_history": _of_days(logs["access_history"], days, True),
        "query_history": logs["query_history"], "sessions": logs["sessions"]}, params)
    # Ranges keep a table's facts together, yet split a table of any size by its buckets.
    key = (DAY, "fact", NAME, BUCKET)
    (
        facts.repartitionByRange(*key).sortWithinPartitions(*key)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY, "fact").parquet(_path(folder, params))
    )


def keep_daily_facts(
    streams: Relations, logs: Callable[[], Relations], folder: str, params: ScanParams
) -> StreamingQuery:
    """Bring the facts in ``folder`` up to date with the logs, then stop. To be run on a schedule.

    ``streams`` are the logs as streams, ``logs`` opens them as tables; a table must show every
    file that its stream has shown.
    """
    def count(new: DataFrame, batch: int) -> None:
        tables = logs()
        store_days(tables, changed_days(new, tables, params), folder, params)

    return (
        arrivals(streams).writeStream.foreachBatch(count)
        .option("checkpointLocation", f"{folder}/{stamp(params)}/progress")
        .trigger(availableNow=True).start()
    )


def _path(folder: str, params: ScanParams) -> str:
    return f"{folder}/{stamp(params)}/facts"


def stored_facts(spark: SparkSession, folder: str, params: ScanParams) -> DataFrame:
    """The stored facts of the scan's window; none before any date has been counted."""
    try:
        facts = spark.read.schema(FACT_COLUMNS).parquet(_path(folder, params))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        facts = spark.createDataFrame([], FACT_COLUMNS)
    return reduce(lambda df, day: df.where(F.col(day).between(
        F.lit(str(params.window_start)).cast("date"), F.lit(str(params.today)).cast("date"))),
        (DAY, QUERY_DAY), facts)


def reads_per_table(spark: SparkSession, folder: str, params: ScanParams) -> DataFrame:
    """Reads per table of the window from stored facts alone; no log is opened.

    Users and tools are counted once however many dates they occur on. Latencies are read to
    refine the buckets with a median; all else comes from histograms and labels.
    """
    facts = stored_facts(spark, folder, params)
    labels = facts.where(F.col("fact").isin("user", "app")).groupBy(
        NAME, "fact", "label", BUCKET).agg(F.sum("n").alias("n"))
    histogram = facts.where(F.col("fact") == HISTOGRAM).groupBy(NAME, BUCKET).agg(
        F.sum("n").alias("n")).withColumn("fact", F.lit(LATENCY))
    buckets = bucket_counts(labels.unionByName(histogram, allowMissingColumns=True))
    latencies = facts.where(F.col("fact") == LATENCY).select(NAME, BUCKET, "ms", "n")
    return summarise_buckets(buckets, latencies, params)
