"""From access logs to analytical reads per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.apps import application_name, bi_flag
from tablegauge.functions.names import (
    TABLE_KEY, in_scope, is_complete, is_one_of, sampled, with_name_parts,
)
from tablegauge.params import ScanParams
from tablegauge.sources.relations import in_dates

#: A scored table: its identity and the name as logged, so letter-case variants stay apart.
READ_KEY = (*TABLE_KEY, "full_table_name")
#: What is counted about a table: a latency, a user or a BI tool. The logged name stands for
#: the whole identity, so rows stay narrow and names are split once per table, not per read.
NAME = "full_table_name"
FACT_KEY = (NAME, "fact", "label", "ms")

#: Latency buckets per unit of ln(1 + ms). A bucket spans 0.1% of its latency, so even a
#: table with a third of all reads spreads over thousands of them.
BUCKETS_PER_LOG_UNIT = 1024
BUCKET, NO_BUCKET = "bucket", -1
LATENCY = "latency"

#: Sessions that may count as hot, and the cells each of them is spread over.
MAX_HOT, SALTS = 1000, 64


def touched_objects(access: DataFrame, array: str) -> DataFrame:
    """One row per logged object of domain Table, with its name parts."""
    flat = access.select(
        "query_id", "user_name", "query_start_time",
        F.explode(array).alias("object"),
    )
    tables = flat.where(F.col("object.objectDomain") == "Table").select(
        "query_id", "user_name", "query_start_time",
        F.col("object.objectName").alias("full_table_name"),
    )
    return with_name_parts(tables)


def excluding_internal(reads: DataFrame, params: ScanParams) -> DataFrame:
    """Drop reads of the tables this library writes itself."""
    return reads.where(~is_one_of(params.internal_tables, "full_table_name"))


def table_reads(access: DataFrame, params: ScanParams) -> DataFrame:
    """Objects read by read-only statements, without incomplete and internal names."""
    read_only = access.where(F.array_size("objects_modified") == 0)
    reads = touched_objects(read_only, "base_objects_accessed").where(is_complete())
    return in_scope(excluding_internal(reads, params), "database_name", params)


def access_flatten(access: DataFrame, params: ScanParams, open_end: bool = False) -> DataFrame:
    """Table reads of read-only statements in the window: one row per (query, object)."""
    window = in_dates(access, "query_start_time", params, open_end)
    return table_reads(sampled(window, params), params)


def eligible_filter(queries: DataFrame, params: ScanParams) -> DataFrame:
    """Successful user SELECTs that ran on a warehouse for some time."""
    return queries.where(
        (F.col("query_type") == "SELECT")
        & F.col("error_code").isNull()
        & (F.col("execution_time") > 0)
        & F.col("warehouse_id").isNotNull()
        & ~F.col("is_client_generated_statement")
        & (F.col("user_type").isNull() | (F.col("user_type") != params.service_user_type))
    )


def eligible_queries(queries: DataFrame, params: ScanParams) -> DataFrame:
    """Eligible queries in the window."""
    return eligible_filter(in_dates(queries, "start_time", params), params)


def session_apps(sessions: DataFrame, params: ScanParams) -> DataFrame:
    """Application and BI flag per session."""
    named = sessions.select("session_id", application_name().alias("application_name"))
    return named.withColumn("is_bi_or_dashboard", bi_flag(params.hosted_clients))


def with_clients(timed: DataFrame, sessions: DataFrame, params: ScanParams) -> DataFrame:
    """Attach the client to queries; without a known session it is NULL.

    Sessions with more than ``hot_queries`` queries are found by count and spread over SALTS
    cells, and so are queries without a session, which match nothing. The list of hot sessions
    holds MAX_HOT at most, so it may be broadcast; a session beyond the largest MAX_HOT has less
    than one in MAX_HOT of all queries, so it is not hot whatever its count.
    """
    counts = timed.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count("*").alias("n"))
    largest = counts.where(F.col("n") > params.hot_queries).orderBy(F.desc("n"), "session_id")
    hot = F.broadcast(largest.limit(MAX_HOT).select("session_id", F.lit(True).alias("is_hot")))
    spread = F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")
    queries = timed.join(hot, "session_id", "left").withColumn(
        "salt", F.when(F.col("session_id").isNull() | F.col("is_hot"), spread).otherwise(0))
    salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0)))
    apps = session_apps(sessions, params).join(hot, "session_id", "left").withColumn(
        "salt", F.explode(salts))
    return queries.drop("is_hot").join(
        apps.drop("is_hot"), ["session_id", "salt"], "left").drop("salt")


def reads_joined(
    access: DataFrame, queries: DataFrame, sessions: DataFrame, params: ScanParams,
    days: bool = False, open_end: bool = False,
) -> DataFrame:
    """Analytical reads with their latency and client.

    Clients are classified on the session rows and attached to queries before the access
    log, the largest relation, is joined: it is shuffled once, by query_id. ``days`` adds the
    dates of the access and of the query; ``open_end`` keeps dates after the window.
    """
    dates = [F.to_date("start_time").alias("query_day")] if days else []
    timed = eligible_filter(in_dates(queries, "start_time", params, open_end), params).select(
        "query_id", "session_id", F.col("execution_time").alias("execution_time_ms"), *dates
    )
    clients = with_clients(timed, sessions, params)
    objects = access_flatten(access, params, open_end)
    if days:
        objects = objects.withColumn("day", F.to_date("query_start_time"))
    return objects.join(clients, "query_id").select(
        *READ_KEY, "query_id", "user_name", "execution_time_ms",
        "application_name", "is_bi_or_dashboard", *(("day", "query_day") if days else ()),
    )


def read_facts(reads: DataFrame, *by: str) -> DataFrame:
    """Counted (table, fact) pairs: a table's latencies, its users and its BI tools.

    One grouping covers the median and both distinct counts. It combines on the map side,
    and a hot table spreads over its facts instead of landing in one task. A read without a user
    or a BI tool gives no such fact. ``by`` adds grouping columns, such as the day.
    """
    def fact(kind: str, label: Column | None = None, ms: Column | None = None) -> Column:
        label = F.lit(None).cast("string") if label is None else label
        ms = F.lit(None).cast("double") if ms is None else ms
        return F.struct(F.lit(kind).alias("fact"), label.alias("label"), ms.alias("ms"))

    tool = F.when(F.col("is_bi_or_dashboard") == 1, F.col("application_name"))
    found = F.filter(
        F.array(fact(LATENCY, ms=F.col("execution_time_ms")),
                fact("user", label=F.col("user_name")), fact("app", label=tool)),
        lambda f: (f["fact"] == LATENCY) | f["label"].isNotNull())
    facts = reads.select(*by, NAME, F.inline(found)).groupBy(*by, *FACT_KEY).agg(
        F.count("*").alias("n"))
    # Never NULL, so that joining on it adds no filter below the grouping both sides share.
    bucket = F.floor(F.log1p("ms") * BUCKETS_PER_LOG_UNIT).cast("int")
    return facts.withColumn(BUCKET, F.coalesce(bucket, F.lit(NO_BUCKET)))


def bucket_counts(facts: DataFrame, *by: str) -> DataFrame:
    """Facts as counts per table and latency bucket; users and tools are in NO_BUCKET."""
    label, n = F.col("label"), F.col("n")
    return facts.groupBy(*by, NAME, BUCKET).agg(
        F.coalesce(F.sum(_of(LATENCY, n)), F.lit(0)).alias("in_bucket"),
        F.count(_of("user", label)).alias("users"),
        F.coalesce(F.sum(_of("app", n)), F.lit(0)).alias("apps_read"),
        F.count(_of("app", label)).alias("tools"),
    )


def _of(fact: str, value: Column) -> Column:
    return F.when(F.col("fact") == fact, value)


def reads_per_table(reads: DataFrame, params: ScanParams) -> DataFrame:
    """Reads, users, BI reads, BI tools and the exact interpolated median latency per table."""
    return summarise_facts(read_facts(reads), params)


def summarise_facts(facts: DataFrame, params: ScanParams) -> DataFrame:
    """Per-table counts and median latency from counted facts."""
    # The test on n keeps users and tools out of the shuffle to the join; one on the bucket alone
    # would move below the grouping and undo its reuse.
    return summarise_buckets(bucket_counts(facts), facts.where("if(bucket < 0, 0, n) > 0"), params)


def summarise_buckets(buckets: DataFrame, latencies: DataFrame, params: ScanParams) -> DataFrame:
    """Per-table counts and median latency from counts per bucket, refined by single latencies.

    The median of a group is found without holding the group: latency buckets are counted,
    the one or two buckets with the middle ranks are picked, and only their values are
    ranked. Tables below ``min_reads`` are left out. Counts of a bucket may come in parts, and a
    latency in several rows.
    """
    table = Window.partitionBy(NAME)
    running = table.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = buckets.select(
        NAME, BUCKET,
        F.sum("in_bucket").over(table).alias("analytical_reads"),
        F.sum("users").over(table).alias("distinct_users"),
        F.sum("apps_read").over(table).alias("app_reads"),
        F.sum("tools").over(table).alias("distinct_app_tools"),
        (F.sum("in_bucket").over(running) - F.col("in_bucket")).alias("before"),
        F.sum("in_bucket").over(running).alias("upto"),
    ).where(F.col("analytical_reads") >= params.min_reads)

    last = F.col("analytical_reads") - 1
    middle = ranked.withColumn("low", F.floor(last / 2)).withColumn("high", F.ceil(last / 2))
    middle = middle.where((F.col("before") <= F.col("high")) & (F.col("upto") > F.col("low")))

    in_bucket = Window.partitionBy(NAME, BUCKET).orderBy("ms").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    upto = F.col("before") + F.sum("n").over(in_bucket)
    values = (
        latencies.join(middle, [NAME, BUCKET])
        .withColumn("value_upto", upto)
        .withColumn("value_before", F.col("value_upto") - F.col("n"))
    )

    def at(rank: str) -> Column:
        holds = (F.col("value_before") <= F.col(rank)) & (F.col("value_upto") > F.col(rank))
        return F.max(F.when(holds, F.col("ms")))

    counts = ("analytical_reads", "distinct_users", "app_reads", "distinct_app_tools")
    return with_name_parts(values.groupBy(NAME).agg(
        *[F.max(c).alias(c) for c in counts],
        ((at("low") + at("high")) / 2).alias("p50_execution_ms"),
    ))
