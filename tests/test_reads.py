"""Access logs to reads per table, at the edges and under skew."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablegauge.functions.apps import application_name, bi_flag
from tablegauge.functions.names import with_name_parts
from tablegauge.functions.ranks import with_percent_ranks
from tablegauge.operators import consumption, reads
from tests.conftest import NOW


def touch(name, domain="Table"):
    return {"objectName": name, "objectDomain": domain}


def access(query, *objects, at=NOW, user="u", modified=()):
    return dict(query_id=query, user_name=user, query_start_time=at,
                base_objects_accessed=list(objects),
                objects_modified=None if modified is None else list(modified))


def ran(query, ms=100.0, **changes):
    return dict(query_id=query, session_id="s", query_type="SELECT", execution_time=ms,
                warehouse_id="w", is_client_generated_statement=False, start_time=NOW) | changes


def names(frame):
    return sorted(r.full_table_name for r in frame.collect())


def test_name_parts(spark):
    frame = spark.createDataFrame([("a.b.c",), ("a.b",), ("a..c.d",)], "full_table_name string")
    got = [tuple(r)[1:] for r in with_name_parts(frame).collect()]
    assert got == [("A", "B", "C"), ("A", "B", ""), ("A", "", "C")]


def test_what_counts_as_a_read(rows, params):
    log = rows(
        "access_history",
        access("1", touch("d.s.ok"), touch("d.s.view", "View"), touch("d.s"), touch("d..t")),
        access("2", touch("d.s.written"), modified=[touch("d.s.x")]),
        access("3", touch("d.s.unknown"), modified=None),
        access("4"),
        access("5", touch("TableGauge.public.scan_runs"), touch("tablegauge.public.scan_runs2"),
               touch("tablegauge.public.SCAN_IMPROVEMENT_ITEMS.x")),
        access("6", touch("d.s.lower", "table")),
    )
    assert names(reads.access_flatten(log, params)) == ["d.s.ok", "tablegauge.public.scan_runs2"]


def test_window_has_eight_whole_dates(rows, params):
    def at(day, clock="00:00:00"):
        return dt.datetime.fromisoformat(f"2024-{day} {clock}")
    log = rows(
        "access_history",
        access("1", touch("d.s.before"), at=at("01-23", "23:59:59")),
        access("2", touch("d.s.first"), at=at("01-24")),
        access("3", touch("d.s.last"), at=at("01-31", "23:59:59")),
        access("4", touch("d.s.after"), at=at("02-01")),
    )
    assert names(reads.access_flatten(log, params)) == ["d.s.first", "d.s.last"]


def test_scope_limits_to_one_database(rows, params):
    log = rows("access_history", access("1", touch("d.s.t"), touch("e.s.t")))
    assert names(reads.access_flatten(log, params.with_(scope="D"))) == ["d.s.t"]
    assert names(reads.access_flatten(log, params.with_(scope="All databases"))) == [
        "d.s.t", "e.s.t"]


def test_sample_keeps_whole_queries_and_about_its_share(rows, params):
    log = rows("access_history", *[
        access(str(i), touch("d.s.a"), touch("d.s.b")) for i in range(2000)])
    kept = reads.access_flatten(log, params.with_(sample_pct=30))
    per_query = kept.groupBy("query_id").count().collect()
    assert {r["count"] for r in per_query} == {2}
    assert 500 < len(per_query) < 700
    assert reads.access_flatten(log, params.with_(sample_pct=0)).count() == 4000


@pytest.mark.parametrize("changes, kept", [
    ({}, True), ({"query_type": "INSERT"}, False), ({"error_code": "1"}, False),
    ({"execution_time": 0.0}, False), ({"execution_time": None}, False),
    ({"warehouse_id": None}, False), ({"is_client_generated_statement": True}, False),
    ({"is_client_generated_statement": None}, False), ({"user_type": "PERSON"}, True),
    ({"user_type": "PLATFORM_SERVICE"}, False),
    ({"start_time": NOW - dt.timedelta(days=8)}, False),
])
def test_eligible_queries(rows, params, changes, kept):
    log = rows("query_history", ran("1") | changes)
    assert reads.eligible_queries(log, params).count() == kept


@pytest.mark.parametrize("name, is_bi", [
    ("Looker 24.1", 1), ("x TABLEAU 2024 Prep y", 1), ("Microsoft Power BI", 1),
    ("sisuXdata", 1), ("Sigma Σ", 1), ("sigma Σ", None), ("M", 1), ("m", None), ("MM", None),
    ("streamlit", 1), ("Streamlit", None), ("PythonConnector", None), (None, None),
])
def test_bi_flag(spark, name, is_bi):
    frame = spark.createDataFrame([(name,)], "application_name string")
    assert frame.select(bi_flag().alias("r")).first().r == is_bi


@pytest.mark.parametrize("name, is_bi", [
    ("Web App (desk_board)", 1), ("web app (DESK_BOARD)", 1), ("Web App (deskXboard)", None),
    ("A Web App (desk_board)", None), ("Web App (desk_board) 1", None), ("DESKCLI.1", 1),
    ("xdeskcli", None), ("Qlik", 1), (None, None),
])
def test_hosted_clients_are_named_by_the_caller(spark, name, is_bi):
    frame = spark.createDataFrame([(name,)], "application_name string")
    flag = bi_flag((r"Web App (desk\_board)", "deskcli%"))
    assert frame.select(flag.alias("r")).first().r == is_bi


def test_application_name_of_broken_json_is_unknown(spark):
    frame = spark.createDataFrame(
        [('{"APPLICATION": "a"}',), ("{bad",), ("{}",), (None,)], "client_environment string")
    assert [r[0] for r in frame.select(application_name()).collect()] == ["a", None, None, None]


def test_min_reads_and_letter_case(rows, params):
    log = rows("access_history", *(
        [access(str(i), touch("d.s.four")) for i in range(4)]
        + [access(str(i), touch("d.s.five"), touch("D.S.Five")) for i in range(5)]))
    queries = rows("query_history", *[ran(str(i), ms=float(i + 1)) for i in range(5)])
    sessions = rows("sessions", dict(session_id="s", client_environment='{"APPLICATION": "M"}'))
    joined = reads.reads_joined(log, queries, sessions, params)
    got = {r.full_table_name: r for r in reads.reads_per_table(joined, params).collect()}
    assert set(got) == {"d.s.five", "D.S.Five"}
    five = got["d.s.five"]
    assert (five.table_name, five.analytical_reads, five.distinct_users, five.app_reads,
            five.distinct_app_tools, five.p50_execution_ms) == ("FIVE", 5, 1, 5, 1, 3.0)


def _random_reads(spark, seed, tables, spread):
    rng = random.Random(seed)
    data = []
    for t, n in enumerate(tables):
        for _ in range(n):
            app = rng.choice([None, "M", "Looker", "python"])
            data.append(("D", "S", f"T{t}", f"d.s.t{t}", rng.choice([None, "a", "b", "c"]),
                         rng.uniform(*spread), app, 1 if app in ("M", "Looker") else None))
    return spark.createDataFrame(
        data, "database_name string, schema_name string, table_name string,"
        " full_table_name string, user_name string, execution_time_ms double,"
        " application_name string, is_bi_or_dashboard int"), data


@pytest.mark.parametrize("spread", [(0.001, 5e6), (100.0, 100.05), (7.0, 7.0)])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, params, seed, spread):
    """One table holds most reads; latencies may all fall in one bucket, or be equal."""
    frame, data = _random_reads(spark, seed, [900, 5, 6, 7, 40, 4], spread)
    got = {r.table_name: r for r in reads.reads_per_table(frame, params).collect()}
    assert set(got) == {f"T{t}" for t in range(5)}
    for name, row in got.items():
        mine = [d for d in data if d[2] == name]
        assert row.analytical_reads == len(mine)
        assert row.p50_execution_ms == pytest.approx(statistics.median(d[5] for d in mine))
        assert row.distinct_users == len({d[4] for d in mine} - {None})
        assert row.app_reads == sum(d[7] == 1 for d in mine)
        assert row.distinct_app_tools == len({d[6] for d in mine if d[7]})


@pytest.mark.parametrize("most", [0, 1000])  # in cells, and with the values sent to the rows
def test_percent_ranks_equal_the_window(spark, most):
    rng = random.Random(3)
    data = [("one", 5, 0), ("tied", 4, 0), ("tied", 4, 1)] + [
        ("big", rng.randint(1, 30), rng.choice([0, 0, 0, 7])) for _ in range(500)]
    frame = spark.createDataFrame(data, "scope string, v long, w long")
    got = with_percent_ranks(frame, "scope", {"v": "r", "w": "s"}, most)
    want = frame.selectExpr(
        "*", "percent_rank() over (partition by scope order by v) as r",
        "percent_rank() over (partition by scope order by w) as s")
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_table_rows_stay_where_they_are_for_their_ranks(spark, params):
    ranked = consumption.cr_percent_ranks(_inputs(spark, *range(5, 60)), params)
    assert "Exchange hashpartitioning" not in ranked._jdf.queryExecution().executedPlan().toString()


def _client_sizes(spark, frame):
    """Rows of every task that joins clients to queries."""
    return [r.n for r in frame.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("hot", ["s7", None])
def test_a_hot_session_is_spread(spark, params, hot):
    """A third of the queries is of one session, or of none."""
    timed = spark.range(60_000).select(
        F.col("id").cast("string").alias("query_id"),
        F.when(F.col("id") % 3 == 0, F.lit(hot))
        .otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("session_id"))
    sessions = spark.range(400).select(
        F.concat(F.lit("s"), "id").alias("session_id"),
        F.lit('{"APPLICATION": "M"}').alias("client_environment"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        got = reads.with_clients(timed, sessions, params.with_(hot_queries=1000))
        sizes = _client_sizes(spark, got)
        assert sum(sizes) == 60_000 and max(sizes) <= 2 * statistics.median(sizes)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    known = {f"s{i}" for i in range(400)}
    rows = got.groupBy("session_id", "application_name", "is_bi_or_dashboard").count().collect()
    assert all((r.application_name, r.is_bi_or_dashboard) == (
        ("M", 1) if r.session_id in known else (None, None)) for r in rows)
    assert sum(r["count"] for r in rows) == 60_000


def _inputs(spark, *counts):
    data = [("D", "S", f"T{i}", f"d.s.t{i}", n, n, n, 1, 1.0, 0) for i, n in enumerate(counts)]
    return spark.createDataFrame(
        data, "database_name string, schema_name string, table_name string,"
        " full_table_name string, analytical_reads long, distinct_users long, app_reads long,"
        " distinct_app_tools long, p50_execution_ms double, days_since_update int")


@pytest.mark.parametrize("counts", [(50,), (50, 50, 50)])
def test_a_single_table_or_all_tied_cannot_be_ready(spark, params, counts):
    scores = consumption.score_tables(
        consumption.cr_percent_ranks(_inputs(spark, *counts), params))
    assert {r.activity_score for r in scores.collect()} == {0.0}
    assert scores.agg(F.max("consumption_readiness_score")).first()[0] <= 0.0113


def test_ranks_of_one_scope_equal_a_scan_of_that_database(spark, params):
    both = _inputs(spark, 5, 7, 9).unionByName(
        _inputs(spark, 6, 8).withColumn("database_name", F.lit("E")))
    whole = consumption.score_tables(consumption.cr_percent_ranks(both, params))
    alone = consumption.score_tables(consumption.cr_percent_ranks(
        both.where("database_name = 'E'"), params.with_(scope="E")))
    mine = whole.where("scope = 'E'")
    assert mine.exceptAll(alone).isEmpty() and alone.exceptAll(mine).isEmpty()
    assert whole.where("scope = 'All databases'").count() == 5


def test_table_ages(rows, params):
    def table(name, days, **changes):
        return dict(table_catalog="d", table_schema="s", table_name=name,
                    table_type="BASE TABLE", last_altered=NOW - dt.timedelta(days=days)) | changes
    got = consumption.table_ages(rows(
        "tables", table("a", 0), table("b", 60), table("c", 61), table("v", 1, table_type="VIEW"),
        table("x", 1, deleted=NOW)), params)
    assert {r.table_name: r.days_since_update for r in got.collect()} == {"A": 0, "B": 60}


def test_cr_threshold_applies_to_the_rounded_score(spark, params):
    data = [("all", "D", "S", f"T{i}", s) for i, s in enumerate((0.7999, 0.8))]
    scores = spark.createDataFrame(
        data, "scope string, database_name string, schema_name string, table_name string,"
        " consumption_readiness_score double")
    assert [r.table_name for r in consumption.cr_tables(scores, params).collect()] == ["T1"]
