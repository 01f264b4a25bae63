"""Run history, report data and probes."""

import datetime as dt
import math
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tablegauge import constants as K
from tablegauge.operators import history, probes, report
from tablegauge.plans import scan
from tablegauge.sources import schemas
from tablegauge.sources.derived import DerivedEstate
from tests.conftest import NOW, SMALL


def run(run_id, scope="D", days=0, **changes):
    return dict(run_id=run_id, run_ts=NOW - dt.timedelta(days=days), database_filter=scope,
                ai_readiness=12.0, demand_coverage=30.0, sv_readiness=5.0, sv_coverage=2.0,
                sv_quality=40.0, n_cr_tables=1, gap="BUILD_SVS") | changes


def item(run_id, rank, kind="SCHEMA_GAP"):
    return dict(run_id=run_id, item_rank=rank, item_type=kind, target=f"t{rank}")


@pytest.fixture
def frame(spark):
    def build(schema, *records):
        data = [tuple(r.get(f) for f in schema.fieldNames()) for r in records]
        return spark.createDataFrame(data, schema)
    return build


def test_saving_adds_runs_per_call(spark, params, tmp_path):
    folder = str(tmp_path)
    result = scan.full_scan(DerivedEstate(spark, SMALL), params)
    first = scan.save_scan(result, folder, params, "a")
    again = scan.save_scan(result, folder, params, "a")
    assert first.count() == 3  # two databases and the whole estate
    assert sorted(first.collect()) == sorted(again.collect())
    runs, items = history.load_runs(spark, folder), history.load_items(spark, folder)
    assert runs.count() == 3 and items.count() == result.items.count() > 0
    assert history.history_items(runs, items).count() == items.count()
    # Another call adds runs, be its scan the same one or not.
    other = scan.save_scan(result, folder, params)
    assert not {r.run_id for r in other.collect()} & {r.run_id for r in first.collect()}
    assert history.load_runs(spark, folder).count() == 6
    later = scan.save_scan(result, folder, params.with_(sample_pct=30, account_name="b"), "b")
    assert {(r.sample_pct, r.account_name) for r in later.collect()} == {(30, "b")}
    assert history.load_items(spark, folder).count() == 3 * items.count()


def test_only_committed_attempts_are_read(spark, frame, tmp_path):
    folder = str(tmp_path)
    runs = frame(schemas.SCAN_RUNS, run("a"))
    items = frame(schemas.SCAN_IMPROVEMENT_ITEMS, item("a", 1))
    assert history.load_runs(spark, folder).count() == 0
    # A writer that died before its commit has left rows of both tables.
    for table, rows in ((history.RUNS, runs), (history.ITEMS, items)):
        rows.write.parquet(f"{folder}/{table}/call_id=x/attempt=dead")
    assert history.load_runs(spark, folder).count() == history.load_items(spark, folder).count() == 0
    assert history.append_history(runs, items, folder, "x")
    assert not history.append_history(runs, items, folder, "x")
    assert history.load_runs(spark, folder).count() == history.load_items(spark, folder).count() == 1
    # Two attempts of one call that did not see each other: the first commit counts, for both tables.
    later = frame(schemas.SCAN_RUNS, run("later"))
    later.write.parquet(f"{folder}/{history.RUNS}/call_id=x/attempt=zz")
    spark.sql("select timestamp '2999-01-01' as committed_at").write.parquet(
        f"{folder}/{history.COMMITS}/call_id=x/attempt=zz")
    assert [r.run_id for r in history.load_runs(spark, folder).collect()] == ["a"]
    with pytest.raises(ValueError):
        history.append_history(runs, items, folder, "../x")


def test_writers_at_the_same_time(spark, frame, tmp_path):
    folder = str(tmp_path)

    def save(number):
        call = str(number % 4)  # every call is made twice
        return history.append_history(
            frame(schemas.SCAN_RUNS, run(call)),
            frame(schemas.SCAN_IMPROVEMENT_ITEMS, item(call, 1), item(call, 2)), folder, call)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(save, range(8)))
    assert sorted(r.run_id for r in history.load_runs(spark, folder).collect()) == list("0123")
    assert history.load_items(spark, folder).count() == 8


def test_one_call_reads_its_own_partition(spark, frame, tmp_path):
    folder = str(tmp_path)
    for call in "ab":
        history.append_history(
            frame(schemas.SCAN_RUNS, run(call)), frame(schemas.SCAN_IMPROVEMENT_ITEMS), folder, call)
    one = history.load_runs(spark, folder, "b")
    assert [r.run_id for r in one.collect()] == ["b"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("PartitionFilters: [isnotnull(call_id#") > 0


def test_runs_are_read_by_scope_newest_first(frame):
    runs = frame(schemas.SCAN_RUNS, run("a", days=2), run("b", days=1), run("c", "E"),
                 run("d", "All databases"))
    assert [r.run_id for r in history.history_runs(runs, "D").collect()] == ["b", "a"]
    assert history.history_runs(runs, "All databases").count() == 4  # no filter at all
    assert {r.run_id for r in history.history_latest(runs).collect()} == {"b", "c", "d"}


def test_trend(frame, params):
    runs = frame(schemas.SCAN_RUNS, run("a", days=2), run("b", days=1))
    got = history.history_trend(runs, params).collect()
    assert [(r.run_id, r.measure, r.value) for r in got[:3]] == [
        ("a", "ai_readiness", 12.0), ("a", "demand_coverage", 30.0), ("a", "sv_readiness", 5.0)]
    assert {r.healthy_threshold for r in got} == {70.0} and len(got) == 6


def test_opportunities_are_the_first_fifteen(frame):
    items = frame(schemas.SCAN_IMPROVEMENT_ITEMS, *[item("a", i) for i in range(20, 0, -1)],
                  item("b", 1, "OTHER"))
    got = report.report_opportunities(items).orderBy("run_id", "position").collect()
    assert [r.target for r in got if r.run_id == "a"] == [f"t{i}" for i in range(1, 16)]
    assert (got[0].tag, got[-1].tag) == ("Low CR coverage", "OTHER")


def test_peer_comparison(frame):
    runs = frame(schemas.SCAN_RUNS, run("low"), run("high", demand_coverage=99.96))
    got = report.peer_comparison(runs).collect()
    assert len(got) == 2 * 5 * 10
    low = [r for r in got if r.run_id == "low"]
    assert {r.axis_max for r in low} == {40}  # its own 40.0, above the best peer's 27.1
    assert {r.axis_max for r in got if r.run_id == "high"} == {100}
    demand = [r for r in low if r.dimension == "Demand Coverage"]
    assert {(r.score, r.score_pos) for r in demand} == {(30.0, 75.0)}
    telecom = next(r for r in demand if r.peer == "Telecom")
    assert telecom.peer_median == 24.4 and telecom.peer_pos == pytest.approx(61.0)


def test_payload_of_a_run_without_items_and_scores(frame):
    runs = frame(schemas.SCAN_RUNS, run("bare-run-id", "D", ai_readiness=None, gap=None,
                                        n_cr_tables=None, sv_quality=None), run("b", sample_pct=30))
    items = frame(schemas.SCAN_IMPROVEMENT_ITEMS, item("b", 2), item("b", 1))
    got = {r.run_id: r for r in report.report_payload(runs, items).collect()}
    bare, full = got["bare-run-id"], got["b"]
    assert (bare.run_short, bare.stage, bare.band, bare.n_cr_tables, bare.opportunities,
            bare.sample_label) == ("bare-run", 1, "low", 0, None, "Full scan")
    assert bare.gap_label == K.GAP_LABELS["BUILD_CR_TABLES"]
    assert full.sample_label == "30% sample" and full.run_date == "2024-01-31"
    assert [o.target for o in full.opportunities] == ["t1", "t2"]
    assert [d.dimension for d in full.dimensions] == list(K.DIMENSION_COLUMNS)


def test_probes(spark):
    table = spark.createDataFrame(
        [(3, "a"), (1, "b"), (1, "b"), (None, "c"), (2, None)], "k int, v string")
    assert probes.probe_count(table).first().n == 5
    assert [r.k for r in probes.probe_topk(table, 2).collect()] == [1, 1]
    assert [r.k for r in probes.probe_topk(table, 2, descending=True).collect()] == [None, 3]
    assert probes.probe_limit(table, 4).count() == 4
    assert probes.probe_distinct_rows(table).first().n_distinct == 2  # rows with NULL are skipped
    assert probes.probe_distinct_rows(table, 0).first().n_distinct == 0
    many = spark.range(10_000)
    share = probes.probe_sample(many).count() / 10_000
    assert math.isclose(share, 0.5, abs_tol=0.05)
    tier = probes.table_size_tier("t", table).first()
    assert (tier.table_name, tier.n, tier.tier, tier.n_probes) == ("t", 5, "small", 3)


def test_a_database_named_like_a_number_keeps_its_name(spark, frame, tmp_path):
    runs = frame(schemas.SCAN_RUNS, run("a", "007"))
    history.append_history(runs, frame(schemas.SCAN_IMPROVEMENT_ITEMS), str(tmp_path), "c")
    assert history.load_runs(spark, str(tmp_path)).select(F.first("database_filter")).first()[0] == "007"
