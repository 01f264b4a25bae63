"""How queries run: what is read, shuffled and broadcast, and that nothing is collected."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tablegauge.operators import history, items, reads, report
from tablegauge.params import ScanParams
from tablegauge.plans import scan
from tablegauge.sources import stored_logs
from tablegauge.sources.derived import AS_OF, DerivedEstate
from tablegauge.sources.relations import Estate, write_log
from tablegauge.sources.schemas import LOG_TIMES
from tests.conftest import SMALL

PARAMS = ScanParams(AS_OF)
#: Queries whose plan stands for all others of their kind.
WHOLE = ("reads_per_table", "cr_scores", "sv_quality", "improvement_items", "composite_scores",
         "six_factor_portfolio", "report_payload", "peer_comparison", "probe_topk")


def plan(frame, run=False):
    if run:
        frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def estate(spark):
    return DerivedEstate(spark, SMALL)


@pytest.fixture(scope="module")
def stored(spark, estate, tmp_path_factory):
    """The estate's logs and small relations as Parquet folders."""
    root = str(tmp_path_factory.mktemp("estate"))
    write_log(estate["access_history"], "query_start_time", f"{root}/access_history")
    write_log(estate["query_history"], "start_time", f"{root}/query_history")
    for name in ("sessions", "tables"):
        estate[name].write.parquet(f"{root}/{name}")
    return Estate(spark, root)


@pytest.mark.parametrize("name", WHOLE)
def test_no_products_no_python_no_single_task_sorts(spark, name):
    text = plan(entry_points.queries()[name](spark, SMALL))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas|InArrow", text)
    # A single partition only ever holds a final count or a limit.
    for exchange in re.findall(r"Exchange SinglePartition.*\n.*", text):
        assert "partial_" in exchange or "Limit" in exchange


def test_logs_are_scanned_once_for_counts_and_median(estate):
    logs = [estate[name] for name in ("access_history", "query_history", "sessions")]
    frame = reads.reads_per_table(reads.reads_joined(*logs, PARAMS), PARAMS)
    final = plan(frame, run=True).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    assert final.count("FileScan parquet") == 3  # without the count of sessions, none of them hot


def test_only_needed_columns_and_dates_are_read(stored):
    text = plan(reads.reads_joined(
        stored["access_history"], stored["query_history"], stored["sessions"], PARAMS))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*", text)
    assert not any("query_type" in s and "base_objects_accessed" in s for s in scans)
    logs = [line for line in text.split("\n") if "FileScan" in line and "log_date" in line]
    assert len(logs) == 4  # queries per session are counted first, for either side of their join
    for line in logs:
        assert "PartitionFilters: [isnotnull(log_date" in line


def test_logs_in_buckets_are_joined_where_they_lie(spark, estate, tmp_path):
    root, buckets = str(tmp_path), 3
    for name in LOG_TIMES:
        for even in (True, False):  # two appends
            part = estate[name].where((F.xxhash64("query_id") % 2 == 0) == even)
            stored_logs.append_log(part, root, name, buckets)
    for name in ("sessions", "tables"):
        estate[name].write.parquet(f"{root}/{name}")
    kept = stored_logs.StoredEstate(spark, root, buckets)
    assert kept["access_history"].count() == estate["access_history"].count()
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:  # as if nothing were small
        spark.conf.set(threshold, "-1")
        joined = plan(reads.reads_joined(*[kept[n] for n in scan.LOGS[:3]], PARAMS))
    finally:
        spark.conf.set(threshold, before)
    logs = [line for line in joined.split("\n") if "FileScan" in line and "log_date" in line]
    assert logs and all("PartitionFilters: [isnotnull(log_date" in line for line in logs)
    access = next(line for line in logs if "base_objects_accessed" in line)
    assert "Bucketed: true" in access
    # The queries with their clients go to the buckets; the access log stays.
    assert len(re.findall(r"Exchange hashpartitioning\(query_id#\d+, 3\)", joined)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(query_id", joined)) == 1
    assert "SortMergeJoin [query_id" in joined
    one, two = scan.scores_of(kept, PARAMS), scan.scores_of(estate, PARAMS)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_buckets_follow_the_rows_of_the_logs(spark, estate, monkeypatch):
    assert [stored_logs.buckets_for(n, 4) for n in (0, 4_000_000, 4_000_001, 216_000_000)] == [
        4, 4, 5, 216]
    cut = []
    append = stored_logs.append_log
    monkeypatch.setattr(stored_logs, "BUCKET_ROWS", 700)
    monkeypatch.setattr(stored_logs, "append_log", lambda df, root, name, buckets: (
        cut.append(buckets), append(df, root, name, buckets)))
    scores = entry_points.queries()["cr_scores_stored"](spark, SMALL)
    assert cut == [-(-estate["access_history"].count() // 700)] * 2 and cut[0] > 4
    derived = scan.scores_of(estate, PARAMS)
    assert scores.exceptAll(derived).isEmpty() and derived.exceptAll(scores).isEmpty()


def test_stored_estate_scores_like_the_derived_one(stored, estate):
    one, two = scan.scores_of(stored, PARAMS), scan.scores_of(estate, PARAMS)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_logs_need_not_be_laid_out_by_date(spark, estate, tmp_path):
    for name in scan.LOGS:
        estate[name].write.parquet(f"{tmp_path}/{name}")
    plain = Estate(spark, str(tmp_path))
    params = PARAMS.with_(scope="d1")
    one, two = scan.scores_of(plain, params), scan.scores_of(estate, params)
    assert one.count() > 0 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_a_scan_of_one_database_is_its_row_of_the_whole_scan(estate):
    whole, alone = scan.full_scan(estate, PARAMS), scan.full_scan(estate, PARAMS.with_(scope="d1"))
    for mine, theirs in ((alone.composite, whole.composite), (alone.items, whole.items)):
        got, want = mine.collect(), theirs.where("scope = 'D1'").collect()
        assert got and sorted(map(str, got)) == sorted(map(str, want))


def test_scans_of_several_scopes_share_the_logs(estate):
    inputs = scan.inputs_of(estate, PARAMS.with_(scope="D1"))
    bare = {name: estate[name] for name in estate if name not in scan.LOGS}  # no logs at all
    one, alone = PARAMS.with_(scope="D1"), scan.full_scan(estate, PARAMS.with_(scope="D1"))
    shared = scan.full_scan(bare, one, inputs, alone.quality)
    for mine, theirs in ((shared.scores, alone.scores), (shared.composite, alone.composite),
                         (shared.items, alone.items)):
        assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))
    assert not shared.scores.isEmpty()


def test_absent_relations(spark):
    partial = Estate(spark, "/nowhere", absent=("tag_references",))
    assert "tag_references" not in partial and "tables" in partial
    with pytest.raises(KeyError):
        partial["tag_references"]


def test_top_rows_are_cut_before_the_shuffle(spark, estate):
    scores = scan.scores_of(estate, PARAMS)
    for frame in (items.items_schema_gap(scores, PARAMS),
                  report.report_opportunities(estate["scan_improvement_items"])):
        assert plan(frame).count("WindowGroupLimit") == 2


def test_runs_are_spread_before_they_are_multiplied(estate):
    text = plan(report.peer_comparison(estate["scan_runs"]))
    assert text.index("BroadcastHashJoin") < text.index("Exchange hashpartitioning(run_id")


def test_rounded_positions_are_those_of_round(estate):
    plain, own = (report.peer_comparison(estate["scan_runs"], digits) for digits in (None, 6))
    by_round = plain.withColumns({c: F.round(c, 6) for c in ("score_pos", "peer_pos")})
    assert own.count() > 0 and own.exceptAll(by_round).isEmpty()


def test_parts_of_views_are_grouped_once(spark, estate):
    """Views with and without base tables come from one shuffle of the views' parts."""
    quality = scan.quality_of(estate)
    final = plan(quality, run=True).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    # The relationships are read for the parts only.
    lineitem = [line for line in final.split("\n") if "FileScan" in line and "/lineitem" in line]
    assert sum("l_suppkey#" in s and "l_quantity#" not in s for s in lineitem) == 1


def test_only_the_fixed_peer_table_is_broadcast_by_hint(estate):
    frame = report.peer_comparison(estate["scan_runs"])
    assert "BroadcastHashJoin" in plan(frame)
    assert "ResolvedHint (strategy=broadcast)" not in history.history_items(
        estate["scan_runs"], estate["scan_improvement_items"]
    )._jdf.queryExecution().analyzed().toString()
