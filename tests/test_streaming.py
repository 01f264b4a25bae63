"""Facts kept by the stream give what a scan of the logs gives."""

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import reads
from tablegauge.params import ScanParams
from tablegauge.sources import derived
from tablegauge.sources.relations import Estate, write_log
from tablegauge.sources.schemas import INPUTS
from tablegauge.streaming import daily_facts
from tests.conftest import SMALL

PARAMS = ScanParams(derived.AS_OF)
LOGS = {"access_history": "query_start_time", "query_history": "start_time", "sessions": None}
KEY = {"access_history": "query_id", "query_history": "query_id", "sessions": "session_id"}


class Logs:
    """Three growing logs in a folder, as tables and as streams."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def add(self, name, rows):
        path = f"{self.folder}/logs/{name}"
        if LOGS[name]:
            write_log(rows, LOGS[name], path)
        else:
            rows.write.mode("append").parquet(path)

    def tables(self):
        return Estate(self.spark, f"{self.folder}/logs")

    def keep(self, params):
        streams = {
            name: self.spark.readStream.schema(INPUTS[name]).parquet(f"{self.folder}/logs/{name}")
            for name in LOGS}
        query = daily_facts.keep_daily_facts(streams, self.tables, f"{self.folder}/kept", params)
        assert query.awaitTermination(300)

    def check(self, params, some=True):
        tables = [self.tables()[name] for name in LOGS]
        scanned = reads.reads_per_table(reads.reads_joined(*tables, params), params).collect()
        kept = daily_facts.reads_per_table(self.spark, f"{self.folder}/kept", params).collect()
        assert sorted(map(repr, kept)) == sorted(map(repr, scanned))
        assert bool(kept) == some


@pytest.fixture(scope="module")
def skewed(spark):
    """The logs, with accesses logged up to 40 hours after their query."""
    estate = derived.DerivedEstate(spark, SMALL)
    hours = F.col("query_id").cast("int") % 5 * 10
    access = estate["access_history"].withColumn(
        "query_start_time",
        F.col("query_start_time") + F.make_dt_interval(F.lit(0), hours))
    return {"access_history": access, "query_history": estate["query_history"],
            "sessions": estate["sessions"]}


def part(frame, name, late):
    """A third of the rows of each log comes late, by different thirds."""
    third = F.pmod(F.xxhash64(KEY[name], F.lit(name)), F.lit(3)) == 0
    return frame.where(third if late else ~third)


def test_late_rows_sample_scope_and_skew(spark, skewed, tmp_path):
    logs = Logs(spark, tmp_path)
    for name, frame in skewed.items():
        logs.add(name, part(frame, name, late=False))
    shapes = PARAMS, PARAMS.with_(sample_pct=30, scope="d1", min_reads=2)
    for params in shapes:
        logs.keep(params)
        logs.check(params)
    # Each log's late rows alone, then a run that finds nothing new.
    for name, frame in (*skewed.items(), (None, None)):
        if name:
            logs.add(name, part(frame, name, late=True))
        logs.keep(PARAMS)
        logs.check(PARAMS)
    logs.keep(shapes[1])
    logs.check(shapes[1])
    # The next day's scan uses the same facts, without a new run; thresholds may differ.
    logs.check(PARAMS.with_(as_of="2024-02-02 01:00:00", min_reads=1))


def test_only_changed_days_are_counted(spark, skewed, tmp_path):
    logs = Logs(spark, tmp_path)
    for name, frame in skewed.items():
        logs.add(name, frame)
    tables = logs.tables()
    new = spark.createDataFrame([], "kind string, id string, seen timestamp_ntz")
    assert daily_facts.changed_days(new, tables, PARAMS) == []
    one = tables["access_history"].where("log_date = '2024-01-29'").first()
    for kind, key in (("access", one["query_id"]), ("query", one["query_id"])):
        row = spark.createDataFrame([(kind, key, one["query_start_time"])], new.schema)
        days = daily_facts.changed_days(row, tables, PARAMS)
        assert "2024-01-29" in days and (kind == "query" or days == ["2024-01-29"])
    old = spark.createDataFrame([("access", "1", derived_time("2023-01-01"))], new.schema)
    assert daily_facts.changed_days(old, tables, PARAMS) == []
    logs.keep(PARAMS)
    path = f"{tmp_path}/kept/{daily_facts.stamp(PARAMS)}/facts"
    before = {r["file"] for r in spark.read.parquet(path).select(
        F.input_file_name().alias("file")).distinct().collect()}
    daily_facts.store_days(tables, ["2024-01-29"], f"{tmp_path}/kept", PARAMS)
    after = {r["file"] for r in spark.read.parquet(path).select(
        F.input_file_name().alias("file")).distinct().collect()}
    assert before - after and all("day=2024-01-29" in f for f in before ^ after)
    logs.check(PARAMS)


def test_no_log_is_joined_when_new_accesses_change_all_days(spark, skewed, tmp_path):
    logs = Logs(spark, tmp_path)
    logs.add("access_history", skewed["access_history"])
    access = logs.tables()["access_history"]
    new = access.selectExpr(
        "'access' as kind", "query_id as id", "query_start_time as seen")
    start = PARAMS.window_start
    want = [str(r[0]) for r in access.where(F.col("log_date") >= F.lit(str(start)).cast("date"))
            .select("log_date").distinct().orderBy("log_date").collect()]
    only = {"access_history": access}  # queries and sessions cannot be opened
    assert want and daily_facts.changed_days(new, only, PARAMS) == want
    with pytest.raises(KeyError):  # another day's accesses must be looked up
        daily_facts.changed_days(new.where("seen < '2024-01-30'"), only, PARAMS)


def derived_time(day):
    import datetime as dt
    return dt.datetime.fromisoformat(day)


def test_no_facts_before_the_first_run(spark, tmp_path):
    assert daily_facts.reads_per_table(spark, str(tmp_path), PARAMS).isEmpty()


def test_stamps_follow_what_shapes_facts_only():
    same = {daily_facts.stamp(PARAMS.with_(**change)) for change in (
        {}, {"min_reads": 9}, {"as_of": "2024-02-01 00:00:00"}, {"account_name": "b"})}
    others = {daily_facts.stamp(PARAMS.with_(**change)) for change in (
        {"sample_pct": 30}, {"scope": "D1"}, {"hosted_clients": ("x",)},
        {"service_user_type": "S"}, {"internal_tables": ()})}
    assert len(same) == 1 and len(others) == 5 and not same & others


def test_median_is_refined_from_few_buckets(spark, skewed, tmp_path):
    """No log is opened, and only the latencies are read beyond histograms and labels."""
    logs = Logs(spark, tmp_path)
    for name, frame in skewed.items():
        logs.add(name, frame)
    logs.keep(PARAMS)
    frame = daily_facts.reads_per_table(spark, f"{tmp_path}/kept", PARAMS)
    scans = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines()
             if "FileScan" in line]
    assert len(scans) == 3 and all("PartitionFilters: [isnotnull(day#" in s for s in scans)
    assert sum("ms#" in s.split("Batched")[0] for s in scans) == 1
