"""Run history: append-only runs and items, read back by scope and over time.

Every call that saves a scan has an id of its own. It writes its items and runs into partitions
of that id and of the attempt, and then a commit, a table of one row, which makes both visible
at once. Readers take the rows of each call's first committed attempt and nothing else, so

- writers at the same time never touch each other's files, and need no lock;
- an attempt that failed half way is never seen;
- a call repeated under its id adds nothing, even while the first is still running;
- a call under another id always adds a run, whatever its parameters and result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge import constants as K
from tablegauge.operators.composite import recommendation_text
from tablegauge.params import ALL_DATABASES, ScanParams
from tablegauge.sources.schemas import SCAN_IMPROVEMENT_ITEMS, SCAN_RUNS

RUNS, ITEMS, COMMITS = "scan_runs", "scan_improvement_items", "commits"
#: Partition columns of both tables, and columns of a commit.
CALL = "call_id string, attempt string"


def run_rows(composite: DataFrame, params: ScanParams, call_id: str) -> DataFrame:
    """Composite rows (with top_targets) as rows of the run history.

    A run's id follows from the saving call and the scope.
    """
    return composite.select(
        F.md5(F.concat_ws("|", F.lit(call_id), "scope")).alias("run_id"),
        F.lit(params.as_of).cast("timestamp").alias("run_ts"),
        F.lit(params.account_name).alias("account_name"),
        F.lit(params.role_name).alias("role_name"),
        F.col("scope").alias("database_filter"),
        F.lit(params.sample_pct).cast("int").alias("sample_pct"),
        "ai_readiness", "demand_coverage", "sv_readiness", "sv_coverage", "sv_quality",
        "n_cr_tables", "gap",
        recommendation_text(params.account_name).alias("recommendation_text"),
        "n_all_scored", "n_sv", "n_sv_covered",
        F.lit(None).cast("string").alias("report_html_path"),
    )


def item_rows(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Improvement items under the id of their scope's run."""
    ids = runs.select("run_id", F.col("database_filter").alias("scope"))
    return items.join(ids, "scope").select(*SCAN_IMPROVEMENT_ITEMS.fieldNames())


def append_history(runs: DataFrame, items: DataFrame, folder: str, call_id: str) -> bool:
    """Append the runs and items of one call; False if the call had been committed before.

    ``call_id`` becomes a folder name: letters, digits, - and _.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", call_id):
        raise ValueError(f"not a call id: {call_id!r}")
    spark = runs.sparkSession
    if not _load(spark, f"{folder}/{COMMITS}/call_id={call_id}", "attempt string").isEmpty():
        return False
    attempt = uuid.uuid4().hex
    for rows, schema, table in ((items, SCAN_IMPROVEMENT_ITEMS, ITEMS), (runs, SCAN_RUNS, RUNS)):
        kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
        rows.select(*kept).write.parquet(
            f"{folder}/{table}/call_id={call_id}/attempt={attempt}")
    # One row, so one file, which a single rename or upload puts in place.
    commit = spark.range(1).coalesce(1).select(F.current_timestamp().alias("committed_at"))
    commit.write.parquet(f"{folder}/{COMMITS}/call_id={call_id}/attempt={attempt}")
    return True


def _load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a folder holds; nothing before the first write. Any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The attempt that counts of every call: the first that was committed."""
    done = _load(spark, f"{folder}/{COMMITS}", f"committed_at timestamp, {CALL}")
    return done.groupBy("call_id").agg(
        F.min_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))


def _committed(
    spark: SparkSession, folder: str, table: str, schema: T.StructType, call_id: str | None
) -> DataFrame:
    found = _load(spark, f"{folder}/{table}", f"{schema.toDDL()}, {CALL}")
    valid = commits(spark, folder)
    if call_id is not None:  # read this call's partition only
        found, valid = (df.where(F.col("call_id") == call_id) for df in (found, valid))
    return found.join(valid, ["call_id", "attempt"]).select(*schema.fieldNames())


def load_runs(spark: SparkSession, folder: str, call_id: str | None = None) -> DataFrame:
    """All committed runs, or those of one call."""
    return _committed(spark, folder, RUNS, SCAN_RUNS, call_id)


def load_items(spark: SparkSession, folder: str, call_id: str | None = None) -> DataFrame:
    """All committed items, or those of one call."""
    return _committed(spark, folder, ITEMS, SCAN_IMPROVEMENT_ITEMS, call_id)


def history_runs(runs: DataFrame, scope: str | None = None) -> DataFrame:
    """Runs of one scope in either case, newest first. "All databases" means every run, whatever its scope."""
    if scope and scope != ALL_DATABASES:
        runs = runs.where(F.upper("database_filter") == scope.upper())
    return runs.orderBy(F.desc("run_ts"), "run_id")


def history_items(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the scope and time of their run."""
    return items.join(runs.select("run_id", "run_ts", "database_filter"), "run_id")


def history_latest(runs: DataFrame) -> DataFrame:
    """Newest run of every scope."""
    columns = [c for c in runs.columns if c != "database_filter"]
    newest = F.max_by(F.struct(*columns), F.struct("run_ts", "run_id"))
    return runs.groupBy("database_filter").agg(newest.alias("run")).select(
        "database_filter", "run.*"
    )


def history_trend(runs: DataFrame, params: ScanParams) -> DataFrame:
    """The trend measures over time, oldest first, beside the healthy threshold."""
    tall = runs.unpivot(
        ["run_id", "run_ts", "database_filter"], list(K.TREND_COLUMNS), "measure", "value"
    )
    return tall.withColumn("healthy_threshold", F.lit(params.healthy_threshold)).orderBy(
        "run_ts", "run_id", "measure"
    )
