"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.session import shared_folder

#: Tables stored since :func:`stored_alone` began, if it runs.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)
#: Rows that one task ranks or rounds together.
CELL_ROWS = 20_000
#: Texts that Spark hands to Python at a time, at most: its 10,000 take five times the memory.
BATCH_ROWS = 2_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, in the shared folder."""
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"


def in_small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_ROWS``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    Later steps read only the columns they need, and a lost executor never brings the work
    before this point back. Zstandard releases its native buffers with each file, where Snappy's
    stay until a full collection, which very many small files do not bring about.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    made = _MADE.get()
    if made is not None:
        made.append(table)
    return table


def stored_alone(build: Callable[[], DataFrame]) -> DataFrame:
    """Store what ``build`` gives and remove every table that was stored on the way to it.

    For small results of steps with large intermediate tables, which would otherwise take up disk
    until the application ends.
    """
    outer = _MADE.set([])
    try:
        result = stored(build())
        made = _MADE.get()
    finally:
        _MADE.reset(outer)
    discard(*[table for table in made if table is not result])
    if _MADE.get() is not None:
        _MADE.get().append(result)
    return result


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for table in tables:
        files = table.inputFiles()
        if files:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; results must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hashed(seed: int, *columns: Column) -> Column:
    """64-bit hash; different seeds give independent hashes."""
    return F.xxhash64(F.lit(seed), *columns)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def ranked(
    df: DataFrame, key: str, order: list[str], cells: Column, rank: str = "rank"
) -> DataFrame:
    """Number the rows of each key from 0 without gathering a key in one task.

    ``cells`` is the number of cells that the row's key is split into, from the count of its
    rows; a cell is ranked by one task. Rows alike in ``order`` get different numbers.
    """
    df = df.withColumn("_cell", F.pmod(hashed(11, *map(F.col, order)), cells))
    counts = df.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        key, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_cell").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(inside))
        .join(starts, [key, "_cell"])
        .withColumn(rank, F.col("_start") + F.col("_row") - 1)
        .drop("_cell", "_row", "_start")
    )
