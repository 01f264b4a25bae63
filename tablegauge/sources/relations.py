"""Reading the input relations, and the date layout that lets log scans skip old data."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.params import ScanParams
from tablegauge.sources.schemas import INPUTS, LOG_TIMES

Relations = Mapping[str, DataFrame]

#: Partition column of a log written by :func:`write_log`.
LOG_DATE = "log_date"


class Estate(Mapping[str, DataFrame]):
    """Input relations by name, opened on first use. A relation may be absent.

    ``root`` holds one Parquet folder per relation; logs may be partitioned by ``log_date``.
    """

    def __init__(self, spark: SparkSession, root: str, absent: tuple[str, ...] = ()):
        self._spark = spark
        self._root = root.rstrip("/")
        self._names = tuple(name for name in INPUTS if name not in absent)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        path, schema = f"{self._root}/{name}", INPUTS[name]
        if name in LOG_TIMES and LOG_DATE in self._spark.read.parquet(path).columns:
            schema = T.StructType([*schema.fields, T.StructField(LOG_DATE, T.DateType())])
        return self._spark.read.schema(schema).parquet(path)

    def __contains__(self, name: object) -> bool:
        return name in self._names

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def write_log(df: DataFrame, time_column: str, path: str) -> None:
    """Append a log partitioned by calendar date, so a window reads only its own dates."""
    (
        df.withColumn(LOG_DATE, F.to_date(time_column))
        .write.mode("append").partitionBy(LOG_DATE).parquet(path)
    )


def moment(df: DataFrame, column: str, stamp) -> Column:
    """``stamp`` as a literal of the column's own type, so that the filter can be pushed down."""
    return F.lit(str(stamp)).cast(df.schema[column].dataType)


def in_dates(
    df: DataFrame, column: str, params: ScanParams, open_end: bool = False
) -> DataFrame:
    """Keep the calendar dates of the reads window, both ends included.

    A log laid out by date is filtered by its partitions as well. ``open_end`` keeps all dates
    after the window too.
    """
    for name in (column, *([LOG_DATE] if LOG_DATE in df.columns else [])):
        df = df.where(F.col(name) >= moment(df, name, params.window_start))
        if not open_end:
            df = df.where(F.col(name) < moment(df, name, params.window_end))
    return df


def since_days_ago(df: DataFrame, column: str, params: ScanParams, days: int) -> DataFrame:
    """Keep rows no older than ``days`` before now, to the second."""
    start = params.days_ago(days)
    kept = df.where(F.col(column) >= moment(df, column, start))
    if LOG_DATE in df.columns:
        kept = kept.where(F.col(LOG_DATE) >= moment(df, LOG_DATE, start[:10]))
    return kept
