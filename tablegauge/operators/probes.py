"""Probe queries over any table: size, first rows, extremes, samples and distinct rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.constants import PROBE_SAMPLE_FRACTION
from tablegauge.functions import scoring


def probe_count(table: DataFrame) -> DataFrame:
    """Number of rows."""
    return table.agg(F.count("*").alias("n"))


def table_size_tier(name: str, table: DataFrame) -> DataFrame:
    """Size tier of a table and the number of probes it gets."""
    n = F.col("n")
    return probe_count(table).select(
        F.lit(name).alias("table_name"), "n", scoring.size_tier(n).alias("tier"),
        scoring.probe_count(n).alias("n_probes"),
    )


def probe_limit(table: DataFrame, n: int) -> DataFrame:
    """Any n rows."""
    return table.limit(n)


def probe_topk(table: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """First k rows by the first column, NULL as the highest; other columns settle ties."""
    first, *rest = table.columns
    lead = F.desc_nulls_first(first) if descending else F.asc_nulls_last(first)
    return table.orderBy(lead, *rest).limit(k)


def probe_extremes(table: DataFrame, wanted: Iterable[tuple[str, int]]) -> DataFrame:
    """Digests and first values of the first k rows for several directions and numbers.

    One bounded selection per direction: the largest number wanted is selected, and the smaller
    ones are parts of it. Columns: direction, k, first_value and row_sha256.
    """
    first = table.columns[0]
    numbers: dict[str, list[int]] = {}
    for direction, k in wanted:
        numbers.setdefault(direction, []).append(k)

    others = [f"`{name}`" for name in table.columns[1:]]
    digest = _digest_text(table)

    def best(direction: str, ks: list[int]) -> DataFrame:
        descending = direction == "desc"
        order = ", ".join([f"`{first}` {'desc nulls first' if descending else 'nulls last'}", *others])
        # At most max(ks) rows are left, so that one task may number them.
        return probe_topk(table, max(ks), descending).selectExpr(
            f"'{direction}' as direction", f"cast(`{first}` as string) as first_value",
            f"{digest} as row_sha256", f"row_number() over (order by {order}) as place",
        ).selectExpr(
            "direction", f"explode(filter(array({', '.join(map(str, ks))}), k -> place <= k)) as k",
            "first_value", "row_sha256")

    return reduce(DataFrame.unionByName, [best(*pair) for pair in numbers.items()])


def row_digest(table: DataFrame, exact: bool = False, seed: str = "") -> Column:
    """SHA-256 of a row, the same in any engine that follows this format.

    Every value is written as its length in bytes, a colon and its text; NULL is a dash. Text is as
    it is, whole numbers are decimal, other numbers are rounded to millionths and written as a
    number of those, times are written to the microsecond, and the elements of an array are joined
    by commas. ``exact`` keeps all digits of numbers, in Spark's own writing. ``seed`` (letters and digits) goes first.
    """
    return F.expr(_digest_text(table, exact, seed))


def _digest_text(table: DataFrame, exact: bool = False, seed: str = "") -> str:
    """The digest in SQL: built of Columns it would take longer than to run."""
    def text(value: str, kind: T.DataType) -> str:
        if isinstance(kind, T.FractionalType) and exact:
            return f"cast({value} + 0 as string)"  # no minus zero
        if isinstance(kind, T.FractionalType):
            return f"cast(cast(round(cast({value} as double) * 1000000) as bigint) as string)"
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return f"date_format({value}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        if isinstance(kind, T.ArrayType):
            inner = text("v", kind.elementType)
            return f"array_join(transform({value}, v -> {inner}), ',', '-')"
        return f"cast({value} as string)"

    fields = [text(f"`{f.name}`", f.dataType) for f in table.schema.fields]
    written = [f"coalesce(concat(octet_length({x}), ':', {x}), '-')" for x in fields]
    return f"sha2(concat('{seed}', {', '.join(written)}), 256)"


def probe_sample(
    table: DataFrame, fraction: float = PROBE_SAMPLE_FRACTION, seed: str = ""
) -> DataFrame:
    """The rows whose digest falls below a threshold: a random share, yet the same every time.

    The same rows are taken whatever the partitions and the engine; equal rows go together.
    """
    head = F.conv(F.substring(row_digest(table, seed=seed), 1, 8), 16, 10).cast("long")
    return table.where(head < int(fraction * 2**32))


def probe_distinct_rows(table: DataFrame, limit: int | None = None) -> DataFrame:
    """Number of distinct rows without any NULL, of the table or of any ``limit`` rows.

    Rows are told apart by a digest of 256 bits, and only digests are shuffled: 32 bytes a row,
    however wide the table. They are counted range by range of the digest and added up.
    """
    rows = table if limit is None else table.limit(limit)
    digest = F.unhex(row_digest(rows, exact=True)).alias("digest")
    return rows.dropna().select(digest).distinct().agg(F.count("*").alias("n_distinct"))
