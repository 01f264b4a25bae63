"""Object names, scopes and sampling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.params import ALL_DATABASES, ScanParams

#: Identity of a table, upper-cased.
TABLE_KEY = ("database_name", "schema_name", "table_name")


def with_name_parts(df: DataFrame, full_name: str = "full_table_name") -> DataFrame:
    """Add database_name, schema_name and table_name, upper-cased; '' for a missing part.

    The name is split once, and the three parts are taken from the result.
    """
    split = df.withColumn("parts", F.split(F.upper(full_name), r"\."))
    return split.withColumns({
        column: F.coalesce(F.get("parts", F.lit(i)), F.lit(""))
        for i, column in enumerate(TABLE_KEY)
    }).drop("parts")


def is_complete(full_name: str = "full_table_name") -> Column:
    """Whether the name has a schema and a table part, told without splitting it."""
    return F.col(full_name).rlike(r"^[^.]*\.[^.]+\.[^.]+")


def is_one_of(tables: tuple[tuple[str, str, str], ...], full_name: str) -> Column:
    """Whether the first three parts of the name are one of the tables, in any letter case."""
    names = "|".join(re.escape(".".join(table)) for table in tables)
    return F.col(full_name).rlike(rf"(?i)^({names})(\.|$)")


def upper_key(database: str, schema: str, table: str) -> list[Column]:
    """Three columns of any relation as the upper-cased table identity."""
    return [F.upper(c).alias(name) for c, name in zip((database, schema, table), TABLE_KEY)]


def in_scope(df: DataFrame, database: str, params: ScanParams) -> DataFrame:
    """Keep one database when the scan is limited to one. ``database`` is upper-cased."""
    if params.single_scope is None:
        return df
    return df.where(F.col(database) == params.single_scope)


def per_scope(df: DataFrame, params: ScanParams, database: str = "database_name") -> DataFrame:
    """Give every row its scopes: its own database and the whole estate."""
    if params.single_scope is not None:
        return df.withColumn("scope", F.lit(params.single_scope))
    return df.withColumn("scope", F.explode(F.array(F.lit(ALL_DATABASES), F.col(database))))


def sampled(df: DataFrame, params: ScanParams, query_id: str = "query_id") -> DataFrame:
    """Keep whole queries whose id hashes into the first ``sample_pct`` of 100 slots."""
    if not params.sample_pct:
        return df
    head = F.substring(F.md5(F.col(query_id)), 1, 8)
    slot = F.conv(head, 16, 10).cast("long") % 100
    return df.where(slot < params.sample_pct)
