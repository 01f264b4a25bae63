"""Six-factor scan: thirteen metadata ratios for every schema at once.

All checks read one profile with a row per schema. It is built from marks, small frames
keyed by table that are put on top of each other and grouped, so that each input relation
is scanned once and no table with very many columns, tags or reads gathers in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge import constants as K
from tablegauge.functions import scoring
from tablegauge.functions.names import TABLE_KEY, upper_key, with_name_parts
from tablegauge.operators.semantic import live
from tablegauge.params import ScanParams
from tablegauge.sources.relations import since_days_ago

SCHEMA_KEY = ("database_name", "schema_name")
RAW_KEY = ("table_catalog", "table_schema", "table_name")
COLUMN_KEY = (*TABLE_KEY, "column_name")


@dataclass(frozen=True)
class Check:
    """One requirement: numerator / denominator, and the relations it needs."""

    factor: str
    requirement: str
    label: str
    numerator: str
    denominator: str
    needs: tuple[str, ...] = ("catalog_tables",)


# Factors, requirements and their labels, in order.
_T, _C, _K = "catalog_tables", "catalog_columns", "catalog_constraints"
CHECKS = (
    Check("Clean", "data_completeness", "Data completeness (columns marked NOT NULL)",
          "required_columns", "columns", (_T, _C)),
    Check("Clean", "uniqueness", "Uniqueness (tables with PK or UNIQUE constraint)",
          "unique_tables", "base_tables", (_T, _K)),
    Check("Clean", "referential_integrity", "Referential integrity (FK constraints declared)",
          "linked_tables", "linkable_tables", (_T, _C, _K)),
    Check("Contextual", "semantic_documentation", "Semantic documentation (SV coverage)",
          "covered_tables", "base_tables", (_T, "semantic_tables")),
    Check("Contextual", "entity_identifier_declaration",
          "Entity identifier declaration (PK/UNIQUE)",
          "unique_tables", "base_tables", (_T, _K)),
    Check("Contextual", "schema_type_coverage", "Schema type coverage (semantic-role signal)",
          "role_columns", "columns", (_T, _C)),
    Check("Consumable", "access_optimization",
          "Access optimization (clustering on large tables)",
          "clustered_tables", "large_tables"),
    Check("Current", "change_detection", "Change detection (change tracking enabled)",
          "tracked_tables", "kind_tables"),
    Check("Current", "data_freshness", "Data freshness (altered within 7 days)",
          "fresh_tables", "base_tables"),
    Check("Correlated", "data_provenance", "Data provenance (tables read by downstream queries)",
          "read_tables", "base_tables", (_T, "access_history")),
    Check("Correlated", "lineage_completeness",
          "Lineage completeness (tables with upstream write history)",
          "written_tables", "base_tables", (_T, "access_history")),
    Check("Compliant", "classification", "Classification (governance tags applied)",
          "tagged_tables", "base_tables", (_T, "tag_references")),
    Check("Compliant", "column_masking", "Column masking (PII columns with masking policy)",
          "masked_columns", "pii_columns", (_T, _C, "policy_references")),
)
BY_NAME = {check.requirement: check for check in CHECKS}


def whole_match(text: Column, pattern: str) -> Column:
    """The pattern describes the whole text, not a part of it."""
    return text.rlike(f"^(?:{pattern})$")


def is_pii(column_name: str, params: ScanParams) -> Column:
    name = F.lower(column_name)
    if params.pii_match == "search":
        return name.rlike(K.PII_COLUMN_PATTERN)
    return whole_match(name, K.PII_COLUMN_PATTERN)


def has_role(column_name: str, comment: str) -> Column:
    """A comment that is not empty, or a name that tells the column's role."""
    commented = F.col(comment).isNotNull() & (F.col(comment) != "")
    return commented | whole_match(F.lower(column_name), K.SEMANTIC_ROLE_PATTERN)


def hours_since(column: str, params: ScanParams) -> Column:
    """Clock hours begun since a time: boundaries crossed, not whole hours elapsed."""
    days = F.datediff(F.lit(str(params.today)).cast("date"), F.to_date(column))
    return days * 24 + F.lit(params.now.hour) - F.hour(column)


def is_base() -> Column:
    return F.col("table_type") == "BASE TABLE"


def base_tables(tables: DataFrame) -> DataFrame:
    return tables.where(is_base())


def scope_list(tables: DataFrame, schemas: list[str] | None = None) -> DataFrame:
    """Databases and schemas of the catalog, or the chosen schemas only."""
    listed = tables.select(
        F.upper("table_catalog").alias("database_name"),
        F.upper("table_schema").alias("schema_name"),
    ).distinct().where(F.col("schema_name") != K.HIDDEN_SCHEMA)
    if schemas is not None:
        listed = listed.where(F.col("schema_name").isin([s.upper() for s in schemas]))
    return listed


def catalog_columns_base(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of base tables, row by row."""
    names = base_tables(tables).select(*RAW_KEY)
    return columns.join(names, list(RAW_KEY))


def _count(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def _table_marks(tables: DataFrame, params: ScanParams) -> DataFrame:
    base = F.coalesce(is_base(), F.lit(False))
    large = base & (F.col("row_count") > params.large_table_rows)
    user_table = F.col("kind") == "TABLE"
    flags = {
        "base_tables": base,
        "large_tables": large,
        "clustered_tables": large & F.col("clustering_key").isNotNull(),
        "fresh_tables": base & (hours_since("last_altered", params) <= params.fresh_hours),
        "kind_tables": user_table,
        "tracked_tables": user_table & (F.col("change_tracking") == "ON"),
    }
    counted = {name: F.when(flag, 1).otherwise(0) for name, flag in flags.items()}
    return tables.select(
        *upper_key(*RAW_KEY), F.lit(1).alias("entries"),
        *[value.alias(name) for name, value in counted.items()],
    )


def _column_marks(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Column counts per base table; columns are counted per table before they meet it."""
    per_table = columns.groupBy(*RAW_KEY).agg(
        F.count("*").alias("columns"),
        _count(F.col("is_nullable") == "NO").alias("required_columns"),
        _count(has_role("column_name", "comment")).alias("role_columns"),
        F.bool_or(whole_match(F.lower("column_name"), K.FK_COLUMN_PATTERN)).alias("has_fk_column"),
    )
    kept = per_table.join(base_tables(tables).select(*RAW_KEY), list(RAW_KEY))
    return kept.select(
        *upper_key(*RAW_KEY), "columns", "required_columns", "role_columns", "has_fk_column"
    )


def _constraint_marks(constraints: DataFrame) -> DataFrame:
    kind = F.col("constraint_type")
    return constraints.where(kind.isin("PRIMARY KEY", "UNIQUE", "FOREIGN KEY")).select(
        *upper_key(*RAW_KEY),
        kind.isin("PRIMARY KEY", "UNIQUE").alias("is_unique"),
        (kind == "FOREIGN KEY").alias("has_fk"),
    )


def _coverage_marks(semantic_tables: DataFrame) -> DataFrame:
    return live(semantic_tables).select(
        *upper_key("base_table_database_name", "base_table_schema_name", "base_table_name"),
        F.lit(True).alias("is_covered"),
    )


def _access_marks(access: DataFrame, params: ScanParams) -> DataFrame:
    """Tables read and written by any statement of the look-back, from one pass over the log."""
    recent = since_days_ago(access, "query_start_time", params, params.lookback_days)

    sides = recent.select(F.inline(F.array(
        F.struct(F.lit(False).alias("written"), F.col("base_objects_accessed").alias("objects")),
        F.struct(F.lit(True).alias("written"), F.col("objects_modified").alias("objects")),
    )))
    objects = sides.select("written", F.explode("objects").alias("o")).where(
        F.col("o.objectDomain") == "Table"
    )
    # Each logged name once, however often it was logged: it is split and upper-cased once too.
    names = objects.groupBy(F.col("o.objectName").alias("full_table_name")).agg(
        F.bool_or(~F.col("written")).alias("is_read"), F.bool_or("written").alias("is_written"))
    return with_name_parts(names).drop("full_table_name")


def _tag_marks(tags: DataFrame) -> DataFrame:
    """Tagged names as written: letter-case variants of one table count one each."""
    names = tags.where(F.col("domain") == "TABLE").select(
        F.upper("object_database").alias("database_name"),
        F.upper("object_schema").alias("schema_name"),
        "object_name",
    ).distinct()
    return names.select(
        *SCHEMA_KEY, F.upper("object_name").alias("table_name"), F.lit(1).alias("tagged_names")
    )


#: Columns of the marks: counts are added up, flags are or-ed per table.
COUNTS = {
    "entries", "base_tables", "large_tables", "clustered_tables", "fresh_tables",
    "kind_tables", "tracked_tables", "columns", "required_columns", "role_columns",
    "tagged_names",
}


def schema_profile(
    relations: Mapping[str, DataFrame], needs: set[str], params: ScanParams
) -> DataFrame:
    """Every count the checks divide, one row per schema of the catalog.

    Only the relations named in ``needs`` are read. A schema in which a check finds
    nothing still has its row, with zeros.
    """
    tables = relations["catalog_tables"]
    marks = [_table_marks(tables, params)]
    if "catalog_columns" in needs:
        marks.append(_column_marks(relations["catalog_columns"], tables))
    if "catalog_constraints" in needs:
        marks.append(_constraint_marks(relations["catalog_constraints"]))
    if "semantic_tables" in needs:
        marks.append(_coverage_marks(relations["semantic_tables"]))
    if "access_history" in needs:
        marks.append(_access_marks(relations["access_history"], params))
    if "tag_references" in needs:
        marks.append(_tag_marks(relations["tag_references"]))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marks)

    marked = [c for c in stacked.columns if c not in TABLE_KEY]
    per_table = stacked.groupBy(*TABLE_KEY).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) if c in COUNTS
        else F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
        for c in marked
    ])
    base = F.col("base_tables")
    totals = [F.sum(c).alias(c) for c in marked if c in COUNTS and c != "tagged_names"]
    for flag, name in (
        ("is_unique", "unique_tables"), ("is_covered", "covered_tables"),
        ("is_read", "read_tables"), ("is_written", "written_tables"),
    ):
        if flag in marked:
            totals.append(F.sum(F.when(F.col(flag), base).otherwise(0)).alias(name))
    if "tagged_names" in marked:
        totals.append(
            F.sum(F.when(base > 0, F.col("tagged_names")).otherwise(0)).alias("tagged_tables")
        )
    if {"has_fk", "has_fk_column"} <= set(marked):
        linkable = F.col("has_fk_column")
        totals += [
            F.count_if(linkable & F.col("has_fk")).alias("linked_tables"),
            F.greatest(F.count_if(linkable), F.lit(1)).alias("linkable_tables"),
        ]
    profile = per_table.groupBy(*SCHEMA_KEY).agg(*totals).where(
        (F.col("entries") > 0) & (F.col("schema_name") != K.HIDDEN_SCHEMA)
    )
    if {"catalog_columns", "policy_references"} <= needs:
        masking = masking_profile(relations, params)
        profile = profile.join(masking, list(SCHEMA_KEY), "left").na.fill(
            0, ["pii_columns", "masked_columns"]
        )
    return profile


def masking_profile(relations: Mapping[str, DataFrame], params: ScanParams) -> DataFrame:
    """PII columns of base tables per schema, and how many have a masking policy."""
    columns, policies = relations["catalog_columns"], relations["policy_references"]
    pii = catalog_columns_base(
        columns.where(is_pii("column_name", params)).select(*RAW_KEY, "column_name"),
        relations["catalog_tables"],
    ).select(
        *upper_key(*RAW_KEY), F.upper("column_name").alias("column_name"),
        F.lit(1).alias("found"), F.lit(False).alias("is_masked"),
    )
    masked = policies.where(F.col("policy_kind") == "MASKING_POLICY").select(
        *upper_key("ref_database_name", "ref_schema_name", "ref_entity_name"),
        F.upper("ref_column_name").alias("column_name"),
        F.lit(0).alias("found"), F.lit(True).alias("is_masked"),
    )
    per_column = pii.unionByName(masked).groupBy(*COLUMN_KEY).agg(
        F.sum("found").alias("found"), F.bool_or("is_masked").alias("is_masked")
    )
    return per_column.groupBy(*SCHEMA_KEY).agg(
        F.sum("found").alias("pii_columns"),
        F.sum(F.when(F.col("is_masked"), F.col("found")).otherwise(0)).alias("masked_columns"),
    )


def check(name: str, relations: Mapping[str, DataFrame], params: ScanParams) -> DataFrame:
    """One requirement for every schema: numerator, denominator and value."""
    spec = BY_NAME[name]
    profile = schema_profile(relations, set(spec.needs), params)
    numerator, denominator = F.col(spec.numerator), F.col(spec.denominator)
    return profile.select(
        *SCHEMA_KEY,
        numerator.cast("long").alias("numerator"),
        denominator.cast("long").alias("denominator"),
        scoring.ratio(numerator, denominator).alias("value"),
    )


def six_factor_requirements(
    relations: Mapping[str, DataFrame], params: ScanParams, schemas: list[str] | None = None
) -> DataFrame:
    """All requirements of every schema in long form.

    A requirement whose input relation is absent keeps its row, with an error instead of
    numbers, and is left out of the scores.
    """
    needs = {need for spec in CHECKS for need in spec.needs if need in relations}
    profile = schema_profile(relations, needs, params)
    if schemas is not None:
        profile = profile.where(F.col("schema_name").isin([s.upper() for s in schemas]))

    def requirement(spec: Check) -> Column:
        absent = [need for need in spec.needs if need not in relations]
        if absent:
            numerator = denominator = F.lit(None).cast("long")
            error = F.lit(f"missing relation: {', '.join(absent)}")
        else:
            numerator = F.col(spec.numerator).cast("long")
            denominator = F.col(spec.denominator).cast("long")
            error = F.lit(None).cast("string")
        return F.struct(
            F.lit(spec.factor).alias("factor"),
            F.lit(spec.requirement).alias("requirement"),
            F.lit(spec.label).alias("label"),
            numerator.alias("numerator"), denominator.alias("denominator"),
            error.alias("error"),
        )

    rows = profile.select(*SCHEMA_KEY, F.inline(F.array(*map(requirement, CHECKS))))
    value = scoring.ratio(F.col("numerator"), F.col("denominator"))
    return rows.select(
        *SCHEMA_KEY, "factor", "requirement", "label", "numerator", "denominator",
        value.alias("value"), scoring.passes(value, params).alias("passed"), "error",
    )


def six_factor_scores(requirements: DataFrame) -> DataFrame:
    """Mean of the known values per factor, and mean of the known factors per schema."""
    factors = requirements.groupBy(*SCHEMA_KEY, "factor").agg(F.avg("value").alias("score"))
    return factors.withColumn(
        "overall", F.avg("score").over(Window.partitionBy(*SCHEMA_KEY))
    )


def six_factor_portfolio(scores: DataFrame) -> DataFrame:
    """One row per schema, its factors side by side in percent, with its tier."""

    def percent(share: str) -> Column:
        return F.round(F.col(share) * 100, 1).alias(share)

    wide = scores.groupBy(*SCHEMA_KEY, "overall").pivot("factor", list(K.FACTORS)).agg(
        F.first("score")
    )
    return wide.select(
        *SCHEMA_KEY, percent("overall"), scoring.six_factor_tier(F.col("overall")).alias("tier"),
        *map(percent, K.FACTORS),
    )


def by_overall(portfolio: DataFrame) -> DataFrame:
    """Schemas, best first, unscored last."""
    return portfolio.orderBy(F.desc_nulls_last("overall"), *SCHEMA_KEY)


def six_factor_detail(requirements: DataFrame) -> DataFrame:
    """Requirements as text: value to two places, the fraction behind it, and pass or fail."""
    value = F.when(F.col("error").isNotNull(), "Error").when(
        F.col("value").isNull(), "N/A"
    ).otherwise(F.format_number("value", 2))
    fraction = F.concat_ws("/", F.col("numerator"), F.col("denominator"))
    return requirements.select(
        *SCHEMA_KEY, "factor", "requirement", F.col("label").alias("description"),
        value.alias("value"),
        F.when(F.col("numerator").isNull(), "-").otherwise(fraction).alias("fraction"),
        F.when(F.col("passed").isNull(), "-").when(F.col("passed"), "pass").otherwise("fail")
        .alias("result"),
    )
