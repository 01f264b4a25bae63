"""Semantic views: newest versions, metadata signals, verified queries and quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge import constants as K
from tablegauge.functions import scoring
from tablegauge.functions.names import in_scope
from tablegauge.params import ScanParams

VIEW = "semantic_view_id"
#: Identity of a view's base table.
BASE_KEY = ("base_database", "base_schema", "base_table")
#: Kinds of view members: relation -> (kind, name column).
MEMBERS = {
    "semantic_dimensions": ("dimension", "semantic_dimension_name"),
    "semantic_facts": ("fact", "semantic_fact_name"),
    "semantic_metrics": ("metric", "semantic_metric_name"),
}
QUALITY_FLAGS = (
    "has_pk", "has_synonyms", "has_unique_keys", "has_distinct_ranges",
    "has_relationships", "has_metrics",
)


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted").isNull())


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key by last_altered, unknown times last, ties by the other columns.

    An aggregate rather than a row_number: versions of one key are combined before the
    shuffle, so a key with very many versions does not gather them in one task.
    """
    rest = [c for c in df.columns if c not in (*keys, "last_altered")]
    best = F.max(F.struct("last_altered", *rest)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*")


def sv_latest(views: DataFrame) -> DataFrame:
    """Newest live version of every semantic view, with its full name."""
    parts = [f"semantic_view_{part}_name" for part in ("database", "schema")]
    columns = [*parts, "semantic_view_name"]
    chosen = newest(
        live(views).select(*columns, VIEW, "comment", "last_altered"), columns
    )
    name = F.concat(columns[0], F.lit("."), columns[1], F.lit("."), columns[2])
    return chosen.select(VIEW, name.alias("sv_fqn"), F.col("comment").alias("view_comment"))


def sv_tables_latest(tables: DataFrame) -> DataFrame:
    """Newest live version of every table of a semantic view."""
    return newest(
        live(tables).select(
            VIEW, "semantic_table_name",
            F.upper("base_table_database_name").alias("base_database"),
            F.upper("base_table_schema_name").alias("base_schema"),
            F.upper("base_table_name").alias("base_table"),
            "primary_keys", "unique_keys", "distinct_ranges", "synonyms", "comment",
            "last_altered",
        ),
        [VIEW, "semantic_table_name"],
    )


def sv_base_tables(latest_tables: DataFrame) -> DataFrame:
    """Distinct base tables of each view; only database and table must be known."""
    return latest_tables.where(_has_base()).select(VIEW, *BASE_KEY).distinct()


def _has_base() -> Column:
    return F.col("base_database").isNotNull() & F.col("base_table").isNotNull()


def members_latest(members: dict[str, DataFrame]) -> DataFrame:
    """Newest live dimensions, facts and metrics in one frame, told apart by ``kind``.

    A name counts once per view and kind, whichever of the view's tables it belongs to.
    """
    parts = [
        live(members[relation]).select(
            VIEW, F.lit(kind).alias("kind"), F.col(name).alias("name"),
            "synonyms", "comment", "last_altered",
        )
        for relation, (kind, name) in MEMBERS.items()
    ]
    return newest(reduce(DataFrame.unionByName, parts), [VIEW, "kind", "name"])


def _any_in(array: str) -> Column:
    return F.coalesce(F.bool_or(F.array_size(array) > 0), F.lit(False))


def sv_signals(latest_tables: DataFrame) -> DataFrame:
    """Whether any table of a view declares keys, ranges or synonyms."""
    return latest_tables.groupBy(VIEW).agg(
        _any_in("primary_keys").alias("has_pk"),
        _any_in("unique_keys").alias("has_unique_keys"),
        _any_in("distinct_ranges").alias("has_distinct_ranges"),
        _any_in("synonyms").alias("tbl_has_synonyms"),
    )


def sv_synonyms(latest_members: DataFrame) -> DataFrame:
    """Whether any dimension, fact or metric of a view has synonyms, per kind."""
    return latest_members.groupBy(VIEW, "kind").agg(_any_in("synonyms").alias("has_synonyms"))


def _pieces(
    latest_views: DataFrame, latest_tables: DataFrame, latest_members: DataFrame,
    relationships: DataFrame | None = None,
) -> DataFrame:
    """Everything known about a view as one tall frame: a row per part, one kind each."""
    keys = ("primary_keys", "unique_keys", "distinct_ranges")
    parts = [
        latest_views.select(VIEW, F.lit("view").alias("kind"),
                            F.col("view_comment").alias("comment")),
        latest_tables.select(VIEW, F.lit("table").alias("kind"), *keys, "synonyms", "comment",
                             _has_base().alias("has_base")),
        latest_members.select(VIEW, "kind", "synonyms", "comment"),
    ]
    if relationships is not None:
        parts.append(live(relationships).select(VIEW, F.lit("relationship").alias("kind")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _mean_comment_length() -> Column:
    """Mean length of all known comments, empty ones included; NULL without comments."""
    return F.round(F.sum(F.length("comment")) / F.nullif(F.count("comment"), F.lit(0)), 1)


def sv_comment_depth(
    latest_views: DataFrame, latest_tables: DataFrame, latest_members: DataFrame
) -> DataFrame:
    """Mean comment length per live view and the points it earns.

    Only lengths are summed: the comments themselves are never gathered.
    """
    lengths = _pieces(latest_views, latest_tables, latest_members).groupBy(VIEW).agg(
        F.bool_or(F.col("kind") == "view").alias("is_live"),
        _mean_comment_length().alias("avg_comment_length"),
    )
    mean = F.coalesce("avg_comment_length", F.lit(0.0))
    return lengths.where("is_live").select(
        VIEW, "avg_comment_length",
        F.round(scoring.comment_points(mean), 6).alias("comment_points"),
    )


def vqr_counts(properties: DataFrame) -> DataFrame:
    """Verified queries per view: own property rows, plus lists in the extension's JSON.

    Text that is not JSON, or lists that are missing, count as none.
    """
    kind = F.upper(F.coalesce("object_kind", F.lit("")))
    is_extension = (
        (kind == "EXTENSION")
        & (F.upper("object_name") == "CA") & (F.upper("property") == "VALUE")
    )
    listed = reduce(Column.__add__, [
        F.coalesce(
            F.json_array_length(F.get_json_object("property_value", f"$.{name}")), F.lit(0)
        )
        for name in K.VERIFIED_QUERY_LISTS
    ])
    points = F.when(kind.isin(*K.VERIFIED_QUERY_KINDS), 1).when(is_extension, listed).otherwise(0)
    name = F.concat("database_name", F.lit("."), "schema_name", F.lit("."), "name")
    return properties.groupBy(name.alias("sv_fqn")).agg(
        F.sum(points).alias("n_verified_queries")
    )


def sv_quality(
    views: DataFrame, tables: DataFrame, members: dict[str, DataFrame],
    relationships: DataFrame, vqr: DataFrame,
) -> DataFrame:
    """Quality of every live view, one row per base table; views without any keep one row.

    All signals come from one grouping over the view's parts instead of a join per signal.
    """
    latest_views = sv_latest(views)
    latest_tables = sv_tables_latest(tables)
    latest_members = members_latest(members)
    # Three-valued OR over parts that may be absent, then FALSE if unknown: any part says so.
    signals = _pieces(latest_views, latest_tables, latest_members, relationships).groupBy(
        VIEW
    ).agg(
        _any_in("primary_keys").alias("has_pk"),
        _any_in("synonyms").alias("has_synonyms"),
        _any_in("unique_keys").alias("has_unique_keys"),
        _any_in("distinct_ranges").alias("has_distinct_ranges"),
        F.bool_or(F.col("kind") == "relationship").alias("has_relationships"),
        F.bool_or(F.col("kind") == "metric").alias("has_metrics"),
        F.coalesce(_mean_comment_length(), F.lit(0.0)).alias("avg_comment_length"),
        F.coalesce(F.bool_or("has_base"), F.lit(False)).alias("has_base"),
    )
    points = reduce(Column.__add__, [F.col(flag).cast("int") for flag in QUALITY_FLAGS])
    quality = (
        points
        + scoring.vqr_points(F.col("n_verified_queries"))
        + scoring.comment_points(F.col("avg_comment_length"))
    ) / K.QUALITY_PARTS
    scored = (
        latest_views.select(VIEW, "sv_fqn")
        .join(signals, VIEW)
        .join(vqr, "sv_fqn", "left")
        .withColumn("n_verified_queries", F.coalesce("n_verified_queries", F.lit(0)))
        .withColumn("quality_score", F.round(quality, 4))
    )
    # Inner join plus the rest instead of an outer join: the side that repeats a view with
    # very many base tables can then be split. Both halves filter by the same column of the same
    # grouping, so its shuffle is made once for both.
    based = scored.where("has_base").join(sv_base_tables(latest_tables), VIEW)
    unbased = scored.where(~F.col("has_base"))
    return based.unionByName(unbased, allowMissingColumns=True).select(
        "sv_fqn", *BASE_KEY, *QUALITY_FLAGS,
        "avg_comment_length", "n_verified_queries", "quality_score",
    )


def by_quality(quality: DataFrame) -> DataFrame:
    """Views, best first."""
    return quality.orderBy(
        F.desc("quality_score"), "sv_fqn", *BASE_KEY
    )


def sv_rollup(quality: DataFrame) -> DataFrame:
    """One record per view: its flags, quality and number of base tables.

    The tables themselves stay rows: a view may have any number of them, and whether it
    touches a given table is a join, not a search in a list.
    """
    flags = [F.bool_or(flag).alias(flag) for flag in QUALITY_FLAGS]
    values = ("avg_comment_length", "n_verified_queries", "quality_score")
    base = F.col("base_table").isNotNull()
    return quality.groupBy("sv_fqn").agg(
        *flags, *[F.max(c).alias(c) for c in values],
        F.count_if(base).alias("n_base_tables"),
    )


def sv_covered_tables(views: DataFrame, tables: DataFrame, params: ScanParams) -> DataFrame:
    """Base tables of any live view, as named in its metadata; old versions count too."""
    named = live(tables).where(F.col("base_table_name").isNotNull())
    covered = named.join(live(views).select(VIEW), VIEW, "left_semi")
    return in_scope(
        covered.withColumn("key", F.upper("base_table_database_name")), "key", params
    ).select(
        F.col("base_table_database_name").alias("db"),
        F.col("base_table_schema_name").alias("sch"),
        F.col("base_table_name").alias("tbl"),
    ).distinct()
