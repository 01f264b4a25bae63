"""Column schemas of the relations the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
STRINGS = T.ArrayType(S)
OBJECTS = T.ArrayType(T.StructType().add("objectName", S).add("objectDomain", S))


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _member(name_column: str) -> T.StructType:
    return _schema(
        semantic_view_id=S, **{name_column: S},
        synonyms=STRINGS, comment=S, last_altered=TS, deleted=TS,
    )


INPUTS: dict[str, T.StructType] = {
    "access_history": _schema(
        query_id=S, user_name=S, query_start_time=TS,
        base_objects_accessed=OBJECTS, objects_modified=OBJECTS,
    ),
    "query_history": _schema(
        query_id=S, session_id=S, query_type=S, error_code=S, execution_time=D,
        warehouse_id=S, is_client_generated_statement=B, user_type=S, start_time=TS,
    ),
    "sessions": _schema(session_id=S, client_environment=S),
    "tables": _schema(
        table_catalog=S, table_schema=S, table_name=S, table_type=S,
        last_altered=TS, deleted=TS,
    ),
    "semantic_views": _schema(
        semantic_view_id=S, semantic_view_database_name=S, semantic_view_schema_name=S,
        semantic_view_name=S, comment=S, last_altered=TS, deleted=TS,
    ),
    "semantic_tables": _schema(
        semantic_view_id=S, semantic_table_name=S, base_table_database_name=S,
        base_table_schema_name=S, base_table_name=S, primary_keys=STRINGS,
        unique_keys=STRINGS, distinct_ranges=STRINGS, synonyms=STRINGS, comment=S,
        last_altered=TS, deleted=TS,
    ),
    "semantic_dimensions": _member("semantic_dimension_name"),
    "semantic_facts": _member("semantic_fact_name"),
    "semantic_metrics": _member("semantic_metric_name"),
    "semantic_relationships": _schema(semantic_view_id=S, deleted=TS),
    "sv_properties": _schema(
        database_name=S, schema_name=S, name=S, object_kind=S, object_name=S,
        property=S, property_value=S,
    ),
    "catalog_tables": _schema(
        table_catalog=S, table_schema=S, table_name=S, table_type=S, row_count=L,
        clustering_key=S, last_altered=TS, kind=S, change_tracking=S,
    ),
    "catalog_columns": _schema(
        table_catalog=S, table_schema=S, table_name=S, column_name=S, is_nullable=S,
        comment=S,
    ),
    "catalog_constraints": _schema(
        table_catalog=S, table_schema=S, table_name=S, constraint_type=S,
    ),
    "tag_references": _schema(
        object_database=S, object_schema=S, object_name=S, domain=S,
    ),
    "policy_references": _schema(
        ref_database_name=S, ref_schema_name=S, ref_entity_name=S, ref_column_name=S,
        policy_kind=S,
    ),
}

#: Logs that grow without end and are laid out by date: relation -> its time column.
LOG_TIMES = {"access_history": "query_start_time", "query_history": "start_time"}

SCAN_RUNS = _schema(
    run_id=S, run_ts=TS, account_name=S, role_name=S, database_filter=S,
    sample_pct=T.IntegerType(), ai_readiness=D, demand_coverage=D, sv_readiness=D,
    sv_coverage=D, sv_quality=D, n_cr_tables=L, gap=S, recommendation_text=S,
    n_all_scored=L, n_sv=L, n_sv_covered=L, report_html_path=S,
)

#: ``item_rank`` keeps the order of a run's items, which a distributed table does not.
SCAN_IMPROVEMENT_ITEMS = _schema(
    run_id=S, item_rank=T.IntegerType(), item_type=S, target=S, detail=S,
    recommendation=S,
)
