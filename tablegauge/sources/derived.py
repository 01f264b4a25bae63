"""The estate relations derived from order-entry tables, for tests and the benchmark.

Every relation is computed from all rows of its source table by fixed rules, so it grows
with the data and needs no made-up input. Orders act as queries, their lines as logged
object accesses, customers as sessions, parts as tables and suppliers as semantic views.
Half of the accesses go to the twenty tables T0-T19, which gives a skewed log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 12:30:00"
NOW = f"timestamp_ntz '{AS_OF}'"


def _ago(days: str, hours: str = "0", minutes: str = "0") -> str:
    return f"{NOW} - make_dt_interval(cast({days} as int), cast({hours} as int), " \
           f"cast({minutes} as int), 0)"


def _query_time(key: str) -> str:
    """Most queries ran within 14 days, every third one within 45."""
    return _ago(f"case when {key} % 3 = 0 then {key} % 45 else {key} % 14 end", f"{key} % 24")


_HOT = "case when l_linenumber <= 4 then l_partkey % 20 else l_partkey end"
_NAME = "concat('D', cast(t % 2 as string), '.S', cast(t % 5 as string), '.T', cast(t as string))"
_OBJECT = "named_struct('objectName', {0}, 'objectDomain', {1})"


def access_history(lineitem: DataFrame) -> DataFrame:
    """A log row per line with two objects: a table, and a second table, a view, an incomplete
    name or the library's own table. Some names are in lower case; some rows touch nothing."""
    second = "concat('D', cast(l_suppkey % 2 as string), '.S', cast(l_suppkey % 5 as string)," \
             " '.T', cast(l_suppkey as string))"
    main = _OBJECT.format(
        f"case when l_linenumber = 4 and t % 10 = 3 then lower({_NAME}) else {_NAME} end",
        "case when l_linenumber > 4 and l_partkey % 4 = 1 then 'View' else 'Table' end")
    other = _OBJECT.format(
        f"case l_linenumber when 1 then {second} when 5 then 'tablegauge.public.scan_runs'"
        " when 6 then 'D0.S1' else 'D0.SEM.V0' end",
        "case when l_linenumber in (1, 5, 6) then 'Table' else 'View' end")
    objects = f"array({main}, {other})"
    written = f"array({_OBJECT.format(_NAME, chr(39) + 'Table' + chr(39))})"
    return lineitem.selectExpr("*", f"{_HOT} as t").selectExpr(
        "cast(l_orderkey as string) as query_id",
        "concat('U', cast(l_orderkey div 3 as string)) as user_name",
        f"{_query_time('l_orderkey')} as query_start_time",
        f"case when l_quantity = 1 then array() else {objects} end as base_objects_accessed",
        f"""case when l_orderkey % 5 = 0 and l_linenumber = 7 then {written}
                 when l_orderkey % 17 = 0 then null
                 else array() end as objects_modified""",
    )


def query_history(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "cast(o_orderkey as string) as query_id",
        "case when o_orderkey % 19 > 0 then cast(o_custkey as string) end as session_id",
        "case when o_orderpriority = '5-LOW' then 'INSERT' else 'SELECT' end as query_type",
        "case when o_orderstatus = 'P' and o_orderkey % 4 = 0 then 'E1' end as error_code",
        "case when o_orderkey % 101 = 0 then 0 else o_totalprice / 100.0D end as execution_time",
        "case when o_orderkey % 23 > 0 then 'W1' end as warehouse_id",
        """case when o_orderkey % 31 = 0 then null
                else o_orderkey % 29 = 0 end as is_client_generated_statement""",
        """case when o_orderkey % 37 = 0 then 'PLATFORM_SERVICE'
                when o_orderkey % 2 = 0 then 'PERSON' end as user_type""",
        f"{_query_time('o_orderkey')} as start_time",
    )


def sessions(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "cast(c_custkey as string) as session_id",
        r"""case c_mktsegment
            when 'AUTOMOBILE' then '{"APPLICATION": "TableauDesktop"}'
            when 'BUILDING' then
                concat('{"APPLICATION": "Looker ', cast(c_nationkey as string), '"}')
            when 'HOUSEHOLD' then '{"APPLICATION": "streamlit", "OS": "Linux"}'
            when 'MACHINERY' then '{"APPLICATION": "PythonConnector"}'
            else '{bad' end as client_environment""",
    )


_PART_KEY = (
    "concat('D', cast(p_partkey % 2 as string)) as table_catalog",
    "concat('S', cast(p_partkey % 5 as string)) as table_schema",
)


def tables(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        *_PART_KEY,
        """case when p_partkey % 13 = 0 then concat('t', cast(p_partkey as string))
                else concat('T', cast(p_partkey as string)) end as table_name""",
        "case when p_partkey % 11 = 0 then 'VIEW' else 'BASE TABLE' end as table_type",
        f"{_ago('p_partkey * 7 % 90', 'p_partkey % 24')} as last_altered",
        f"case when p_partkey % 29 = 0 then {NOW} end as deleted",
    )


_VIEW_NAME = "case when s_suppkey % 10 = 1 then s_suppkey - 1 else s_suppkey end"


def semantic_views(supplier: DataFrame) -> DataFrame:
    """Every tenth view has a second version; some are deleted, some have no known age."""
    return supplier.selectExpr("*", f"{_VIEW_NAME} as v").selectExpr(
        "cast(s_suppkey as string) as semantic_view_id",
        "concat('D', cast(v % 2 as string)) as semantic_view_database_name",
        "'SEM' as semantic_view_schema_name",
        "concat('V', cast(v as string)) as semantic_view_name",
        """case when s_suppkey % 3 > 0 then repeat('c', cast(s_suppkey % 50 as int))
           end as comment""",
        f"""case when s_suppkey % 17 > 0 then {NOW} - make_dt_interval(400)
                 + make_dt_interval(0, cast(s_suppkey as int)) end as last_altered""",
        f"case when s_suppkey % 13 = 0 then {NOW} end as deleted",
    )


_Q = "cast(l_quantity as int)"


def _keys(condition: str) -> str:
    """An array that is filled, empty or unknown."""
    return f"case when {condition} then array('k') when {_Q} % 10 <> 4 then array() end"


def semantic_tables(lineitem: DataFrame) -> DataFrame:
    """Versions of the tables behind each view; a view of the rule below keeps a table,
    in all other cases the table has been deleted."""
    return lineitem.selectExpr("*", "l_partkey % 20 as t").selectExpr(
        "cast(l_suppkey as string) as semantic_view_id",
        "concat('m', cast(t as string)) as semantic_table_name",
        """case when t < 19 then concat(case when t % 4 = 0 then 'd' else 'D' end,
                cast(t % 2 as string)) end as base_table_database_name""",
        "concat('S', cast(t % 5 as string)) as base_table_schema_name",
        "concat('T', cast(t as string)) as base_table_name",
        f"{_keys(f'{_Q} % 2 = 1')} as primary_keys",
        f"{_keys(f'{_Q} % 5 = 0')} as unique_keys",
        f"{_keys(f'{_Q} % 7 = 0')} as distinct_ranges",
        f"{_keys(f'{_Q} % 4 = 0')} as synonyms",
        f"""case when {_Q} % 3 = 0 then null when {_Q} % 11 = 0 then ''
                 else repeat('t', {_Q}) end as comment""",
        "case when l_linenumber < 7 then l_shipdate end as last_altered",
        f"""case when (l_suppkey + t) % 9 <> 0 or l_suppkey % 4 = 0 or l_returnflag = 'R'
                 then {NOW} end as deleted""",
    )


def _members(lineitem: DataFrame, flag: str, name: str, gone: str) -> DataFrame:
    return lineitem.where(f"l_returnflag = '{flag}'").selectExpr(
        "cast(l_suppkey as string) as semantic_view_id",
        f"concat('n', cast(l_partkey % 7 as string)) as {name}",
        f"{_keys(f'{_Q} % 16 = 0')} as synonyms",
        f"""case when {_Q} % 3 = 1 then null when {_Q} % 13 = 0 then ''
                 else repeat('x', 2 * {_Q}) end as comment""",
        "l_shipdate as last_altered",
        f"case when {gone} then {NOW} end as deleted",
    )


def semantic_dimensions(lineitem: DataFrame) -> DataFrame:
    return _members(lineitem, "A", "semantic_dimension_name", "l_linestatus = 'F'")


def semantic_facts(lineitem: DataFrame) -> DataFrame:
    return _members(lineitem, "N", "semantic_fact_name", "l_linenumber = 3")


def semantic_metrics(lineitem: DataFrame) -> DataFrame:
    return _members(lineitem, "R", "semantic_metric_name", "l_suppkey % 3 > 0")


def semantic_relationships(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "cast(l_suppkey as string) as semantic_view_id",
        f"case when l_suppkey % 5 < 2 or l_linenumber > 1 then {NOW} end as deleted",
    )


def sv_properties(supplier: DataFrame) -> DataFrame:
    """Per view: own rows for verified queries, an extension with lists, and other rows.
    The extension's text is broken for some views."""
    count = "cast(v % 12 as int)"
    queries = f"array_join(array_repeat('{{\"q\": 1}}', {count}), ',')"
    text = f"""case when s_suppkey % 7 = 3 then '{{"verified_queries": [1,'
        when s_suppkey % 7 = 4 then '{{"other": 1}}'
        when s_suppkey % 7 = 5 then concat('{{"ai_verified_queries": [', {queries}, ']}}')
        else concat('{{"verified_queries": [', {queries}, '], "ai_verified_queries": [1]}}')
        end"""
    row = "named_struct('k', {0}, 'o', {1}, 'p', {2}, 'x', {3})"
    rows = f"""array(
        {row.format("'extension'", "'ca'", "'value'", text)},
        {row.format("'EXTENSION'", "'OTHER'", "'VALUE'", text)},
        {row.format("case when s_suppkey % 2 = 0 then 'AI_VERIFIED_QUERY' else 'TABLE' end",
                    "'q'", "'SQL'", "'select 1'")},
        {row.format("'Verified_Query'", "'r'", "'SQL'", "'select 2'")},
        {row.format("cast(null as string)", "cast(null as string)", "'COMMENT'", "''")}
    )"""
    return supplier.selectExpr("*", f"{_VIEW_NAME} as v").selectExpr(
        "v", f"explode({rows}) as r"
    ).selectExpr(
        "concat('D', cast(v % 2 as string)) as database_name",
        "'SEM' as schema_name", "concat('V', cast(v as string)) as name",
        "r.k as object_kind", "r.o as object_name", "r.p as property", "r.x as property_value",
    )


def catalog_tables(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        *_PART_KEY,
        "concat('T', cast(p_partkey as string)) as table_name",
        "case when p_partkey % 11 = 0 then 'VIEW' else 'BASE TABLE' end as table_type",
        """case when p_partkey % 5 = 4 then 10L
                else p_partkey * 37 % 25000 * 10 end as row_count""",
        "case when p_partkey % 3 = 0 then 'LINEAR(a)' end as clustering_key",
        f"{_ago('p_partkey * 7 % 15', 'p_partkey % 24', 'p_partkey % 60')} as last_altered",
        "case when p_partkey % 11 = 0 then 'VIEW' else 'TABLE' end as kind",
        "case when p_size % 2 = 0 then 'ON' else 'OFF' end as change_tracking",
    )


_COLUMN_NAME = """case l_linenumber
    when 1 then case when l_partkey % 5 = 3 then 'cust_ref' else 'customer_id' end
    when 2 then case when l_partkey % 5 = 2 then 'mail' else 'Email' end
    when 3 then 'customer_email' when 4 then 'x1' when 5 then 'order_date'
    when 6 then 'account' else 'n7' end"""


def catalog_columns(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_partkey", "l_linenumber").agg(
        {"l_quantity": "max", "l_tax": "max"}
    ).selectExpr(
        "concat('D', cast(l_partkey % 2 as string)) as table_catalog",
        "concat('S', cast(l_partkey % 5 as string)) as table_schema",
        "concat('T', cast(l_partkey as string)) as table_name",
        f"{_COLUMN_NAME} as column_name",
        "case when `max(l_quantity)` > 35 then 'YES' else 'NO' end as is_nullable",
        """case when `max(l_tax)` > 0.06 then 'c' when `max(l_tax)` > 0.03 then ''
           end as comment""",
    )


def catalog_constraints(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        *_PART_KEY,
        "concat('T', cast(p_partkey as string)) as table_name",
        """explode(array_compact(array(
            case when p_partkey % 3 = 0 then 'PRIMARY KEY' end,
            case when p_partkey % 4 = 0 then 'UNIQUE' end,
            case when p_partkey % 7 = 0 then 'FOREIGN KEY' end,
            'CHECK'))) as constraint_type""",
    )


def tag_references(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "concat('d', cast(p_partkey % 2 as string)) as object_database",
        "concat('S', cast(p_partkey % 5 as string)) as object_schema",
        """explode(array(concat('T', cast(p_partkey as string)),
            case when p_partkey % 8 = 0 then concat('t', cast(p_partkey as string))
                 else concat('T', cast(p_partkey as string)) end)) as object_name""",
        "case when p_partkey % 6 = 0 then 'TABLE' else 'COLUMN' end as domain",
    )


def policy_references(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "concat('D', cast(p_partkey % 2 as string)) as ref_database_name",
        "concat('s', cast(p_partkey % 5 as string)) as ref_schema_name",
        "concat('T', cast(p_partkey as string)) as ref_entity_name",
        "explode(array('email', 'customer_email', 'x1', 'EMAIL')) as ref_column_name",
        """case when p_partkey % 3 = 1 then 'MASKING_POLICY' else 'ROW_ACCESS_POLICY'
           end as policy_kind""",
    )


def scan_runs(events: DataFrame) -> DataFrame:
    """Stored runs, one per event, spread over five scopes and all five gaps."""
    shares = events.selectExpr(
        "*", "event_id % 9 as n_cr",
        "case when event_id % 11 > 0 then ((event_id * 29 + 60) % 101) / 100.0D end as demand",
        "case when event_id % 9 = 0 then 0 else (event_id * 37 % 101) / 100.0D end as cover",
        "(event_id * 53 % 101) / 100.0D as depth",
    )
    return shares.selectExpr(
        "concat('run-', cast(event_id as string)) as run_id",
        "ts as run_ts", "'account' as account_name", "event_type as role_name",
        """case when user_id % 5 = 0 then 'All databases'
                else concat('D', cast(user_id % 5 as string)) end as database_filter""",
        "case when event_id % 4 > 0 then cast(event_id % 4 * 10 as int) end as sample_pct",
        "round((coalesce(demand, 0) + sqrt(cover * depth)) / 2 * 100, 2) as ai_readiness",
        "round(coalesce(demand, 0) * 100, 2) as demand_coverage",
        "round(sqrt(cover * depth) * 100, 2) as sv_readiness",
        "round(cover * 100, 2) as sv_coverage", "round(depth * 100, 2) as sv_quality",
        "n_cr as n_cr_tables",
        """case when demand is null or n_cr = 0 or demand < 0.5 then 'BUILD_CR_TABLES'
                when cover = 0 then 'BUILD_SVS' when cover < 0.5 then 'EXPAND_SV_COVERAGE'
                when depth < 0.5 then 'IMPROVE_SV_QUALITY' else 'HEALTHY' end as gap""",
        "concat('text ', props) as recommendation_text",
        "event_id % 1000 as n_all_scored", "event_id % 100 as n_sv",
        "least(n_cr, event_id % 7) as n_sv_covered",
        "cast(null as string) as report_html_path",
    )


def scan_improvement_items(events: DataFrame) -> DataFrame:
    """Up to 17 items per stored run."""
    return events.selectExpr(
        "event_id", "value",
        "posexplode(array_repeat(0, cast(event_id % 18 as int))) as (i, unused)",
    ).selectExpr(
        "concat('run-', cast(event_id as string)) as run_id",
        "i + 1 as item_rank",
        """case event_id % 4 when 0 then 'SCHEMA_GAP' when 1 then 'UNCOVERED_CR_TABLE'
           when 2 then 'SV_QUALITY_GAP' else 'OTHER' end as item_type""",
        "concat('D1.S', cast(i as string)) as target",
        "concat('detail ', cast(event_id + i as string)) as detail",
        "concat('do ', cast(i as string)) as recommendation",
    )


#: Relation -> (source table, rule).
RULES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "access_history": ("lineitem", access_history),
    "query_history": ("orders", query_history),
    "sessions": ("customer", sessions),
    "tables": ("part", tables),
    "semantic_views": ("supplier", semantic_views),
    "semantic_tables": ("lineitem", semantic_tables),
    "semantic_dimensions": ("lineitem", semantic_dimensions),
    "semantic_facts": ("lineitem", semantic_facts),
    "semantic_metrics": ("lineitem", semantic_metrics),
    "semantic_relationships": ("lineitem", semantic_relationships),
    "sv_properties": ("supplier", sv_properties),
    "catalog_tables": ("part", catalog_tables),
    "catalog_columns": ("lineitem", catalog_columns),
    "catalog_constraints": ("part", catalog_constraints),
    "tag_references": ("part", tag_references),
    "policy_references": ("part", policy_references),
    "scan_runs": ("events", scan_runs),
    "scan_improvement_items": ("events", scan_improvement_items),
}


class DerivedEstate(Mapping[str, DataFrame]):
    """Estate relations by name, computed from the tables in ``folder`` on use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder
        self._sources: dict[str, DataFrame] = {}

    def source(self, table: str) -> DataFrame:
        if table not in self._sources:
            path = f"{self._folder}/{table}.parquet"
            self._sources[table] = self.spark.read.parquet(path)
        return self._sources[table]

    def __getitem__(self, name: str) -> DataFrame:
        table, rule = RULES[name]
        return rule(self.source(table))

    def __contains__(self, name: object) -> bool:
        return name in RULES

    def __iter__(self) -> Iterator[str]:
        return iter(RULES)

    def __len__(self) -> int:
        return len(RULES)
