"""The same answers in plain SQL, for an independent engine to check the Spark queries.

STEPS are named sub-queries; :func:`sql` puts those a query refers to in front of it. The
steps follow the definitions (windows, joins and sub-queries), not the Spark plans.
"""

from __future__ import annotations

import re

from tablegauge import constants as K
from tablegauge.operators.sixfactor import CHECKS
from tablegauge.sources.derived import AS_OF

NOW = f"timestamp '{AS_OF}'"
SOURCES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _ago(days: str, hours: str = "0", minutes: str = "0") -> str:
    return (f"{NOW} - to_days(cast({days} as integer)) - to_hours(cast({hours} as integer))"
            f" - to_minutes(cast({minutes} as integer))")


def _query_time(key: str) -> str:
    return _ago(f"(case when {key} % 3 = 0 then {key} % 45 else {key} % 14 end)", f"({key} % 24)")


def _name(key: str) -> str:
    return f"'D' || ({key}) % 2 || '.S' || ({key}) % 5 || '.T' || ({key})"


def _keys(condition: str) -> str:
    return f"case when {condition} then ['k'] when q % 10 <> 4 then [] end"


def _member(flag: str, kind: str, gone: str) -> str:
    return f"""select l_suppkey as view_id, '{kind}' as kind, 'n' || l_partkey % 7 as name,
        {_keys('q % 16 = 0')} as synonyms,
        case when q % 3 = 1 then null when q % 13 = 0 then '' else repeat('x', 2 * q) end as comment,
        l_shipdate as last_altered, {gone} as gone
        from lines where l_returnflag = '{flag}'"""


_LIKES = " or ".join(
    [f"lower(application_name) like '%{f.lower()}%'" for f in K.BI_NAME_FRAGMENTS]
    + [f"application_name = '{n}'" for n in K.BI_EXACT_NAMES]
)
_PK = "database_name, schema_name, table_name"
_CR = 0.80

STEPS: dict[str, str] = {
    # ---- relations derived from the order-entry tables ----
    "lines": """select *, cast(l_quantity as integer) as q,
        case when l_linenumber <= 4 then l_partkey % 20 else l_partkey end as t from lineitem""",
    "access_rows": f"""select l_orderkey, l_partkey, l_suppkey, l_linenumber, t,
        cast(l_orderkey as varchar) as query_id, 'U' || (l_orderkey // 3) as user_name,
        {_query_time('l_orderkey')} as query_start_time, l_quantity = 1 as reads_nothing,
        l_orderkey % 5 = 0 and l_linenumber = 7 as writes from lines""",
    "read_objects": f"""
        select *, case when l_linenumber = 4 and t % 10 = 3 then lower({_name('t')})
                       else {_name('t')} end as full_table_name,
            case when l_linenumber > 4 and l_partkey % 4 = 1 then 'View' else 'Table' end as domain
            from access_rows where not reads_nothing
        union all select *, {_name('l_suppkey')}, 'Table' from access_rows
            where not reads_nothing and l_linenumber = 1
        union all select *, 'D0.S1', 'Table' from access_rows
            where not reads_nothing and l_linenumber = 6
        union all select *, 'tablegauge.public.scan_runs', 'Table' from access_rows
            where not reads_nothing and l_linenumber = 5""",
    "named_objects": """select *, upper(split_part(full_table_name, '.', 1)) as database_name,
        upper(split_part(full_table_name, '.', 2)) as schema_name,
        upper(split_part(full_table_name, '.', 3)) as table_name
        from read_objects where domain = 'Table'""",
    "query_history": f"""select cast(o_orderkey as varchar) as query_id,
        case when o_orderkey % 19 > 0 then cast(o_custkey as varchar) end as session_id,
        case when o_orderpriority = '5-LOW' then 'INSERT' else 'SELECT' end as query_type,
        case when o_orderstatus = 'P' and o_orderkey % 4 = 0 then 'E1' end as error_code,
        case when o_orderkey % 101 = 0 then 0 else o_totalprice / 100.0 end as execution_time,
        case when o_orderkey % 23 > 0 then 'W1' end as warehouse_id,
        case when o_orderkey % 31 = 0 then null else o_orderkey % 29 = 0 end as is_client,
        case when o_orderkey % 37 = 0 then 'PLATFORM_SERVICE' when o_orderkey % 2 = 0
             then 'PERSON' end as user_type,
        {_query_time('o_orderkey')} as start_time from orders""",
    "sessions": """select cast(c_custkey as varchar) as session_id, case c_mktsegment
        when 'AUTOMOBILE' then 'TableauDesktop' when 'BUILDING' then 'Looker ' || c_nationkey
        when 'HOUSEHOLD' then 'streamlit' when 'MACHINERY' then 'PythonConnector'
        end as application_name from customer""",
    "account_tables": f"""select 'D' || p_partkey % 2 as database_name,
        'S' || p_partkey % 5 as schema_name, 'T' || p_partkey as table_name,
        case when p_partkey % 11 = 0 then 'VIEW' else 'BASE TABLE' end as table_type,
        {_ago('(p_partkey * 7 % 90)', '(p_partkey % 24)')} as last_altered,
        p_partkey % 29 = 0 as gone from part""",
    "semantic_views": f"""select s_suppkey as view_id,
        'D' || v % 2 || '.SEM.V' || v as sv_fqn, v,
        case when s_suppkey % 3 > 0 then repeat('c', cast(s_suppkey % 50 as integer)) end
            as view_comment,
        case when s_suppkey % 17 > 0 then s_suppkey end as age_order, s_suppkey % 13 = 0 as gone
        from (select *, case when s_suppkey % 10 = 1 then s_suppkey - 1 else s_suppkey end as v
              from supplier)""",
    "semantic_tables": f"""select l_suppkey as view_id, 'm' || b as name,
        case when b < 19 then case when b % 4 = 0 then 'd' else 'D' end || b % 2 end as raw_database,
        'S' || b % 5 as raw_schema, 'T' || b as raw_table,
        {_keys('q % 2 = 1')} as primary_keys, {_keys('q % 5 = 0')} as unique_keys,
        {_keys('q % 7 = 0')} as distinct_ranges, {_keys('q % 4 = 0')} as synonyms,
        case when q % 3 = 0 then null when q % 11 = 0 then '' else repeat('t', q) end as comment,
        case when l_linenumber < 7 then l_shipdate end as last_altered,
        (l_suppkey + b) % 9 <> 0 or l_suppkey % 4 = 0 or l_returnflag = 'R' as gone
        from (select *, l_partkey % 20 as b from lines)""",
    "semantic_members": " union all ".join((
        _member("A", "dimension", "l_linestatus = 'F'"), _member("N", "fact", "l_linenumber = 3"),
        _member("R", "metric", "l_suppkey % 3 > 0"))),
    "semantic_relationships": """select l_suppkey as view_id from lineitem
        where not (l_suppkey % 5 < 2 or l_linenumber > 1)""",
    # One extension row (lists in its text) and one or two own rows per view version.
    "sv_properties": """select 'D' || v % 2 || '.SEM.V' || v as sv_fqn,
        case s_suppkey % 7 when 3 then 0 when 4 then 0 when 5 then v % 12 else v % 12 + 1 end
        + case when s_suppkey % 2 = 0 then 1 else 0 end + 1 as found
        from (select *, case when s_suppkey % 10 = 1 then s_suppkey - 1 else s_suppkey end as v
              from supplier)""",
    "catalog_tables": f"""select p_partkey as p, 'D' || p_partkey % 2 as database_name,
        'S' || p_partkey % 5 as schema_name, 'T' || p_partkey as table_name,
        p_partkey % 11 > 0 as is_base,
        case when p_partkey % 5 = 4 then 10 else p_partkey * 37 % 25000 * 10 end as row_count,
        p_partkey % 3 = 0 as is_clustered, p_size % 2 = 0 as is_tracked,
        {_ago('(p_partkey * 7 % 15)', '(p_partkey % 24)', '(p_partkey % 60)')} as last_altered
        from part""",
    "base_tables": "select * from catalog_tables where is_base",
    "catalog_columns": """select l_partkey as p, max(l_quantity) <= 35 as is_required,
        case when max(l_tax) > 0.06 then 'c' when max(l_tax) > 0.03 then '' end as comment,
        case l_linenumber when 1 then case when l_partkey % 5 = 3 then 'cust_ref' else 'customer_id' end
            when 2 then case when l_partkey % 5 = 2 then 'mail' else 'Email' end
            when 3 then 'customer_email' when 4 then 'x1' when 5 then 'order_date'
            when 6 then 'account' else 'n7' end as column_name
        from lineitem group by l_partkey, l_linenumber""",
    "base_columns": f"""select {_PK}, column_name, comment, is_required
        from catalog_columns join base_tables using (p)""",
    "constraints": """select p_partkey as p, unnest(['PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY']) as kind,
        unnest([p_partkey % 3 = 0, p_partkey % 4 = 0, p_partkey % 7 = 0]) as declared from part""",
    "tagged": """select p_partkey as p, 'T' || p_partkey as object_name from part
        where p_partkey % 6 = 0 union select p_partkey, 't' || p_partkey from part
        where p_partkey % 6 = 0 and p_partkey % 8 = 0""",
    "masked": """select p_partkey as p, unnest(['EMAIL', 'CUSTOMER_EMAIL', 'X1']) as column_name
        from part where p_partkey % 3 = 1""",
    "scan_runs": """select 'run-' || event_id as run_id, ts as run_ts, 'account' as account_name,
        event_type as role_name,
        case when user_id % 5 = 0 then 'All databases' else 'D' || user_id % 5 end as database_filter,
        case when event_id % 4 > 0 then cast(event_id % 4 * 10 as integer) end as sample_pct,
        round((coalesce(demand, 0) + sqrt(cover * depth)) / 2 * 100, 2) as ai_readiness,
        round(coalesce(demand, 0) * 100, 2) as demand_coverage,
        round(sqrt(cover * depth) * 100, 2) as sv_readiness, round(cover * 100, 2) as sv_coverage,
        round(depth * 100, 2) as sv_quality, n_cr as n_cr_tables,
        case when demand is null or n_cr = 0 or demand < 0.5 then 'BUILD_CR_TABLES'
             when cover = 0 then 'BUILD_SVS' when cover < 0.5 then 'EXPAND_SV_COVERAGE'
             when depth < 0.5 then 'IMPROVE_SV_QUALITY' else 'HEALTHY' end as gap,
        'text ' || props as recommendation_text, event_id % 1000 as n_all_scored,
        event_id % 100 as n_sv, least(n_cr, event_id % 7) as n_sv_covered,
        cast(null as varchar) as report_html_path
        from (select *, event_id % 9 as n_cr,
            case when event_id % 11 > 0 then ((event_id * 29 + 60) % 101) / 100.0::double end as demand,
            case when event_id % 9 = 0 then 0 else (event_id * 37 % 101) / 100.0::double end as cover,
            (event_id * 53 % 101) / 100.0::double as depth from events)""",
    "scan_items": """select 'run-' || event_id as run_id, cast(i + 1 as integer) as item_rank,
        case event_id % 4 when 0 then 'SCHEMA_GAP' when 1 then 'UNCOVERED_CR_TABLE'
            when 2 then 'SV_QUALITY_GAP' else 'OTHER' end as item_type,
        'D1.S' || i as target, 'detail ' || (event_id + i) as detail, 'do ' || i as recommendation
        from (select event_id, unnest(range(event_id % 18)) as i from events)""",
    # ---- reads ----
    "accesses": f"""select query_id, user_name, query_start_time, full_table_name, {_PK}
        from named_objects
        where cast(query_start_time as date) between date '2024-01-24' and date '2024-01-31'
          and not writes and l_orderkey % 17 <> 0 and schema_name <> '' and table_name <> ''
          and not (database_name = 'TABLEGAUGE' and schema_name = 'PUBLIC'
                   and table_name in ('SCAN_RUNS', 'SCAN_IMPROVEMENT_ITEMS'))""",
    "apps": f"""select session_id, application_name,
        case when {_LIKES} then 1 end as is_bi_or_dashboard from sessions""",
    "eligible": """select * from query_history where query_type = 'SELECT' and error_code is null
        and execution_time > 0 and warehouse_id is not null and is_client = false
        and (user_type is null or user_type <> 'PLATFORM_SERVICE')
        and cast(start_time as date) between date '2024-01-24' and date '2024-01-31'""",
    "reads": f"""select {_PK}, full_table_name, a.query_id, a.user_name,
        e.execution_time as execution_time_ms, s.application_name, s.is_bi_or_dashboard
        from accesses a join eligible e on a.query_id = e.query_id
        left join apps s on e.session_id = s.session_id""",
    "per_table": f"""select {_PK}, full_table_name, count(*) as analytical_reads,
        count(distinct user_name) as distinct_users, count(is_bi_or_dashboard) as app_reads,
        count(distinct case when is_bi_or_dashboard = 1 then application_name end)
            as distinct_app_tools,
        percentile_cont(0.5) within group (order by execution_time_ms) as p50_execution_ms
        from reads group by all having count(*) >= 5""",
    "ages": f"""select {_PK}, datediff('day', last_altered, {NOW}) as days_since_update
        from account_tables where not gone and table_type = 'BASE TABLE'
        and last_altered >= {NOW} - interval 60 days""",
    "fresh": f"select * from per_table left join ages using ({_PK})",
    "scoped": """select 'All databases' as scope, * from fresh
        union all select database_name, * from fresh""",
    "ranked": """select *,
        percent_rank() over (partition by scope order by analytical_reads) as activity_pctile,
        percent_rank() over (partition by scope order by distinct_users) as user_pctile,
        percent_rank() over (partition by scope order by app_reads) as app_pctile from scoped""",
    "signals": f"""select *, greatest(user_pctile, app_pctile) as c,
        1.0 / (1.0 + pow(p50_execution_ms / 5000.0, 3)) as s,
        exp(-ln(2) / 30.0 * coalesce(days_since_update, 60)) as f from ranked""",
    "cr": f"""select scope, {_PK}, full_table_name, analytical_reads, distinct_users, app_reads,
        distinct_app_tools, round(activity_pctile, 4) as activity_score,
        round(c, 4) as consumption_score, round(s, 4) as speed_score, round(f, 4) as freshness_score,
        round(pow(greatest(activity_pctile, 0.001), 0.35) * pow(greatest(c, 0.001), 0.30)
            * pow(greatest(s, 0.001), 0.20) * pow(greatest(f, 0.001), 0.15), 4)
            as consumption_readiness_score from signals""",
    "cr_set": f"""select distinct scope, {_PK} from cr
        where consumption_readiness_score >= {_CR}""",
    "cr_rows": f"""select cr.*, cr_set.scope is not null as is_cr from cr left join cr_set
        on cr.scope = cr_set.scope and cr.database_name = cr_set.database_name
        and cr.schema_name = cr_set.schema_name and cr.table_name = cr_set.table_name""",
    # ---- semantic views ----
    "views": """select view_id, sv_fqn, view_comment from (select *, row_number() over
        (partition by sv_fqn order by age_order desc nulls last, view_id desc) as n
        from semantic_views where not gone) where n = 1""",
    "view_tables": """select *, upper(raw_database) as base_database, upper(raw_schema) as base_schema,
        upper(raw_table) as base_table from (select *, row_number() over (
            partition by view_id, name order by last_altered desc nulls last,
            primary_keys desc nulls last, unique_keys desc nulls last,
            distinct_ranges desc nulls last, synonyms desc nulls last, comment desc nulls last) as n
        from semantic_tables where not gone) where n = 1""",
    "view_members": """select * from (select *, row_number() over (
            partition by view_id, kind, name order by last_altered desc nulls last,
            synonyms desc nulls last, comment desc nulls last) as n
        from semantic_members where not gone) where n = 1""",
    "view_bases": """select distinct view_id, base_database, base_schema, base_table from view_tables
        where base_database is not null and base_table is not null""",
    "table_signals": """select view_id,
        coalesce(bool_or(len(primary_keys) > 0), false) as has_pk,
        coalesce(bool_or(len(unique_keys) > 0), false) as has_unique_keys,
        coalesce(bool_or(len(distinct_ranges) > 0), false) as has_distinct_ranges,
        coalesce(bool_or(len(synonyms) > 0), false) as tbl_has_synonyms
        from view_tables group by view_id""",
    "member_synonyms": """select view_id, kind, coalesce(bool_or(len(synonyms) > 0), false)
        as has_synonyms from view_members group by view_id, kind""",
    "comments": """select view_id, view_comment as comment from views
        union all select view_id, comment from view_tables
        union all select view_id, comment from view_members""",
    "comment_depth": """select v.view_id, round(sum(length(c.comment)) / nullif(count(c.comment), 0), 1)
        as avg_comment_length from views v left join comments c on v.view_id = c.view_id
        group by v.view_id""",
    "vqr": "select sv_fqn, cast(sum(found) as bigint) as n_verified_queries from sv_properties "
           "group by sv_fqn",
    "sv_flags": """select v.sv_fqn, v.view_id, coalesce(t.has_pk, false) as has_pk,
        coalesce(t.tbl_has_synonyms, false) or exists (select 1 from member_synonyms m
            where m.view_id = v.view_id and m.has_synonyms) as has_synonyms,
        coalesce(t.has_unique_keys, false) as has_unique_keys,
        coalesce(t.has_distinct_ranges, false) as has_distinct_ranges,
        v.view_id in (select view_id from semantic_relationships) as has_relationships,
        v.view_id in (select view_id from view_members where kind = 'metric') as has_metrics,
        coalesce(c.avg_comment_length, 0.0) as avg_comment_length,
        coalesce(q.n_verified_queries, 0) as n_verified_queries
        from views v left join table_signals t on v.view_id = t.view_id
        left join comment_depth c on v.view_id = c.view_id left join vqr q on v.sv_fqn = q.sv_fqn""",
    "sv": """select f.sv_fqn, b.base_database, b.base_schema, b.base_table, has_pk, has_synonyms,
        has_unique_keys, has_distinct_ranges, has_relationships, has_metrics, avg_comment_length,
        n_verified_queries, round((has_pk::int + has_synonyms::int + has_unique_keys::int
            + has_distinct_ranges::int + has_relationships::int + has_metrics::int
            + 2 * (1 - exp(-(ln(10) / 10) * n_verified_queries))
            + 1 - exp(-(ln(100) / 100) * avg_comment_length)) / 9.0, 4) as quality_score
        from sv_flags f left join view_bases b on f.view_id = b.view_id""",
    # ---- composite ----
    "scopes": """select 'All databases' as scope union select distinct database_name
        from catalog_tables""",
    "demand": """select scope, count(*) as n_all_scored, sum(analytical_reads) as total_reads,
        sum(case when is_cr then analytical_reads else 0 end) as reads_on_cr
        from cr_rows group by scope""",
    "cr_count": "select scope, count(*) as n_cr_tables from cr_set group by scope",
    "covered": f"""select distinct scope, {_PK} from cr_set join sv on database_name = base_database
        and schema_name = base_schema and table_name = base_table""",
    "covered_count": "select scope, count(*) as n_sv_covered from covered group by scope",
    "relevant": """select distinct scope, sv_fqn, has_pk, has_synonyms, has_unique_keys,
        has_relationships, has_metrics, n_verified_queries, quality_score from cr_set join sv
        on database_name = base_database and schema_name = base_schema
        and table_name = base_table""",
    "depth": """select scope, avg(quality_score) as q, avg(has_pk::int) as has_pk,
        avg(has_synonyms::int) as has_synonyms, avg(has_metrics::int) as has_metrics,
        avg(has_relationships::int) as has_relationships from relevant group by scope""",
    "shares": """select scope, coalesce(n_all_scored, 0) as n_all_scored,
        coalesce(n_cr_tables, 0) as n_cr_tables, coalesce(n_sv_covered, 0) as n_sv_covered,
        (select count(distinct sv_fqn) from sv) as n_sv,
        case when total_reads >= 10 then reads_on_cr / total_reads end as demand,
        coalesce(n_sv_covered / n_cr_tables, 0.0) as cover, coalesce(q, 0.0) as depth,
        concat_ws(', ', case when has_pk < 0.5 then 'primary keys' end,
            case when has_synonyms < 0.5 then 'synonyms' end,
            case when has_metrics < 0.5 then 'metrics' end,
            case when has_relationships < 0.5 then 'relationships' end) as missing_dims
        from scopes left join demand using (scope) left join cr_count using (scope)
        left join covered_count using (scope) left join depth using (scope)""",
    "composite": """select scope,
        round((coalesce(demand, 0) + sqrt(cover * depth)) / 2 * 100, 2) as ai_readiness,
        round(coalesce(demand, 0) * 100, 2) as demand_coverage,
        round(sqrt(cover * depth) * 100, 2) as sv_readiness, round(cover * 100, 2) as sv_coverage,
        round(depth * 100, 2) as sv_quality, n_cr_tables,
        case when demand is null or n_cr_tables = 0 or demand < 0.5 then 'BUILD_CR_TABLES'
             when cover = 0 then 'BUILD_SVS' when cover < 0.5 then 'EXPAND_SV_COVERAGE'
             when depth < 0.5 then 'IMPROVE_SV_QUALITY' else 'HEALTHY' end as gap,
        n_all_scored, n_sv, n_sv_covered, demand, cover, depth, missing_dims from shares""",
    "schema_items": """select scope, 'SCHEMA_GAP' as item_type, missed as ord, target,
        format('{:,}', reads) || ' reads across ' || n || ' tables, ' || n_cr || ' CR' as detail,
        format('{:,}', missed) || ' reads miss ready tables' as recommendation
        from (select scope, database_name || '.' || schema_name as target, count(*) as n,
            cast(sum(analytical_reads) as bigint) as reads,
            cast(sum(is_cr::int) as bigint) as n_cr, cast(sum(
            case when is_cr then 0 else analytical_reads end) as bigint) as missed
            from cr_rows group by scope, database_name, schema_name)
        where reads >= 10""",
    "table_items": f"""select scope, 'UNCOVERED_CR_TABLE' as item_type, analytical_reads as ord,
        database_name || '.' || schema_name || '.' || table_name as target,
        format('{{:,}}', analytical_reads) || ' reads, ' || distinct_users || ' distinct users'
            as detail,
        'not in any view' as recommendation, full_table_name
        from cr_rows where is_cr and (scope, {_PK}) not in (select (scope, {_PK}) from covered)""",
    "view_items": """select scope, 'SV_QUALITY_GAP' as item_type, quality_score as ord,
        sv_fqn as target,
        'Quality: ' || cast(round(quality_score * 100) as bigint) || '/100' as detail,
        case when len(missing) > 0 then 'without ' || array_to_string(missing[1:4], ', ')
             else 'thin comments or few verified queries' end as recommendation
        from (select *, list_filter([case when not has_pk then 'primary key' end,
            case when not has_synonyms then 'synonyms' end,
            case when not has_metrics then 'metrics' end,
            case when not has_relationships then 'relationships' end,
            case when not has_unique_keys then 'unique keys' end,
            case when n_verified_queries = 0 then 'verified queries' end],
            lambda x: x is not null) as missing from relevant where quality_score < 0.5)""",
    "schema_top": """select * from (select *, row_number() over (partition by scope
        order by ord desc, target) as item_rank from schema_items) where item_rank <= 10""",
    "table_top": """select * from (select *, row_number() over (partition by scope
        order by ord desc, target, full_table_name) as item_rank from table_items)
        where item_rank <= 10""",
    "view_top": """select * from (select *, row_number() over (partition by scope
        order by ord, target) as item_rank from view_items) where item_rank <= 10""",
    "all_items": """select * exclude (ord) from schema_top
            where scope in (select scope from composite where gap = 'BUILD_CR_TABLES')
        union all select * exclude (ord, full_table_name) from table_top where scope in
            (select scope from composite where gap in ('BUILD_SVS', 'EXPAND_SV_COVERAGE'))
        union all select * exclude (ord) from view_top
            where scope in (select scope from composite where gap = 'IMPROVE_SV_QUALITY')""",
    "targets": """select scope, coalesce(string_agg(target, ', ' order by item_rank)
        filter (where item_rank <= 5 and gap in
                ('BUILD_CR_TABLES', 'BUILD_SVS', 'EXPAND_SV_COVERAGE')), '') as top_targets
        from composite left join all_items using (scope) group by scope""",
    # ---- six factors ----
    "schema_list": "select distinct database_name, schema_name from catalog_tables",
    "recent": f"""select * from access_rows where query_start_time >= {NOW} - interval 30 days""",
    "tables_read": f"""select distinct {_PK} from named_objects
        where query_start_time >= {NOW} - interval 30 days""",
    "tables_written": f"select distinct 'T' || t as table_name from recent where writes",
    "id_tables": f"""select distinct {_PK} from base_columns
        where regexp_full_match(lower(column_name), '{K.FK_COLUMN_PATTERN}')""",
}


def _check_sql(numerator: str, denominator: str, source: str) -> str:
    """A ratio per schema over ``source``, with a row for schemas that have nothing."""
    return f"""select s.database_name, s.schema_name, coalesce(n, 0) as numerator,
        coalesce(d, 0) as denominator from schema_list s left join (
            select database_name, schema_name, cast({numerator} as bigint) as n,
            cast({denominator} as bigint) as d from {source} group by database_name, schema_name) r
        on s.database_name = r.database_name and s.schema_name = r.schema_name"""


def _flagged(condition: str) -> str:
    return _check_sql(f"count_if({condition})", "count(*)", "base_tables")


def _masking(match: str) -> str:
    name = f"regexp_{match}(lower(c.column_name), '{K.PII_COLUMN_PATTERN}')"
    source = f"""(select b.database_name, b.schema_name, m.p is not null as is_masked
        from catalog_columns c join base_tables b on c.p = b.p left join masked m
        on m.p = c.p and m.column_name = upper(c.column_name) where {name})"""
    return _check_sql("count_if(is_masked)", "count(*)", source)


_UNIQUE = _flagged(
    "p in (select p from constraints where declared and kind in ('PRIMARY KEY', 'UNIQUE'))")
STEPS |= {
    "check_data_completeness": _check_sql("count_if(is_required)", "count(*)", "base_columns"),
    "check_uniqueness": _UNIQUE,
    "check_referential_integrity": f"""select s.database_name, s.schema_name,
        (select count(*) from id_tables i where i.database_name = s.database_name
            and i.schema_name = s.schema_name and i.table_name in (select 'T' || p
            from constraints where declared and kind = 'FOREIGN KEY')) as numerator,
        greatest((select count(*) from id_tables i where i.database_name = s.database_name
            and i.schema_name = s.schema_name), 1) as denominator from schema_list s""",
    "check_semantic_documentation": _flagged(
        f"({_PK}) in (select (upper(raw_database), upper(raw_schema), upper(raw_table))"
        " from semantic_tables where not gone and raw_database is not null)"),
    "check_entity_identifier_declaration": _UNIQUE,
    "check_schema_type_coverage": _check_sql(
        "count_if((comment is not null and comment <> '')"
        f" or regexp_full_match(lower(column_name), '{K.SEMANTIC_ROLE_PATTERN}'))",
        "count(*)", "base_columns"),
    "check_access_optimization": _check_sql(
        "count_if(is_clustered)", "count(*)", "(select * from base_tables where row_count > 10000)"),
    "check_change_detection": _flagged("is_tracked"),
    "check_data_freshness": _flagged(f"datediff('hour', last_altered, {NOW}) <= 168"),
    "check_data_provenance": _flagged(f"({_PK}) in (select ({_PK}) from tables_read)"),
    "check_lineage_completeness": _flagged("table_name in (from tables_written)"),
    "check_classification": _check_sql(
        "count(distinct object_name)", "count(distinct table_name)",
        "(select b.*, object_name from base_tables b left join tagged on b.p = tagged.p)"),
    "check_column_masking": _masking("full_match"),
    "requirements": " union all ".join(
        f"""select database_name, schema_name, '{c.factor}' as factor,
        '{c.requirement}' as requirement, '{c.label}' as label, numerator, denominator,
        numerator::double / nullif(denominator::double, 0) as value
        from check_{c.requirement}""" for c in CHECKS),
    "factor_scores": """select database_name, schema_name, factor, avg(value) as score
        from requirements group by all""",
    "overalls": """select database_name, schema_name, avg(score) as overall from factor_scores
        group by all""",
}
_RATIO = "database_name, schema_name, numerator, denominator, " \
         "round(numerator::double / nullif(denominator::double, 0), 6) as value"
_TIER = "case when overall is null then 'N/A' when overall >= 0.7 then 'High' " \
        "when overall >= 0.4 then 'Medium' else 'Low' end"


def _refers_to(text: str) -> list[str]:
    """Steps a query reads."""
    names = re.findall(r"\b(?:from|join)\s+([a-z_0-9]+)", text)
    return [name for name in dict.fromkeys(names) if name in STEPS]


def sql(query: str, **limits: str) -> str:
    """The query with every step it needs in front of it, each after the ones it reads.

    ``limits`` gives conditions that rows of a step must meet besides.
    """
    ordered: dict[str, str] = {}

    def place(text: str) -> None:
        for name in _refers_to(text):
            if name not in ordered:
                place(STEPS[name])
                step = STEPS[name]
                if name in limits:
                    step = f"select * from ({step}) where {limits[name]}"
                ordered[name] = f"{name} as ({step})"

    place(query)
    return f"with {', '.join(ordered.values())} {query}" if ordered else query


def _bands(value: str, bounds, top, sign: str = "<=") -> str:
    cases = " ".join(f"when {value} {sign} {bound} then {result}" for bound, result in bounds)
    return f"case {cases} else {top} end"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _labels(column: str, labels: dict[str, str]) -> str:
    cases = " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in labels.items())
    return f"case {column} {cases} else {column} end"


_STAGE = _bands("ai_readiness", [(b, n) for n, (b, _) in enumerate(K.STAGES, 1)], len(K.STAGES))
_TITLE = _bands("ai_readiness", [(b, _quoted(t)) for b, t in K.STAGES], _quoted(K.STAGES[-1][1]))

_ADVICE = _bands("ai_readiness", [
    (b, _quoted(t)) for (b, _), t in zip(K.STAGES, K.STAGE_TEXTS)], _quoted(K.STAGE_TEXTS[-1]))


def _colour(value: str) -> str:
    return _bands(value, [(b, _quoted(t)) for b, t in K.COLOUR_BANDS], _quoted(K.COLOUR_TOP))


def _dimension_rows() -> str:
    rows = []
    for dimension, column in K.DIMENSION_COLUMNS.items():
        *bounded, (_, top) = K.DIMENSION_TEXTS[dimension]
        text = _bands(column, [(b, _quoted(t)) for b, t in bounded], _quoted(top),
                      "<=" if dimension == "AI Readiness" else "<")
        unit = _quoted(K.DIMENSION_UNITS[dimension] + " - ")
        rows.append(f"""select run_id, '{dimension}' as dimension, {column} as score,
            {_colour(column)} as band,
            cast(cast(round({column}) as bigint) as varchar) || {unit} || {text} as interpretation
            from scan_runs""")
    return " union all ".join(rows)


_OWN = "greatest(" + ", ".join(f"round({c}, 1)" for c in K.DIMENSION_COLUMNS.values()) + ", 27.1)"
STEPS |= {
    "interpretations": _dimension_rows(),
    "run_ends": f"select *, cast(ceil({_OWN}) as bigint) as axis_max from scan_runs",
    "peers": "select * from (values " + ", ".join(
        f"({_quoted(d)}, {_quoted(p)}, {m}::double)"
        for d, medians in K.PEER_MEDIANS.items() for p, m in zip(K.PEERS, medians)
    ) + ") v(dimension, peer, peer_median)",
    "own": " union all ".join(
        f"select run_id, axis_max, '{d}' as dimension, round({c}, 1) as score from run_ends"
        for d, c in K.DIMENSION_COLUMNS.items()),
    "opportunities": f"""select run_id, position, {_labels('item_type', K.ITEM_TAGS)} as tag,
        target, detail, recommendation from (select *, cast(row_number() over
        (partition by run_id order by item_rank) as integer) as position from scan_items)
        where position <= 15""",
}


def _summary(account: str = "account") -> str:
    """The recommendation text over composite rows joined to their targets."""
    def grade(share: str, strong: float = 0.5) -> str:
        return f"case when {share} >= {strong} then 'strong' when {share} >= 0.5 then 'fair' else 'weak' end"

    pct = "cast(round({} * 100) as bigint) || '% (' || "
    return f"""concat_ws('; ', '{account}: ' || cast(round(ai_readiness) as bigint) || ' of 100',
        'reads on ready tables ' || {pct.format('coalesce(demand, 0)')}
            {grade('coalesce(demand, 0)', 0.7)} || ', ' || n_cr_tables || ' ready)',
        case when n_cr_tables > 0 then 'ready tables in views ' || {pct.format('cover')}
            {grade('cover')} || ', ' || n_sv_covered || ' of ' || n_cr_tables || ')' end,
        case when depth > 0 then 'depth of views ' || printf('%.2f', depth) || ' ('
            || {grade('depth')} || case when depth < 0.5 and missing_dims <> ''
            then ', lacking ' || replace(missing_dims, ', ', ' and ') else '' end || ')' end,
        'to do: ' || case gap when 'BUILD_CR_TABLES' then 'prepare busy tables'
            when 'BUILD_SVS' then 'create views'
            when 'EXPAND_SV_COVERAGE' then 'reach more tables with views'
            when 'IMPROVE_SV_QUALITY' then 'complete the views' else 'nothing' end
            || case when top_targets <> '' then ' in ' || top_targets else '' end)"""


_RUNS = """run_id, run_ts, account_name, role_name, database_filter, sample_pct, ai_readiness,
    demand_coverage, sv_readiness, sv_coverage, sv_quality, n_cr_tables, gap, recommendation_text,
    n_all_scored, n_sv, n_sv_covered, report_html_path"""
_ITEM = "scope, item_rank, item_type, target, detail, recommendation"
_SV = """sv_fqn, {} has_pk, has_synonyms, has_unique_keys, has_distinct_ranges,
    has_relationships, has_metrics, avg_comment_length, n_verified_queries, quality_score"""
_SAMPLE = "cast('0x' || substr(md5(query_id), 1, 8) as bigint) % 100 < 30"


def _both(*queries: str) -> str:
    return " union all ".join(f"select * from ({query})" for query in queries)


_PER_TABLE = f"""select {_PK}, full_table_name, analytical_reads, distinct_users, app_reads,
    distinct_app_tools, round(p50_execution_ms, 6) as p50_execution_ms,
    cast({{}} as integer) as sample_pct from per_table"""


def _saved(call: str, account: str, role: str = "role", where: str = "true", **limits) -> str:
    """Runs that a call has saved."""
    return sql(f"""select md5('{call}|' || scope) as run_id, {NOW} as run_ts,
        '{account}' as account_name, '{role}' as role_name, scope as database_filter,
        cast(null as integer) as sample_pct, ai_readiness, demand_coverage, sv_readiness,
        sv_coverage, sv_quality, n_cr_tables, gap,
        {_summary(account)} as recommendation_text, n_all_scored, n_sv,
        n_sv_covered, cast(null as varchar) as report_html_path
        from composite join targets using (scope) where {where}""", **limits)


def _saved_items(call: str, where: str = "true", **limits) -> str:
    return sql(f"""select md5('{call}|' || scope) as run_id, item_rank, item_type, target, detail,
        recommendation from all_items where {where}""", **limits)


_ONE, _BARE = "scope = 'D1'", {"semantic_views": "false"}


def check_key(requirement: str) -> str:
    """Name of the query of a requirement."""
    return f"check_{requirement.removesuffix('_declaration')}"


#: Columns of the source tables, each with the way it is written in a digest.
_COLUMNS = {
    "region": "r_regionkey:text r_name:text",
    "nation": "n_nationkey:text n_name:text n_regionkey:text",
    "customer": "c_custkey:text c_name:text c_nationkey:text c_acctbal:number c_mktsegment:text",
    "supplier": "s_suppkey:text s_name:text s_nationkey:text s_acctbal:number",
    "part": "p_partkey:text p_name:text p_brand:text p_type:text p_size:text"
            " p_retailprice:number",
    "orders": "o_orderkey:text o_custkey:text o_orderstatus:text o_totalprice:number"
              " o_orderdate:time o_orderpriority:text",
    "lineitem": "l_orderkey:text l_partkey:text l_suppkey:text l_linenumber:text"
                " l_quantity:number l_extendedprice:number l_discount:number l_tax:number"
                " l_returnflag:text l_linestatus:text l_shipdate:time",
    "events": "event_id:text ts:time user_id:text event_type:text value:number props:text",
    "documents": "doc_id:text text:text lang:text source:text n_chars:text",
    "embeddings": "vec_id:text embedding:numbers label:text",
    "pages": "page_id:text url:text html:text",
    "benchmark": "item_id:text text:text",
    "labels": "doc_id:text quality:text toxic:text",
    "conversations": "conv_id:text turn:text role:text text:text",
}
_MILLIONTHS = "cast(cast(round(cast({} as double) * 1000000) as bigint) as varchar)"
_WRITTEN = {
    "text": "cast({} as varchar)", "number": _MILLIONTHS,
    "time": "strftime({}, '%Y-%m-%d %H:%M:%S.%f')",
    "numbers": "array_to_string(list_transform({}, lambda v: coalesce("
               + _MILLIONTHS.format("v") + ", '-')), ',')",
}


def _digest(table: str) -> str:
    """SHA-256 over the length and text of every column."""
    shown = [_WRITTEN[kind].format(name) for name, kind in
             (column.split(":") for column in _COLUMNS[table].split())]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in shown) + ")"


def _others(table: str) -> str:
    """The columns after the first, in order, nulls first."""
    names = [column.split(":")[0] for column in _COLUMNS[table].split()][1:]
    return ", ".join(f"{name} nulls first" for name in names)


def _each_table(select: str) -> str:
    """One select per source table, whose name stands for {table}."""
    return " union all ".join(select.replace("{table}", t) for t in SOURCES)


def oracle_sql() -> dict[str, str]:
    whole = {
        "cr_scores_stored": sql("select * from cr"),
        "improvement_items_long": sql(f"select {_ITEM} from all_items").replace(
            "item_rank <= 10", "item_rank <= 100"),
        "reads_per_table_from_facts": _both(
            sql(_PER_TABLE.format("null")),
            sql(_PER_TABLE.format(30), accesses=f"{_SAMPLE} and database_name = 'D1'")),
        "p50_latency_from_facts": sql(f"""select {_PK}, full_table_name,
            round(p50_execution_ms, 6) as p50_execution_ms from per_table"""),
        "scan_save": _both(
            _saved("call-1", "first"), _saved("call-2", "second"),
            _saved("call-3", "account", "analyst", _ONE), _saved("call-4", "first", **_BARE)),
        "scan_save_items": _both(
            _saved_items("call-1"), _saved_items("call-2"), _saved_items("call-3", _ONE),
            _saved_items("call-4", **_BARE)),
    }
    queries = {
        # reads
        "access_flatten": f"select {_PK}, full_table_name, query_id, user_name from accesses",
        "name_parts": f"select full_table_name, {_PK}, count(*) as n from named_objects group by all",
        "exclude_internal": f"""select {_PK}, count(*) as n from named_objects
            where not (database_name = 'TABLEGAUGE' and schema_name = 'PUBLIC'
            and table_name in ('SCAN_RUNS', 'SCAN_IMPROVEMENT_ITEMS')) group by all""",
        "sample_by_query": f"select query_id, user_name, full_table_name from accesses where {_SAMPLE}",
        "scope_filter": f"select {_PK}, query_id from accesses where database_name = 'D1'",
        "json_app": "select session_id, application_name from sessions",
        "bi_classifier": "select session_id, application_name, is_bi_or_dashboard from apps",
        # Every tenth customer has one of ten names; three of those are hosted dashboards.
        "bi_classifier_hosted": """select cast(c_custkey as varchar) as session_id,
            ['Harbor Web Desk (pier_streamlit)', 'harbor web desk (PIER_DASHBOARD)',
             'Harbor Web Desk (pierXdashboard)', 'Harbor Web Desk (pier_notebook)',
             'Other Web Desk (pier_dashboard)', 'Harbor Web Desk (pier_dashboard) 2',
             'harborcli.streamlit.1', 'xharborcli.streamlit', 'harborcli-streamlit', 'Streamlit'
            ][c_custkey % 10 + 1] as application_name,
            case when c_custkey % 10 in (0, 1, 6) then 1 end as is_bi_or_dashboard
            from customer""",
        "eligible_queries": "select query_id, session_id, execution_time from eligible",
        "reads_joined": f"""select {_PK}, full_table_name, query_id, user_name, execution_time_ms,
            application_name, is_bi_or_dashboard from reads""",
        "reads_per_table": f"""select {_PK}, full_table_name, analytical_reads, distinct_users,
            app_reads, distinct_app_tools, round(p50_execution_ms, 6) as p50_execution_ms
            from per_table""",
        "p50_latency": f"""select {_PK}, full_table_name, round(p50_execution_ms, 6)
            as p50_execution_ms from per_table""",
        "speed_score": f"""select {_PK}, full_table_name,
            round(1.0 / (1.0 + pow(p50_execution_ms / 5000.0, 3)), 6) as speed_score from per_table""",
        "table_freshness": f"""select {_PK}, full_table_name, days_since_update,
            round(exp(-ln(2) / 30.0 * coalesce(days_since_update, 60)), 6) as freshness_score
            from fresh""",
        "cr_percent_ranks": f"""select scope, {_PK}, full_table_name,
            round(activity_pctile, 6) as activity_pctile, round(user_pctile, 6) as user_pctile,
            round(app_pctile, 6) as app_pctile from ranked""",
        "cr_scores": "select * from cr",
        "cr_scores_one_database": "select * from cr where scope = 'D1'",
        "cr_tables": "select * from cr_set",
        # semantic views
        "sv_latest": "select cast(view_id as varchar) as semantic_view_id, sv_fqn, view_comment"
                     " from views",
        "sv_tables_latest": """select cast(view_id as varchar) as semantic_view_id,
            name as semantic_table_name, base_database, base_schema, base_table,
            len(primary_keys) as n_pk, len(unique_keys) as n_uk, len(distinct_ranges) as n_ranges,
            len(synonyms) as n_synonyms, comment from view_tables""",
        "sv_base_tables": """select cast(view_id as varchar) as semantic_view_id, base_database,
            base_schema, base_table from view_bases""",
        "sv_signals": """select cast(view_id as varchar) as semantic_view_id, has_pk,
            has_unique_keys, has_distinct_ranges, tbl_has_synonyms from table_signals""",
        "sv_synonyms": """select cast(view_id as varchar) as semantic_view_id, kind, has_synonyms
            from member_synonyms""",
        "sv_comment_depth": """select cast(view_id as varchar) as semantic_view_id,
            avg_comment_length, round(1 - exp(-(ln(100) / 100)
            * coalesce(avg_comment_length, 0.0)), 6) as comment_points from comment_depth""",
        "vqr_counts": "select * from vqr",
        "vqr_saturation": """select sv_fqn, n_verified_queries,
            round(2 * (1 - exp(-(ln(10) / 10) * n_verified_queries)), 6) as vqr_points from vqr""",
        "sv_quality": "select * from sv",
        "sv_rollup": f"""select {_SV.format('')}, count(base_table) as n_base_tables
            from sv group by all""",
        "sv_covered_tables": """select distinct t.raw_database as db, t.raw_schema as sch,
            t.raw_table as tbl from semantic_views v join semantic_tables t
            on v.view_id = t.view_id where not v.gone and not t.gone""",
        # composite
        "demand_coverage": """select d.scope, n_all_scored, coalesce(n_cr_tables, 0) as n_cr_tables,
            cast(total_reads as bigint) as total_reads, cast(reads_on_cr as bigint) as reads_on_cr,
            round(case when total_reads >= 10 then reads_on_cr / total_reads end, 6) as pct_demand
            from demand d left join cr_count c on d.scope = c.scope""",
        "sv_coverage": """select s.scope, n_cr_tables, n_sv_covered,
            round(cover, 6) as pct_sv_coverage from shares s
            where scope in (select scope from demand)""",
        "sv_quality_avg": """select scope, round(q, 6) as avg_sv_quality,
            round(has_pk, 6) as share_has_pk, round(has_synonyms, 6) as share_has_synonyms,
            round(has_metrics, 6) as share_has_metrics,
            round(has_relationships, 6) as share_has_relationships from depth""",
        "missing_dims": "select scope, missing_dims from shares",
        "composite_scores": """select scope, ai_readiness, demand_coverage, sv_readiness,
            sv_coverage, sv_quality, n_cr_tables, gap, n_all_scored, n_sv, n_sv_covered,
            round(demand, 6) as pct_demand_raw, round(cover, 6) as pct_sv_coverage_raw,
            round(depth, 6) as avg_sv_quality_raw, missing_dims from composite""",
        "composite_unknown_scope": """select 'NOWHERE' as scope, 0.0::double as ai_readiness,
            0.0::double as demand_coverage, 0.0::double as sv_readiness, 0.0::double as sv_coverage,
            0.0::double as sv_quality, 0::bigint as n_cr_tables, 'BUILD_CR_TABLES' as gap,
            0::bigint as n_all_scored, (select count(distinct sv_fqn) from sv) as n_sv,
            0::bigint as n_sv_covered, null::double as pct_demand_raw,
            0.0::double as pct_sv_coverage_raw, 0.0::double as avg_sv_quality_raw,
            '' as missing_dims""",
        "gap_class": """select run_id, gap from scan_runs""",
        "items_schema_gap": f"select {_ITEM} from schema_top",
        "items_uncovered_cr": f"select {_ITEM} from table_top",
        "items_sv_quality": f"select {_ITEM} from view_top",
        "improvement_items": f"select {_ITEM} from all_items",
        "top_targets": "select scope, gap, top_targets from composite join targets using (scope)",
        "recommendation_text": f"""select scope, {_summary()} as recommendation_text
            from composite join targets using (scope)""",
        # six factors
        "scope_list": "select database_name, schema_name from schema_list",
        "catalog_columns_base": f"select {_PK}, column_name, comment, is_required from base_columns",
        **{check_key(c.requirement): f"select {_RATIO} from check_{c.requirement}" for c in CHECKS},
        "check_column_masking_search": f"select {_RATIO} from ({_masking('matches')})",
        "six_factor_requirements": """select database_name, schema_name, factor, requirement, label,
            numerator, denominator, round(value, 6) as value, value >= 0.5 as passed,
            cast(null as varchar) as error from requirements""",
        "six_factor_requirements_of_schemas": """select database_name, schema_name, factor,
            requirement, label, numerator, denominator, round(value, 6) as value,
            value >= 0.5 as passed, cast(null as varchar) as error from requirements
            where schema_name in ('S1', 'S3')""",
        "six_factor_scores": """select database_name, schema_name, factor, round(score, 6) as score,
            round(overall, 6) as overall from factor_scores
            join overalls using (database_name, schema_name)""",
        "six_factor_tier": f"select database_name, schema_name, {_TIER} as tier from overalls",
        "six_factor_portfolio": f"""select database_name, schema_name,
            round(any_value(overall) * 100, 1) as overall,
            any_value({_TIER}) as tier, """ + ", ".join(
                f"round(max(case when factor = '{f}' then score end) * 100, 1) as \"{f}\""
                for f in K.FACTORS
            ) + """ from factor_scores join overalls using (database_name, schema_name)
            group by database_name, schema_name""",
        "six_factor_detail": """select database_name, schema_name, factor, requirement,
            label as description,
            case when value is null then 'N/A' else printf('%.2f', value) end as value,
            numerator || '/' || denominator as fraction,
            case when value is null then '-' when value >= 0.5 then 'pass' else 'fail' end as result
            from requirements""",
        # history and report
        "history_append": f"select {_RUNS} from scan_runs",
        "history_items_append": "select * from scan_items",
        "history_runs": f"select {_RUNS} from scan_runs where database_filter = 'D1'",
        "history_items": """select i.*, r.run_ts, r.database_filter from scan_items i
            join scan_runs r on i.run_id = r.run_id""",
        "history_latest": f"""select {_RUNS} from (select *, row_number() over
            (partition by database_filter order by run_ts desc, run_id desc) as n from scan_runs)
            where n = 1""",
        "history_trend": " union all ".join(
            f"""select run_id, run_ts, database_filter, '{c}' as measure, {c} as value,
            70.0::double as healthy_threshold from scan_runs""" for c in K.TREND_COLUMNS),
        "score_stage": f"""select run_id, ai_readiness, {_STAGE} as stage, {_TITLE} as stage_title, {_ADVICE} as stage_text
            from scan_runs""",
        "score_band": f"select run_id, {_colour('ai_readiness')} as band from scan_runs",
        "gap_label": f"select run_id, {_labels('gap', K.GAP_LABELS)} as gap_label from scan_runs",
        "dimension_interpretation": "select * from interpretations",
        "peer_comparison": """select run_id, dimension, axis_max, score,
            round(least(100.0, greatest(0.0, score / axis_max * 100)), 6) as score_pos, peer,
            peer_median, round(least(100.0, greatest(0.0, peer_median / axis_max * 100)), 6)
            as peer_pos from own join peers using (dimension)""",
        "report_opportunities": "select * from opportunities",
        "report_payload": f"""select r.run_id, substr(r.run_id, 1, 8) as run_short,
            strftime(run_ts, '%Y-%m-%d') as run_date, account_name, role_name, database_filter,
            case when sample_pct > 0 then sample_pct || '% sample' else 'Full scan' end as sample_label,
            ai_readiness, {_STAGE} as stage, {_TITLE} as stage_title,
            {_colour('ai_readiness')} as band, n_cr_tables,
            {_labels('gap', K.GAP_LABELS)} as gap_label, recommendation_text, axis_max,
            d.texts as dimensions, coalesce(o.lines, '') as opportunities
            from run_ends r left join (select run_id, string_agg(dimension || ': ' || interpretation,
                ' ' order by dimension) as texts from interpretations group by run_id) d
                on r.run_id = d.run_id
            left join (select run_id, string_agg(position || ' ' || tag || ' ' || target, '; '
                order by position) as lines from opportunities group by run_id) o
                on r.run_id = o.run_id""",
        # probes
        "probe_count": _each_table("select '{table}' as table_name, count(*) as n from {table}"),
        "probe_limit": _each_table(
            "select '{table}' as table_name, k, least(k, count(*)) as n from {table},"
            " (select unnest([10, 25, 50]) as k) group by k"),
        "probe_topk": " union all ".join(
            f"""select '{t}' as table_name, '{order}' as direction, {k} as k,
            cast(first as varchar) as first_value, row_sha256 from (
                select {_COLUMNS[t].split(':')[0]} as first, {_digest(t)} as row_sha256 from {t}
                order by first {order}, {_others(t)} limit {k})"""
            for t in SOURCES for order, k in K.PROBE_TOPK["large"]),
        "probe_sample": " union all ".join(
            f"""select '{t}' as table_name, count(*) as n_sampled from {t}
            where cast('0x' || substr({_digest(t)}, 1, 8) as bigint) < 2147483648"""
            for t in SOURCES),
        "probe_distinct_rows": _each_table(
            "select '{table}' as table_name, count(*) as n_distinct from (select distinct * from"
            " {table} where columns(*) is not null)"),
        "table_size_tier": _each_table(
            "select '{table}' as table_name, count(*) as n, case when count(*) >= 1000 then 'large'"
            " when count(*) >= 100 then 'medium' else 'small' end as tier,"
            " case when count(*) >= 1000 then 10 when count(*) >= 100 then 6 else 3 end as n_probes"
            " from {table}"),
    }
    return whole | {name: sql(query) for name, query in queries.items()}
