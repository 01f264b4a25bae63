"""Every operator as a named query over the tables of one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge import constants as K
from tablegauge.functions import bands, scoring
from tablegauge.functions.apps import application_name
from tablegauge.functions.names import sampled, with_name_parts
from tablegauge.operators import composite as comp
from tablegauge.operators import (
    consumption, history, items, probes, reads, report, semantic, sixfactor,
)
from tablegauge.params import ScanParams
from tablegauge.plans import scan
from tablegauge.plans.oracle import SOURCES, check_key
from tablegauge.session import settle, shared_folder
from tablegauge.sources import stored_logs
from tablegauge.sources.derived import AS_OF, DerivedEstate
from tablegauge.sources.relations import Estate, write_log
from tablegauge.sources.schemas import INPUTS, LOG_TIMES
from tablegauge.streaming import daily_facts

PARAMS = ScanParams(AS_OF)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(build: Callable[[DerivedEstate], DataFrame]) -> Callable[[DerivedEstate], DataFrame]:
    """Register a function of the estate under its own name."""
    _QUERIES[build.__name__] = lambda spark, folder: build(DerivedEstate(spark, folder))
    return build


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round for comparison with an engine whose last bits differ."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _tables(estate: DerivedEstate, shape: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """One frame over all source tables."""
    return reduce(DataFrame.unionByName, [shape(t, estate.source(t)) for t in SOURCES])


# ---- reads and consumption ---------------------------------------------------------------

def _accesses(e: DerivedEstate, params: ScanParams = PARAMS) -> DataFrame:
    return reads.access_flatten(e["access_history"], params)


def _reads(e: DerivedEstate) -> DataFrame:
    return reads.reads_joined(e["access_history"], e["query_history"], e["sessions"], PARAMS)


def _per_table(e: DerivedEstate) -> DataFrame:
    return reads.reads_per_table(_reads(e), PARAMS)


def _objects(e: DerivedEstate) -> DataFrame:
    return reads.touched_objects(e["access_history"], "base_objects_accessed")


@query
def access_flatten(e):
    return _accesses(e).drop("query_start_time")


@query
def name_parts(e):
    names = _objects(e).groupBy("full_table_name").agg(F.count("*").alias("n"))
    return with_name_parts(names)


@query
def exclude_internal(e):
    kept = reads.excluding_internal(_objects(e), PARAMS)
    return kept.groupBy("database_name", "schema_name", "table_name").agg(
        F.count("*").alias("n"))


@query
def sample_by_query(e):
    return _accesses(e, PARAMS.with_(sample_pct=30)).select(
        "query_id", "user_name", "full_table_name")


@query
def scope_filter(e):
    return _accesses(e, PARAMS.with_(scope="d1")).select(
        "database_name", "schema_name", "table_name", "query_id")


@query
def json_app(e):
    return e["sessions"].select("session_id", application_name().alias("application_name"))


@query
def bi_classifier(e):
    return reads.session_apps(e["sessions"], PARAMS)


#: Dashboards of a made-up platform, as a caller would name them.
HOSTED = (r"Harbor Web Desk (pier\_streamlit)", r"Harbor Web Desk (pier\_dashboard)",
          "HARBORCLI.STREAMLIT%")


@query
def bi_classifier_hosted(e):
    """Hosted dashboards and near misses: another case, a wildcard's letter, more or less text."""
    names = ["Harbor Web Desk (pier_streamlit)", "harbor web desk (PIER_DASHBOARD)",
             "Harbor Web Desk (pierXdashboard)", "Harbor Web Desk (pier_notebook)",
             "Other Web Desk (pier_dashboard)", "Harbor Web Desk (pier_dashboard) 2",
             "harborcli.streamlit.1", "xharborcli.streamlit", "harborcli-streamlit", "Streamlit"]
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % 10 + 1).cast("int"))
    named = e.source("customer").select(
        F.col("c_custkey").cast("string").alias("session_id"),
        F.to_json(F.struct(pick.alias("APPLICATION"))).alias("client_environment"))
    return reads.session_apps(named, PARAMS.with_(hosted_clients=HOSTED))


@query
def eligible_queries(e):
    return reads.eligible_queries(e["query_history"], PARAMS).select(
        "query_id", "session_id", "execution_time")


@query
def reads_joined(e):
    return _reads(e)


@query
def reads_per_table(e):
    return rounded(_per_table(e), "p50_execution_ms")


@query
def p50_latency(e):
    return rounded(_per_table(e).select(*reads.READ_KEY, "p50_execution_ms"), "p50_execution_ms")


@query
def speed_score(e):
    speed = scoring.speed(F.col("p50_execution_ms")).alias("speed_score")
    return rounded(_per_table(e).select(*reads.READ_KEY, speed), "speed_score")


@query
def table_freshness(e):
    aged = consumption.with_freshness(_per_table(e), e["tables"], PARAMS)
    score = scoring.freshness(F.col("days_since_update")).alias("freshness_score")
    return rounded(
        aged.select(*reads.READ_KEY, "days_since_update", score), "freshness_score")


@query
def cr_percent_ranks(e):
    inputs = settle(consumption.cr_inputs(*[e[name] for name in scan.LOGS], PARAMS))
    ranks = ("activity_pctile", "user_pctile", "app_pctile")
    ranked = consumption.cr_percent_ranks(inputs, PARAMS)
    return rounded(ranked.select("scope", *reads.READ_KEY, *ranks), *ranks)


@query
def cr_scores(e):
    return consumption.by_score(scan.scores_of(e, PARAMS))


@query
def cr_scores_one_database(e):
    return scan.scores_of(e, PARAMS.with_(scope="D1"))


@query
def cr_tables(e):
    return consumption.cr_tables(scan.scores_of(e, PARAMS), PARAMS)


# ---- stored logs and facts ---------------------------------------------------------------

#: Buckets of small stored logs; larger ones take one per BUCKET_ROWS of ``stored_logs``.
BUCKETS = 4


@query
def cr_scores_stored(e):
    """The scores from logs laid out by date and query id."""
    root = f"{shared_folder(e.spark)}/logs-{uuid.uuid4().hex}"
    buckets = stored_logs.buckets_for(max(e[name].count() for name in LOG_TIMES), BUCKETS)
    for name in LOG_TIMES:
        stored_logs.append_log(e[name], root, name, buckets)
    kept = stored_logs.StoredEstate(e.spark, root, buckets)
    return scan.scores_of({**e, **{name: kept[name] for name in LOG_TIMES}}, PARAMS)


def _kept_facts(e: DerivedEstate, *shapes: ScanParams) -> str:
    """Facts of logs of which every third row, by its key, came after a first count."""
    root = f"{shared_folder(e.spark)}/facts-{uuid.uuid4().hex}"
    keys = {"access_history": "query_id", "query_history": "query_id", "sessions": "session_id"}
    for late in (False, True):
        for name, key in keys.items():
            third = F.pmod(F.xxhash64(key, F.lit(name)), F.lit(3)) == 0
            rows = e[name].where(third if late else ~third)
            if name in LOG_TIMES:
                write_log(rows, LOG_TIMES[name], f"{root}/{name}")
            else:
                rows.write.mode("append").parquet(f"{root}/{name}")
        for params in shapes:
            streams = {name: e.spark.readStream.schema(INPUTS[name]).parquet(f"{root}/{name}")
                       for name in keys}
            daily_facts.keep_daily_facts(
                streams, lambda: Estate(e.spark, root), f"{root}/kept", params).awaitTermination()
    return f"{root}/kept"


@query
def reads_per_table_from_facts(e):
    """Counts and medians of two scans with their own facts, from facts alone."""
    shapes = PARAMS, PARAMS.with_(sample_pct=30, scope="D1")
    folder = _kept_facts(e, *shapes)
    return reduce(DataFrame.unionByName, [
        rounded(daily_facts.reads_per_table(e.spark, folder, params), "p50_execution_ms")
        .withColumn("sample_pct", F.lit(params.sample_pct).cast("int")) for params in shapes])


@query
def p50_latency_from_facts(e):
    per_table = daily_facts.reads_per_table(e.spark, _kept_facts(e, PARAMS), PARAMS)
    return rounded(per_table.select(*reads.READ_KEY, "p50_execution_ms"), "p50_execution_ms")


# ---- semantic views ----------------------------------------------------------------------

def _members(e: DerivedEstate) -> DataFrame:
    return semantic.members_latest({name: e[name] for name in semantic.MEMBERS})


def _sv_tables(e: DerivedEstate) -> DataFrame:
    return semantic.sv_tables_latest(e["semantic_tables"])


@query
def sv_latest(e):
    return semantic.sv_latest(e["semantic_views"])


@query
def sv_tables_latest(e):
    def size(array):
        return F.array_size(array).cast("long")

    return _sv_tables(e).select(
        semantic.VIEW, "semantic_table_name", "base_database", "base_schema", "base_table",
        size("primary_keys").alias("n_pk"), size("unique_keys").alias("n_uk"),
        size("distinct_ranges").alias("n_ranges"), size("synonyms").alias("n_synonyms"),
        "comment",
    )


@query
def sv_base_tables(e):
    return semantic.sv_base_tables(_sv_tables(e))


@query
def sv_signals(e):
    return semantic.sv_signals(_sv_tables(e))


@query
def sv_synonyms(e):
    return semantic.sv_synonyms(_members(e))


@query
def sv_comment_depth(e):
    return semantic.sv_comment_depth(
        semantic.sv_latest(e["semantic_views"]), _sv_tables(e), _members(e))


@query
def vqr_counts(e):
    return semantic.vqr_counts(e["sv_properties"])


@query
def vqr_saturation(e):
    points = scoring.vqr_points(F.col("n_verified_queries")).alias("vqr_points")
    counts = semantic.vqr_counts(e["sv_properties"])
    return rounded(counts.select("sv_fqn", "n_verified_queries", points), "vqr_points")


@query
def sv_quality(e):
    return semantic.by_quality(scan.quality_of(e))


@query
def sv_rollup(e):
    return semantic.sv_rollup(scan.quality_of(e))


@query
def sv_covered_tables(e):
    return semantic.sv_covered_tables(e["semantic_views"], e["semantic_tables"], PARAMS)


# ---- composite ---------------------------------------------------------------------------

def _settled(e: DerivedEstate) -> tuple[DataFrame, DataFrame]:
    return settle(scan.scores_of(e, PARAMS)), settle(scan.quality_of(e))


@query
def demand_coverage(e):
    shares = comp.demand_coverage(scan.scores_of(e, PARAMS), PARAMS)
    return rounded(shares, "pct_demand")


@query
def sv_coverage(e):
    return rounded(comp.sv_coverage(*_settled(e), PARAMS), "pct_sv_coverage")


@query
def sv_quality_avg(e):
    means = comp.sv_quality_avg(comp.relevant_views(*_settled(e), PARAMS))
    return rounded(means, *[c for c in means.columns if c != "scope"])


def _scan(e: DerivedEstate) -> scan.Scan:
    return scan.full_scan(e, PARAMS)


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ", ") for c in columns})


@query
def missing_dims(e):
    return _listed(_scan(e).composite, "missing_dims").select("scope", "missing_dims")


@query
def composite_scores(e):
    shares = ("pct_demand_raw", "pct_sv_coverage_raw", "avg_sv_quality_raw")
    composite = _scan(e).composite.drop("top_targets")
    return rounded(_listed(composite, "missing_dims"), *shares)


@query
def composite_unknown_scope(e):
    """A database that the catalog does not know still gets its row."""
    composite = scan.full_scan(e, PARAMS.with_(scope="nowhere")).composite.drop("top_targets")
    return _listed(composite, "missing_dims")


@query
def gap_class(e):
    """The gap of every stored run, worked out again from its scores."""
    return e["scan_runs"].select("run_id", scoring.gap_class(
        F.col("demand_coverage") / 100, F.col("n_cr_tables"),
        F.col("sv_coverage") / 100, F.col("sv_quality") / 100,
    ).alias("gap"))


@query
def items_schema_gap(e):
    return items.items_schema_gap(scan.scores_of(e, PARAMS), PARAMS)


@query
def items_uncovered_cr(e):
    return items.items_uncovered_cr(*_settled(e), PARAMS)


@query
def items_sv_quality(e):
    return items.items_sv_quality(*_settled(e), PARAMS)


@query
def improvement_items(e):
    return _scan(e).items


@query
def improvement_items_long(e):
    """Up to a hundred items of every scope."""
    return scan.full_scan(e, PARAMS.with_(max_items=100)).items


@query
def top_targets(e):
    return _listed(_scan(e).composite, "top_targets").select("scope", "gap", "top_targets")


@query
def recommendation_text(e):
    text = comp.recommendation_text(PARAMS.account_name).alias("recommendation_text")
    return _scan(e).composite.select("scope", text)


# ---- six factors -------------------------------------------------------------------------

@query
def scope_list(e):
    return sixfactor.scope_list(e["catalog_tables"])


@query
def catalog_columns_base(e):
    base = sixfactor.catalog_columns_base(e["catalog_columns"], e["catalog_tables"])
    return base.select(
        *[F.col(raw).alias(name) for raw, name in zip(sixfactor.RAW_KEY, reads.READ_KEY)],
        "column_name", "comment", (F.col("is_nullable") == "NO").alias("is_required"),
    )


def _check(name: str, params: ScanParams = PARAMS) -> Query:
    return lambda spark, folder: rounded(
        sixfactor.check(name, DerivedEstate(spark, folder), params), "value")


for _spec in sixfactor.CHECKS:
    _QUERIES[check_key(_spec.requirement)] = _check(_spec.requirement)
_QUERIES["check_column_masking_search"] = _check(
    "column_masking", PARAMS.with_(pii_match="search"))


def _requirements(e: DerivedEstate) -> DataFrame:
    return sixfactor.six_factor_requirements(e, PARAMS)


def _factors(e: DerivedEstate) -> DataFrame:
    return sixfactor.six_factor_scores(_requirements(e))


@query
def six_factor_requirements(e):
    return rounded(_requirements(e), "value")


@query
def six_factor_requirements_of_schemas(e):
    """The requirements of two chosen schemas, named in either case."""
    rows = sixfactor.six_factor_requirements(e, PARAMS, ["s1", "S3"])
    return rounded(rows, "value")


@query
def six_factor_scores(e):
    return rounded(_factors(e), "score", "overall")


@query
def six_factor_tier(e):
    return sixfactor.six_factor_portfolio(_factors(e)).select(*sixfactor.SCHEMA_KEY, "tier")


@query
def six_factor_portfolio(e):
    return sixfactor.by_overall(sixfactor.six_factor_portfolio(_factors(e)))


@query
def six_factor_detail(e):
    return sixfactor.six_factor_detail(_requirements(e))


# ---- history and report ------------------------------------------------------------------

def _stored_history(e: DerivedEstate) -> str:
    """A new folder in the shared one to which all runs and items have been appended."""
    folder = f"{shared_folder(e.spark)}/history-{uuid.uuid4().hex}"
    history.append_history(e["scan_runs"], e["scan_improvement_items"], folder, "import")
    return folder


@query
def history_append(e):
    runs = history.load_runs(e.spark, _stored_history(e))
    return runs.withColumn("run_ts", F.col("run_ts").cast("timestamp_ntz"))


@query
def history_items_append(e):
    return history.load_items(e.spark, _stored_history(e))


def _saved_scans(e: DerivedEstate) -> str:
    """A new history: two accounts, one database, a scan without views at the same time, a retry."""
    folder = f"{shared_folder(e.spark)}/saved-{uuid.uuid4().hex}"
    inputs = scan.inputs_of(e, PARAMS)
    whole = scan.full_scan(e, PARAMS, inputs)
    one = PARAMS.with_(scope="D1", role_name="analyst")
    bare = {**e, "semantic_views": e["semantic_views"].where("false")}
    scan.save_scan(whole, folder, PARAMS.with_(account_name="first"), "call-1")
    scan.save_scan(whole, folder, PARAMS.with_(account_name="second"), "call-2")
    scan.save_scan(scan.full_scan(e, one, inputs, whole.quality), folder, one, "call-3")
    later = scan.full_scan(bare, PARAMS, inputs)  # the same logs
    scan.save_scan(later, folder, PARAMS.with_(account_name="first"), "call-4")
    scan.save_scan(later, folder, PARAMS.with_(account_name="first"), "call-1")
    return folder


@query
def scan_save(e):
    runs = history.load_runs(e.spark, _saved_scans(e))
    return runs.withColumn("run_ts", F.col("run_ts").cast("timestamp_ntz"))


@query
def scan_save_items(e):
    return history.load_items(e.spark, _saved_scans(e))


@query
def history_runs(e):
    return history.history_runs(e["scan_runs"], "D1")


@query
def history_items(e):
    return history.history_items(e["scan_runs"], e["scan_improvement_items"])


@query
def history_latest(e):
    return history.history_latest(e["scan_runs"])


@query
def history_trend(e):
    return history.history_trend(e["scan_runs"], PARAMS)


@query
def score_stage(e):
    score = F.col("ai_readiness")
    return e["scan_runs"].select(
        "run_id", score, bands.score_stage(score).alias("stage"),
        bands.stage_title(score).alias("stage_title"), bands.stage_text(score).alias("stage_text"))


@query
def score_band(e):
    return e["scan_runs"].select("run_id", bands.score_band(F.col("ai_readiness")).alias("band"))


@query
def gap_label(e):
    return e["scan_runs"].select("run_id", bands.gap_label(F.col("gap")).alias("gap_label"))


@query
def dimension_interpretation(e):
    return report.dimension_interpretation(e["scan_runs"])


@query
def peer_comparison(e):
    return report.peer_comparison(e["scan_runs"], digits=6)


@query
def report_opportunities(e):
    return report.report_opportunities(e["scan_improvement_items"])


@query
def report_payload(e):
    payload = report.report_payload(e["scan_runs"], e["scan_improvement_items"])
    texts = F.transform("dimensions", lambda d: F.concat(d["dimension"], F.lit(": "), d["text"]))
    lines = F.transform("opportunities", lambda o: F.concat_ws(
        " ", o["position"], o["tag"], o["target"]))
    return payload.withColumns({
        "dimensions": F.array_join(F.sort_array(texts), " "),
        "opportunities": F.coalesce(F.array_join(lines, "; "), F.lit("")),
    })


# ---- probes ------------------------------------------------------------------------------

@query
def probe_count(e):
    return _tables(e, lambda name, table: probes.probe_count(table).select(
        F.lit(name).alias("table_name"), "n"))


@query
def probe_limit(e):
    def count(name, table):
        return reduce(DataFrame.unionByName, [
            probes.probe_limit(table, k).agg(F.count("*").alias("n")).select(
                F.lit(name).alias("table_name"), F.lit(k).alias("k"), "n")
            for k in K.PROBE_LIMITS["large"]
        ])
    return _tables(e, count)


@query
def probe_topk(e):
    return _tables(e, lambda name, table: probes.probe_extremes(
        table, K.PROBE_TOPK["large"]).select(F.lit(name).alias("table_name"), "*"))


@query
def probe_sample(e):
    return _tables(e, lambda name, table: probes.probe_count(probes.probe_sample(table)).select(
        F.lit(name).alias("table_name"), F.col("n").alias("n_sampled")))


@query
def probe_distinct_rows(e):
    return _tables(e, lambda name, table: probes.probe_distinct_rows(table).select(
        F.lit(name).alias("table_name"), "n_distinct"))


@query
def table_size_tier(e):
    return _tables(e, probes.table_size_tier)


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)
