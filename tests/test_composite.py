"""Composite scores, gaps and items per scope."""

import pytest

from tablegauge.operators import composite as comp
from tablegauge.operators import items

SCORES = "scope string, database_name string, schema_name string, table_name string," \
    " full_table_name string, analytical_reads long, distinct_users long," \
    " consumption_readiness_score double"
QUALITY = "sv_fqn string, base_database string, base_schema string, base_table string," \
    " has_pk boolean, has_synonyms boolean, has_unique_keys boolean," \
    " has_distinct_ranges boolean, has_relationships boolean, has_metrics boolean," \
    " avg_comment_length double, n_verified_queries long, quality_score double"


@pytest.fixture
def scan(spark, params):
    def run(tables, views=()):
        """tables: (name, reads, score); views: (name, base table, quality, flags)."""
        scores = spark.createDataFrame(
            [("D", "D", "S", n.upper(), f"d.s.{n}", r, 2, s) for n, r, s in tables], SCORES)
        quality = spark.createDataFrame(
            [(f"D.S.{n}", "D" if b else None, "S" if b else None, b,
              "p" in f, "s" in f, "u" in f, "d" in f, "r" in f, "m" in f, 0.0,
              1 if "v" in f else 0, q) for n, b, q, f in views], QUALITY)
        scopes = spark.createDataFrame([("D",), ("EMPTY",)], "scope string")
        result = comp.composite_scores(scores, quality, params, scopes)
        todo = items.improvement_items(result, scores, quality, params)
        full = items.top_targets(result, todo, params)
        text = full.select("scope", comp.recommendation_text("acme").alias("text"))
        by_scope = {r.scope: r for r in full.join(text, "scope").collect()}
        return by_scope, sorted(todo.collect(), key=lambda r: r.item_rank)
    return run


def test_demand_needs_ten_reads(scan):
    got, _ = scan([("a", 9, 0.9)])
    assert got["D"].pct_demand_raw is None and got["D"].demand_coverage == 0.0
    assert got["D"].gap == "BUILD_CR_TABLES" and got["D"].n_cr_tables == 1
    got, _ = scan([("a", 10, 0.9)])
    assert got["D"].pct_demand_raw == 1.0 and got["D"].gap == "BUILD_SVS"


def test_an_unread_scope_still_has_a_row(scan):
    got, todo = scan([("a", 10, 0.9)])
    empty = got["EMPTY"]
    assert (empty.gap, empty.n_all_scored, empty.ai_readiness) == ("BUILD_CR_TABLES", 0, 0.0)
    assert empty.top_targets == [] and "0% (weak, 0 ready); to do: prepare busy tables" in empty.text
    assert {r.scope for r in todo} == {"D"}


def test_twins_in_another_letter_case_count_as_ready(scan):
    got, _ = scan([("a", 60, 0.9), ("A", 30, 0.1), ("b", 10, 0.1)])
    assert got["D"].pct_demand_raw == 0.9 and got["D"].n_cr_tables == 1
    assert got["D"].n_all_scored == 3


def test_schema_gap_items(scan):
    got, (item,) = scan([("a", 1500, 0.1), ("b", 1000, 0.9)])
    assert got["D"].gap == "BUILD_CR_TABLES" and got["D"].top_targets == ["D.S"]
    assert (item.item_type, item.target) == ("SCHEMA_GAP", "D.S")
    assert item.detail == "2,500 reads across 2 tables, 1 CR"
    assert "1,500 reads" in item.recommendation and got["D"].text.endswith("to do: prepare busy tables in D.S")


def test_small_schemas_are_no_items(scan):
    _, todo = scan([("a", 9, 0.1)])
    assert todo == []


def test_uncovered_tables_are_ranked_by_reads_and_cut_at_ten(scan):
    tables = [(f"t{i:02}", 100 + i, 0.9) for i in range(14)]
    got, todo = scan(tables, [("v", "T13", 0.9, "")])
    assert got["D"].gap == "EXPAND_SV_COVERAGE" and got["D"].n_sv_covered == 1
    assert [r.target for r in todo] == [f"D.S.T{i:02}" for i in range(12, 2, -1)]
    assert got["D"].top_targets == [r.target for r in todo[:5]]
    assert todo[0].detail == "112 reads, 2 distinct users"


def test_no_view_at_all(scan):
    got, todo = scan([("a", 50, 0.9)], [("elsewhere", "Z", 0.9, "p"), ("bare", None, 0.0, "")])
    row = got["D"]
    assert (row.gap, row.sv_coverage, row.sv_quality, row.n_sv) == ("BUILD_SVS", 0.0, 0.0, 2)
    assert row.missing_dims == [] and [r.item_type for r in todo] == ["UNCOVERED_CR_TABLE"]


def test_weak_views(scan):
    got, todo = scan([("a", 50, 0.9), ("b", 40, 0.9)], [
        ("one", "A", 0.2, ""), ("one", "B", 0.2, ""), ("two", "A", 0.4, "psmruv"),
        ("fine", "B", 0.6, "p"), ("other", "Z", 0.1, "")])
    row = got["D"]
    assert row.gap == "IMPROVE_SV_QUALITY" and row.top_targets == []
    assert row.avg_sv_quality_raw == pytest.approx((0.2 + 0.4 + 0.6) / 3)  # "one" counts once
    assert row.missing_dims == ["synonyms", "metrics", "relationships"]
    assert [(r.target, r.detail) for r in todo] == [
        ("D.S.one", "Quality: 20/100"), ("D.S.two", "Quality: 40/100")]
    assert todo[0].recommendation == "without primary key, synonyms, metrics, relationships"
    assert todo[1].recommendation == "thin comments or few verified queries"
    assert "lacking synonyms and metrics and relationships" in row.text


def test_healthy(scan):
    got, todo = scan([("a", 75, 0.9), ("b", 25, 0.1)], [("v", "A", 0.64, "psmr")])
    row = got["D"]
    assert row.gap == "HEALTHY" and todo == [] and row.top_targets == []
    assert (row.demand_coverage, row.sv_coverage, row.sv_quality) == (75.0, 100.0, 64.0)
    assert (row.sv_readiness, row.ai_readiness) == (80.0, 77.5)
    assert row.text == (
        "acme: 78 of 100; reads on ready tables 75% (strong, 1 ready); ready tables in views 100% "
        "(strong, 1 of 1); depth of views 0.64 (strong); to do: nothing")
