"""Semantic views: versions, signals, verified queries, quality."""

import datetime as dt
import math

import pytest

from tablegauge.operators import semantic
from tests.conftest import NOW


def day(n):
    return NOW - dt.timedelta(days=n)


def view(vid, name="V", age=1, **changes):
    return dict(semantic_view_id=vid, semantic_view_database_name="D",
                semantic_view_schema_name="S", semantic_view_name=name,
                last_altered=None if age is None else day(age)) | changes


def table(vid, name, base="T", age=1, **changes):
    return dict(semantic_view_id=vid, semantic_table_name=name, base_table_database_name="d",
                base_table_schema_name="s", base_table_name=base, last_altered=day(age)) | changes


def member(kind, vid, name, age=1, **changes):
    return {"semantic_view_id": vid, f"semantic_{kind}_name": name,
            "last_altered": day(age)} | changes


@pytest.fixture
def quality(rows, spark):
    def build(views, tables=(), dimensions=(), facts=(), metrics=(), relationships=(), vqr=()):
        frame = semantic.sv_quality(
            rows("semantic_views", *views), rows("semantic_tables", *tables),
            {"semantic_dimensions": rows("semantic_dimensions", *dimensions),
             "semantic_facts": rows("semantic_facts", *facts),
             "semantic_metrics": rows("semantic_metrics", *metrics)},
            rows("semantic_relationships", *relationships),
            spark.createDataFrame(list(vqr), "sv_fqn string, n_verified_queries long"))
        return sorted(frame.collect(), key=lambda r: (r.sv_fqn, r.base_table or ""))
    return build


def test_newest_live_version_wins(rows):
    got = semantic.sv_latest(rows(
        "semantic_views", view("old", age=5), view("new", age=2), view("gone", age=1, deleted=NOW),
        view("undated", age=None), view("other", name="W", age=None))).collect()
    assert sorted((r.semantic_view_id, r.sv_fqn) for r in got) == [
        ("new", "D.S.V"), ("other", "D.S.W")]


def test_equal_ages_are_settled_the_same_way_every_time(rows):
    pair = [table("1", "t", base="A"), table("1", "t", base="B")]
    one = semantic.sv_tables_latest(rows("semantic_tables", *pair)).collect()
    two = semantic.sv_tables_latest(rows("semantic_tables", *pair[::-1])).collect()
    assert one == two and len(one) == 1


def test_a_bare_view_keeps_one_row(quality):
    (row,) = quality([view("1")])
    assert row.base_table is None and row.quality_score == 0.0
    assert not any(row[flag] for flag in semantic.QUALITY_FLAGS)
    assert (row.avg_comment_length, row.n_verified_queries) == (0.0, 0)


def test_base_tables_need_database_and_table_but_not_schema(quality):
    got = quality([view("1")], [
        table("1", "a", base="x"), table("1", "b", base="x"), table("1", "c", base=None),
        table("1", "d", base="y", base_table_database_name=None),
        table("1", "e", base="z", base_table_schema_name=None)])
    assert [(r.base_database, r.base_schema, r.base_table) for r in got] == [
        ("D", "S", "X"), ("D", None, "Z")]


def test_flags_are_or_ed_over_tables_and_missing_ones_do_not_hide_others(quality):
    got = quality([view("1")], [
        table("1", "a", base="x", primary_keys=["k"], unique_keys=[]),
        table("1", "b", base="y", unique_keys=None, distinct_ranges=["r"])],
        facts=[member("fact", "1", "f", synonyms=["s"])],
        relationships=[dict(semantic_view_id="1"), dict(semantic_view_id="1")])
    assert [r.base_table for r in got] == ["X", "Y"]
    for r in got:
        assert (r.has_pk, r.has_unique_keys, r.has_distinct_ranges, r.has_synonyms,
                r.has_relationships, r.has_metrics) == (True, False, True, True, True, False)
        assert r.quality_score == round(4 / 9, 4)


def test_synonyms_without_any_semantic_table(quality):
    (row,) = quality([view("1")], dimensions=[member("dimension", "1", "d", synonyms=["s"])])
    assert row.has_synonyms


def test_members_count_once_per_name_and_live_ones_only(quality):
    (row,) = quality([view("1")], metrics=[
        member("metric", "1", "m", age=9, comment="older", synonyms=["s"]),
        member("metric", "1", "m", age=1, comment="new")])
    assert row.has_metrics and not row.has_synonyms and row.avg_comment_length == 3.0
    (row,) = quality([view("1")], metrics=[member("metric", "1", "m", deleted=NOW)],
                     relationships=[dict(semantic_view_id="1", deleted=NOW)])
    assert not row.has_metrics and not row.has_relationships


def test_empty_comments_count_and_unknown_ones_do_not(quality):
    (row,) = quality([view("1", comment="abcd")], [table("1", "a", comment="")],
                     dimensions=[member("dimension", "1", "d", comment=None),
                                 member("dimension", "1", "e", comment="xyz")])
    assert row.avg_comment_length == 2.3  # 7 characters in 3 comments
    points = 1 - math.exp(-math.log(100) / 100 * 2.3)
    assert row.quality_score == round(points / 9, 4)


def test_verified_queries(rows):
    def prop(name, kind, obj=None, prop=None, value=None):
        return dict(database_name="D", schema_name="S", name=name, object_kind=kind,
                    object_name=obj, property=prop, property_value=value)
    lists = '{"verified_queries": [1, {"a": 2}], "ai_verified_queries": [3]}'
    got = semantic.vqr_counts(rows(
        "sv_properties", prop("A", "verified_query"), prop("A", "AI_VERIFIED_QUERY"),
        prop("A", "extension", "ca", "value", lists), prop("A", "extension", "xx", "value", lists),
        prop("A", "TABLE", "CA", "VALUE", lists), prop("B", "EXTENSION", "CA", "VALUE", "{bad"),
        prop("B", "EXTENSION", "CA", "VALUE", None), prop("C", None))).collect()
    assert {r.sv_fqn: r.n_verified_queries for r in got} == {"D.S.A": 5, "D.S.B": 0, "D.S.C": 0}


def test_verified_queries_join_by_full_name(quality):
    (row,) = quality([view("1")], vqr=[("D.S.V", 10), ("D.S.W", 3)])
    assert row.n_verified_queries == 10 and row.quality_score == round(1.8 / 9, 4)


def test_covered_tables_ignore_versions_but_not_deletions(rows, params):
    views = rows("semantic_views", view("1", age=9), view("2"), view("3", name="X", deleted=NOW))
    tables = rows("semantic_tables", table("1", "a", base="A"), table("1", "b", base="A"),
                  table("2", "c", base="C", base_table_database_name="E"),
                  table("3", "d", base="D"), table("2", "e", base=None),
                  table("2", "f", base="F", deleted=NOW))
    covered = semantic.sv_covered_tables(views, tables, params)
    assert sorted(map(tuple, covered.collect())) == [("E", "s", "C"), ("d", "s", "A")]
    one = semantic.sv_covered_tables(views, tables, params.with_(scope="D"))
    assert [tuple(r) for r in one.collect()] == [("d", "s", "A")]
