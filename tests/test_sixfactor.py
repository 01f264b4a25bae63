"""Six-factor checks on hand-made catalogs."""

import datetime as dt

import pytest

from tablegauge.operators import sixfactor as six
from tests.conftest import NOW


def table(name, schema="S", **changes):
    return dict(table_catalog="D", table_schema=schema, table_name=name, kind="TABLE",
                table_type="BASE TABLE", row_count=1, last_altered=NOW) | changes


def column(tab, name, **changes):
    return dict(table_catalog="D", table_schema="S", table_name=tab, column_name=name,
                is_nullable="YES") | changes


def constraint(tab, kind):
    return dict(table_catalog="d", table_schema="s", table_name=tab, constraint_type=kind)


@pytest.fixture
def result(rows, params):
    def run(name, relations, params=params):
        frames = {relation: rows(relation, *records) for relation, records in relations.items()}
        got = six.check(name, frames, params).collect()
        return {r.schema_name: (r.numerator, r.denominator, r.value) for r in got}
    return run


VIEW = table("v", table_type="VIEW", kind="VIEW")


def test_a_schema_of_views_has_zeros_and_no_value(result):
    relations = {"catalog_tables": [VIEW], "catalog_columns": [column("v", "a_id")],
                 "catalog_constraints": [], "policy_references": []}
    for name in ("data_completeness", "uniqueness", "column_masking", "data_freshness"):
        assert result(name, relations) == {"S": (0, 0, None)}
    # The one check that never goes without a value, and so fails.
    assert result("referential_integrity", relations) == {"S": (0, 1, 0.0)}


def test_completeness(result):
    assert result("data_completeness", {
        "catalog_tables": [table("a"), VIEW],
        "catalog_columns": [column("a", "x", is_nullable="NO"), column("a", "y"),
                            column("v", "z", is_nullable="NO"), column("A", "other case")],
    }) == {"S": (1, 2, 0.5)}


def test_uniqueness_ignores_letter_case_and_other_constraints(result):
    relations = {"catalog_tables": [table("a"), table("b"), table("c"), VIEW],
                 "catalog_constraints": [constraint("A", "PRIMARY KEY"), constraint("a", "UNIQUE"),
                                         constraint("b", "FOREIGN KEY"),
                                         constraint("v", "UNIQUE")]}
    assert result("uniqueness", relations) == {"S": (1, 3, 1 / 3)}
    assert result("entity_identifier_declaration", relations) == {"S": (1, 3, 1 / 3)}


def test_referential_integrity(result):
    assert result("referential_integrity", {
        "catalog_tables": [table("a"), table("b"), table("c")],
        "catalog_columns": [column("a", "X_ID"), column("a", "y_id"), column("b", "z_id"),
                            column("c", "id_x"), column("c", "_id ")],
        "catalog_constraints": [constraint("a", "FOREIGN KEY"), constraint("c", "FOREIGN KEY"),
                                constraint("b", "UNIQUE")],
    }) == {"S": (1, 2, 0.5)}


def test_semantic_documentation(result):
    def covers(base, **changes):
        return dict(semantic_view_id="1", base_table_database_name="d",
                    base_table_schema_name="s", base_table_name=base) | changes
    assert result("semantic_documentation", {
        "catalog_tables": [table("a"), table("b"), VIEW],
        "semantic_tables": [covers("a"), covers("A"), covers("b", deleted=NOW), covers("v"),
                            covers("b", base_table_schema_name="x")],
    }) == {"S": (1, 2, 0.5)}


@pytest.mark.parametrize("name, comment, counts", [
    ("account", None, True), ("cust_id", None, True), ("cust_id_x", None, False),
    ("CREATED_AT", None, True), ("x1", None, False), ("x1", "", False), ("x1", "why", True),
    ("total_price", None, True), ("a_date", None, True), ("birth_date_x", None, False),
])
def test_schema_type_coverage(result, name, comment, counts):
    got = result("schema_type_coverage", {
        "catalog_tables": [table("a")], "catalog_columns": [column("a", name, comment=comment)]})
    assert got == {"S": (int(counts), 1, float(counts))}


def test_access_optimization_needs_more_than_ten_thousand_rows(result):
    assert result("access_optimization", {"catalog_tables": [
        table("a", row_count=10000, clustering_key="k"), table("b", row_count=10001),
        table("c", row_count=10001, clustering_key="k"), table("d", row_count=None)],
    }) == {"S": (1, 2, 0.5)}


def test_change_detection_goes_by_kind(result):
    assert result("change_detection", {"catalog_tables": [
        table("a", change_tracking="ON"), table("b", change_tracking="OFF"), table("c"),
        table("d", kind="TRANSIENT", change_tracking="ON"), VIEW | {"change_tracking": "ON"},
        table("e", table_type="EXTERNAL TABLE", change_tracking="ON")],
    }) == {"S": (2, 4, 0.5)}


@pytest.mark.parametrize("ago, fresh", [
    (dt.timedelta(0), True), (dt.timedelta(hours=168), True),
    (dt.timedelta(hours=168, minutes=30), True),   # 04:00 sharp: 168 boundaries
    (dt.timedelta(hours=168, minutes=31), False),  # 03:59: 169 boundaries, 168 whole hours
    (dt.timedelta(hours=169), False),
])
def test_freshness_counts_hour_boundaries(result, ago, fresh):
    got = result("data_freshness", {"catalog_tables": [table("a", last_altered=NOW - ago)]})
    assert got == {"S": (int(fresh), 1, float(fresh))}


def test_provenance_and_lineage(result):
    def touched(name, domain="Table"):
        return [{"objectName": name, "objectDomain": domain}]
    old = NOW - dt.timedelta(days=30, seconds=1)
    edge = NOW - dt.timedelta(days=30)
    relations = {"catalog_tables": [table(n) for n in "abcd"], "access_history": [
        dict(query_id="1", query_start_time=edge, base_objects_accessed=touched("d.s.a"),
             objects_modified=touched("d.s.b")),
        dict(query_id="2", query_start_time=old, base_objects_accessed=touched("d.s.c")),
        dict(query_id="3", query_start_time=NOW, base_objects_accessed=touched("d.s.d", "View"),
             objects_modified=touched("d.x.c")),
        dict(query_id="4", query_start_time=NOW, base_objects_accessed=None,
             objects_modified=touched("D.S.C.col")),
    ]}
    assert result("data_provenance", relations) == {"S": (1, 4, 0.25)}
    assert result("lineage_completeness", relations) == {"S": (2, 4, 0.5)}


def test_classification_counts_tagged_names(result):
    def tag(name, domain="TABLE"):
        return dict(object_database="d", object_schema="S", object_name=name, domain=domain)
    assert result("classification", {
        "catalog_tables": [table("a"), table("b"), VIEW],
        "tag_references": [tag("a"), tag("a"), tag("A"), tag("b", "COLUMN"), tag("v"), tag("z")],
    }) == {"S": (2, 2, 1.0)}


def test_masking(result, params):
    def policy(col, kind="MASKING_POLICY"):
        return dict(ref_database_name="D", ref_schema_name="s", ref_entity_name="a",
                    ref_column_name=col, policy_kind=kind)
    relations = {
        "catalog_tables": [table("a"), VIEW],
        "catalog_columns": [column("a", c) for c in
                            ("Email", "_email", "customer_email", "phone", "emails")]
        + [column("v", "email")],
        "policy_references": [policy("EMAIL"), policy("email"), policy("phone", "ROW_ACCESS"),
                              policy("customer_email"), policy("emails")],
    }
    assert result("column_masking", relations) == {"S": (1, 3, 1 / 3)}
    searching = params.with_(pii_match="search")
    assert result("column_masking", relations, searching) == {"S": (2, 4, 0.5)}


def test_hidden_schema_and_chosen_schemas(rows):
    tables = rows("catalog_tables", table("a"), table("b", "s"), table("c", "T"),
                  table("d", "INFORMATION_SCHEMA"))
    assert sorted(r.schema_name for r in six.scope_list(tables).collect()) == ["S", "T"]
    assert [r.schema_name for r in six.scope_list(tables, ["t"]).collect()] == ["T"]


@pytest.fixture
def partial(rows):
    """A catalog without tags, policies and access logs."""
    return {
        "catalog_tables": rows("catalog_tables", table("a", last_altered=None), table("b", "T")),
        "catalog_columns": rows("catalog_columns", column("a", "x", is_nullable="NO")),
        "catalog_constraints": rows("catalog_constraints", constraint("a", "PRIMARY KEY")),
        "semantic_tables": rows("semantic_tables"),
    }


def test_a_missing_relation_is_an_error_row(partial, params):
    got = {(r.schema_name, r.requirement): r
           for r in six.six_factor_requirements(partial, params).collect()}
    assert len(got) == 2 * len(six.CHECKS)
    tags = got["S", "classification"]
    assert tags.error == "missing relation: tag_references"
    assert (tags.numerator, tags.value, tags.passed) == (None, None, None)
    assert got["S", "uniqueness"].passed is True and got["T", "uniqueness"].passed is False
    assert got["T", "data_completeness"].passed is None
    assert got["T", "data_completeness"].error is None


def test_scores_skip_what_is_unknown(partial, params):
    requirements = six.six_factor_requirements(partial, params)
    scores = {(r.schema_name, r.factor): r
              for r in six.six_factor_scores(requirements).collect()}
    assert scores["S", "Clean"].score == pytest.approx((1 + 1 + 0) / 3)
    assert scores["S", "Compliant"].score is None and scores["S", "Consumable"].score is None
    # Clean 2/3, Contextual (0 + 1 + 0) / 3, Current (0 + 0) / 2
    assert scores["S", "Clean"].overall == pytest.approx((2 / 3 + 1 / 3 + 0) / 3)
    wide = six.six_factor_portfolio(six.six_factor_scores(requirements))
    best, worst = six.by_overall(wide).collect()
    assert (best.schema_name, best.overall, best.tier, best.Clean, best.Compliant) == (
        "S", 33.3, "Low", 66.7, None)
    assert (worst.schema_name, worst.overall, worst.Current) == ("T", 16.7, 50.0)
    detail = {(r.schema_name, r.requirement): (r.value, r.fraction, r.result)
              for r in six.six_factor_detail(requirements).collect()}
    assert detail["S", "uniqueness"] == ("1.00", "1/1", "pass")
    assert detail["S", "column_masking"] == ("Error", "-", "-")
    assert detail["T", "data_completeness"] == ("N/A", "0/0", "-")
