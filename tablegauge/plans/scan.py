"""Whole scans over an estate, from its relations to scores, items and stored runs."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame

from tablegauge.operators import composite as comp
from tablegauge.operators import consumption, history, items, semantic, sixfactor
from tablegauge.params import ScanParams
from tablegauge.session import settle
from tablegauge.sources.relations import Relations
from tablegauge.sources.schemas import INPUTS

LOGS = ("access_history", "query_history", "sessions", "tables")


class Scan(NamedTuple):
    scores: DataFrame
    quality: DataFrame
    composite: DataFrame
    items: DataFrame


def scores_of(estate: Relations, params: ScanParams) -> DataFrame:
    """CR scores of every read table per scope."""
    return consumption.cr_scores(*[estate[name] for name in LOGS], params)


def inputs_of(estate: Relations, params: ScanParams) -> DataFrame:
    """All that scans of any scope need of the logs, computed once."""
    whole = params.with_(scope=None)
    return settle(consumption.cr_inputs(*[estate[name] for name in LOGS], whole))


def quality_of(estate: Relations) -> DataFrame:
    """Quality of every semantic view; without view properties, no verified queries."""
    views = estate["semantic_views"]
    if "sv_properties" in estate:
        properties = estate["sv_properties"]
    else:
        properties = views.sparkSession.createDataFrame([], INPUTS["sv_properties"])
    return semantic.sv_quality(
        views, estate["semantic_tables"], {name: estate[name] for name in semantic.MEMBERS},
        estate["semantic_relationships"], semantic.vqr_counts(properties),
    )


def scopes_of(estate: Relations, params: ScanParams) -> DataFrame:
    """Scopes to report: the chosen database, or every database and the whole estate."""
    if params.single_scope is not None:  # also one that the catalog does not know
        return estate["catalog_tables"].sparkSession.createDataFrame(
            [(params.single_scope,)], "scope string")
    return comp.estate_scopes(sixfactor.scope_list(estate["catalog_tables"]).select("database_name"))


def full_scan(
    estate: Relations, params: ScanParams, inputs: DataFrame | None = None,
    quality: DataFrame | None = None,
) -> Scan:
    """Demand and semantic scores of every scope, with the to-do list that fits each.

    Scores, qualities and composites have one row per table, view and scope; they are
    computed once and kept, so the logs are scanned a single time for all that follows. Several
    scans of one estate share that time, whatever their scopes, by the same :func:`inputs_of`
    and by the ``quality`` of an earlier scan.
    """
    scores = settle(scores_of(estate, params) if inputs is None
                    else consumption.scores_of_inputs(inputs, params))
    quality = settle(quality_of(estate)) if quality is None else quality
    scopes = scopes_of(estate, params)
    composite = settle(comp.composite_scores(scores, quality, params, scopes))
    todo = items.improvement_items(composite, scores, quality, params)
    return Scan(scores, quality, items.top_targets(composite, todo, params), todo)


def save_scan(
    scan: Scan, folder: str, params: ScanParams, call_id: str | None = None
) -> DataFrame:
    """Append a scan to the history and return the run rows of this call.

    Every call adds runs of its own, unless it is a repetition under the same ``call_id``, which
    adds nothing and returns what the first has added.
    """
    call_id = call_id or uuid.uuid4().hex
    runs = history.run_rows(scan.composite, params, call_id)
    history.append_history(runs, history.item_rows(scan.items, runs), folder, call_id)
    return history.load_runs(scan.composite.sparkSession, folder, call_id)


def six_factor_scan(
    estate: Relations, params: ScanParams, schemas: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Requirements of every schema, and the portfolio they add up to."""
    requirements = sixfactor.six_factor_requirements(estate, params, schemas)
    scores = sixfactor.six_factor_scores(requirements)
    return requirements, sixfactor.six_factor_portfolio(scores)
