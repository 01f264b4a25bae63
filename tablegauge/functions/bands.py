"""Bands, labels and texts for a score, and number formats shared by all texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegauge import constants as K


def whole(value: Column) -> Column:
    """A number rounded to the unit, as text."""
    return F.round(value).cast("long").cast("string")


def grouped(value: Column) -> Column:
    """A count with thousands separators."""
    return F.format_number(value, 0)


def lookup(names: dict[str, str], key: Column) -> Column:
    """Display name of a code; an unknown code is shown as it is."""
    return _bands([(key == code, label) for code, label in names.items()], key)


def score_stage(score: Column) -> Column:
    """Stage number 1-5; a score above the last bound stays in the last stage."""
    return _up_to(score, [(bound, n) for n, (bound, _) in enumerate(K.STAGES, 1)], len(K.STAGES))


def stage_title(score: Column) -> Column:
    return _up_to(score, K.STAGES, K.STAGES[-1][1])


def stage_text(score: Column) -> Column:
    """What a stage asks for."""
    texts = [(bound, text) for (bound, _), text in zip(K.STAGES, K.STAGE_TEXTS, strict=True)]
    return _up_to(score, texts, K.STAGE_TEXTS[-1])


def score_band(score: Column) -> Column:
    """Colour band of a score: low, mid or high."""
    return _up_to(score, K.COLOUR_BANDS, K.COLOUR_TOP)


def dimension_text(dimension: str, score: Column) -> Column:
    """Score with its unit and one sentence on what it means."""
    *bounded, (_, top) = K.DIMENSION_TEXTS[dimension]
    inclusive = dimension == "AI Readiness"
    text = _up_to(score, bounded, top) if inclusive else _below(score, bounded, top)
    return F.concat(whole(score), F.lit(K.DIMENSION_UNITS[dimension] + " - "), text)


def gap_label(gap: Column) -> Column:
    return lookup(K.GAP_LABELS, gap)


def item_tag(item_type: Column) -> Column:
    return lookup(K.ITEM_TAGS, item_type)


def _up_to(value: Column, bounds, top) -> Column:
    return _bands([(value <= bound, result) for bound, result in bounds], top)


def _below(value: Column, bounds, top) -> Column:
    return _bands([(value < bound, result) for bound, result in bounds], top)


def _bands(cases, top) -> Column:
    first, *rest = cases
    chain = F.when(*first)
    for condition, result in rest:
        chain = chain.when(condition, result)
    return chain.otherwise(top)
