"""Score formulas as column expressions."""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegauge import constants as K
from tablegauge.params import ScanParams


def speed(p50_ms: Column) -> Column:
    """1 for instant tables, 0.5 at the midpoint, falling with the cube beyond."""
    return 1.0 / (1.0 + F.pow(p50_ms / K.SPEED_MIDPOINT_MS, F.lit(float(K.SPEED_POWER))))


def freshness(days_since_update: Column) -> Column:
    """Halves every half-life; tables without a recent change count as DEFAULT_AGE_DAYS old."""
    rate = -math.log(2) / K.FRESHNESS_HALF_LIFE_DAYS
    return F.exp(F.lit(rate) * F.coalesce(days_since_update, F.lit(K.DEFAULT_AGE_DAYS)))


def consumption_readiness(**signals: Column) -> Column:
    """Weighted geometric mean of the four signals, each at least SCORE_FLOOR."""
    return reduce(mul, [
        F.pow(F.greatest(signals[name], F.lit(K.SCORE_FLOOR)), F.lit(weight))
        for name, weight in K.WEIGHTS.items()
    ])


def vqr_points(n_verified_queries: Column) -> Column:
    """Up to 2 points; 10 verified queries earn 90% of them."""
    return 2 * (1 - F.exp(F.lit(-math.log(10) / K.VQR_SCALE) * n_verified_queries))


def comment_points(mean_length: Column) -> Column:
    """Up to 1 point; a mean comment of 100 characters earns 99% of it."""
    return 1 - F.exp(F.lit(-math.log(100) / K.COMMENT_SCALE) * mean_length)


def sv_readiness(coverage: Column, quality: Column) -> Column:
    return F.sqrt(coverage * quality)


def ai_readiness(demand: Column, coverage: Column, quality: Column) -> Column:
    return (F.coalesce(demand, F.lit(0.0)) + sv_readiness(coverage, quality)) / 2


def gap_class(demand: Column, n_cr_tables: Column, coverage: Column, quality: Column) -> Column:
    """The first thing to fix; an unknown demand or no CR table at all comes first."""
    return (
        F.when(demand.isNull() | (n_cr_tables == 0) | (demand < K.GAP_CUT), "BUILD_CR_TABLES")
        .when(coverage == 0, "BUILD_SVS")
        .when(coverage < K.GAP_CUT, "EXPAND_SV_COVERAGE")
        .when(quality < K.GAP_CUT, "IMPROVE_SV_QUALITY")
        .otherwise("HEALTHY")
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double; NULL when there is nothing to divide by."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def passes(value: Column, params: ScanParams) -> Column:
    return value >= params.pass_threshold


def six_factor_tier(overall: Column) -> Column:
    tier = F.when(overall.isNull(), K.TIER_UNSCORED)
    for bound, name in K.TIERS:
        tier = tier.when(overall >= bound, name)
    return tier.otherwise(K.TIER_LOW)


def size_tier(row_count: Column) -> Column:
    """small, medium or large, which decides how many probes a table gets."""
    return _by_size(row_count, 1, K.SIZE_SMALL[0])


def probe_count(row_count: Column) -> Column:
    return _by_size(row_count, 2, K.SIZE_SMALL[1])


def _by_size(row_count: Column, field: int, smallest) -> Column:
    largest, middle = K.SIZE_TIERS
    return (
        F.when(row_count >= largest[0], largest[field])
        .when(row_count >= middle[0], middle[field])
        .otherwise(smallest)
    )
