"""Formulas, bands and texts at their boundaries."""

import pytest
from pyspark.sql import functions as F

from tablegauge import constants as K
from tablegauge.functions import bands, scoring


def test_speed(values):
    assert values(scoring.speed, [1e-6, 5000.0, 10000.0]) == pytest.approx([1, 0.5, 1 / 9])


def test_freshness_halves_and_defaults(values):
    got = values(scoring.freshness, [0, 30, 60, None], "int")
    assert got == pytest.approx([1.0, 0.5, 0.25, 0.25])


def test_consumption_readiness_floors_every_signal(values):
    def score(v):
        return scoring.consumption_readiness(activity=v, consumption=v, speed=v, freshness=v)
    assert values(score, [0.0, 0.001, 0.5, 1.0]) == pytest.approx([0.001, 0.001, 0.5, 1.0])

    def unread(v):
        one = F.lit(1.0)
        return scoring.consumption_readiness(activity=v, consumption=v, speed=one, freshness=one)
    assert values(unread, [0.0])[0] == pytest.approx(0.001 ** 0.65)


def test_saturating_points(values):
    assert values(scoring.vqr_points, [0, 10, 20], "int") == pytest.approx([0, 1.8, 1.98])
    assert values(scoring.comment_points, [0.0, 50.0, 100.0]) == pytest.approx([0, 0.9, 0.99])


def test_gap_waterfall(spark):
    cases = [
        (None, 3, 1.0, 1.0, "BUILD_CR_TABLES"), (0.9, 0, 1.0, 1.0, "BUILD_CR_TABLES"),
        (0.49, 3, 1.0, 1.0, "BUILD_CR_TABLES"), (0.5, 3, 0.0, 0.0, "BUILD_SVS"),
        (0.5, 3, 0.49, 1.0, "EXPAND_SV_COVERAGE"), (0.5, 3, 0.5, 0.49, "IMPROVE_SV_QUALITY"),
        (0.5, 3, 0.5, 0.5, "HEALTHY"),
    ]
    frame = spark.createDataFrame(cases, "d double, n long, c double, q double, want string")
    got = frame.select("want", scoring.gap_class(
        F.col("d"), F.col("n"), F.col("c"), F.col("q")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_ratio_and_pass(spark, params):
    cases = [(4999, 10000, False), (1, 2, True), (0, 0, None)]
    frame = spark.createDataFrame(cases, "n long, d long, want boolean")
    ratio = scoring.ratio(F.col("n"), F.col("d"))
    got = frame.select("want", scoring.passes(ratio, params).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_tier(values):
    got = values(scoring.six_factor_tier, [0.3999, 0.40, 0.6999, 0.70, None])
    assert got == ["Low", "Medium", "Medium", "High", "N/A"]


def test_size_tiers(values):
    sizes = [0, 99, 100, 999, 1000]
    assert values(scoring.size_tier, sizes, "long") == [
        "small", "small", "medium", "medium", "large"]
    assert values(scoring.probe_count, sizes, "long") == [3, 3, 6, 6, 10]


def test_probe_sets_match_their_number():
    # The count of the rows, the limits and extremes, a sample from medium on, and distinct rows.
    other = {"small": 1, "medium": 2, "large": 3}
    for name, n in (K.SIZE_SMALL, *[(t[1], t[2]) for t in K.SIZE_TIERS]):
        assert other[name] + len(K.PROBE_LIMITS[name]) + len(K.PROBE_TOPK[name]) == n


def test_stage_and_colour(values):
    scores = [0.0, 10.0, 10.1, 30.0, 30.1, 55.0, 55.1, 75.0, 100.0, 101.0]
    assert values(bands.score_stage, scores) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert values(bands.score_band, scores) == [
        "low", "low", "low", "low", "mid", "mid", "high", "high", "high", "high"]


@pytest.mark.parametrize("dimension", K.DIMENSION_TEXTS)
def test_dimension_text_at_its_cut_points(values, dimension):
    texts = K.DIMENSION_TEXTS[dimension]
    for (bound, below), (_, above) in zip(texts, texts[1:]):
        at, over = values(lambda v: bands.dimension_text(dimension, v), [float(bound), bound + 0.4])
        assert over.endswith(above)
        assert at.endswith(below if dimension == "AI Readiness" else above)
        assert at.startswith(f"{bound}{K.DIMENSION_UNITS[dimension]} - ")


def test_unknown_codes_are_shown_as_they_are(values):
    assert values(bands.gap_label, ["HEALTHY", "NEW"], "string") == [
        "maintain your current position", "NEW"]
    assert values(bands.item_tag, ["SCHEMA_GAP", "NEW"], "string") == ["Low CR coverage", "NEW"]
