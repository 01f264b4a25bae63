"""Quality rules: fixed limits, then robust multivariate outliers within language and source.

Counts of every text become a vector of six transformed statistics. The minimum covariance
determinant (MCD) of a group is the mean and covariance of the three quarters of its documents
whose covariance is smallest, so junk does not shape what counts as usual. A document is rejected
if its squared Mahalanobis distance passes a chi-square quantile.

Concentration steps run on Spark for all groups and starts at once: every document's distance
under the current estimate falls into a fine bucket, moments are added up per bucket on the map
side, and the buckets that hold the nearest three quarters give the next estimate. So all
documents count, no group is gathered, and a group of any size costs one row per bucket.
Estimates of a source lean on those of its language as if that had given WEIGHT documents, which
carries groups of a few documents without a switch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import stored

DIM = 6
#: Share of a group that its estimate rests on.
CORE = 0.75
#: Documents' worth of the language's estimate in that of a source.
WEIGHT = 50.0
#: Standard deviations that are added to every estimate: differences too small to mean anything.
#: In order: ln words, ln letters a word, ln symbols, repeated lines, repeated words, capitals.
FLOOR = (0.3, 0.08, 0.4, 0.2, 0.2, 0.06)
#: Chance that an ordinary document lies beyond the limit.
REJECTED = 1e-5
#: Concentration steps at most; they end when no ln determinant falls by SETTLED.
STEPS, SETTLED = 8, 0.01
#: Buckets per unit of ln(squared distance), and cells per unit of a statistic for quartiles.
BUCKETS, GRID = 64, 200
SPACE, SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_capitals")
X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def repeated_words(words: list[bytes]) -> int:
    """Words within windows of three words that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, windows, times = np.unique(
        pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = times[windows] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The COUNTS of a text in UTF-8; only ASCII white space parts words."""
    def without(characters: bytes) -> int:
        return len(text.translate(None, characters))

    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = len(text.translate(None, SPACE + CONTINUED))
    return (len(words), letters, len(text) - without(SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(text) - without(CAPITALS))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(text.as_py()) for text in batch.column("text")]
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [
            pa.array([], pa.int64())] * len(COUNTS)
        kept = ["doc_id", "lang", "source"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), *columns], names=[*kept, *COUNTS])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the COUNTS of every whole text; a null text counts as empty."""
    rows = docs.select(
        F.col("doc_id").cast("long"), "lang", "source",
        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_measured, "doc_id long, lang string, source string, " + ", ".join(
        f"{name} long" for name in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics: logarithms of counts, arc sines of shares."""
    def share(part: str, whole: str) -> Column:
        return F.asin(F.sqrt(F.col(part) / F.greatest(whole, F.lit(1))))

    words = F.greatest("n_words", F.lit(1))
    return dict(zip(X, (
        F.log(words), F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.log1p(100 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
        share("n_capitals", "word_chars"),
    ), strict=True))


def below(x: float, degrees: int) -> float:
    """Chance that a chi-square variable of an even number of degrees is below x."""
    return 1 - math.exp(-x / 2) * sum(
        (x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def quantile(chance: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle, degrees) < chance else (low, middle)
    return high


#: What the covariance of the nearest CORE of a normal sample is short of the whole one's.
SHORT = below(quantile(CORE, DIM), DIM + 2) / CORE
LIMIT = quantile(1 - REJECTED, DIM)

_ESTIMATE = ("`group` string, start int, location array<double>, spread array<double>, "
             "whitener array<double>, logdet double")


def _estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates from added-up moments and, where there is one, the language's estimate."""
    floor = np.diag(np.square(FLOOR))
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            mean = np.array(row.sums) / row.n
            second = np.zeros((DIM, DIM))
            for (i, j), value in zip(PAIRS, row.products, strict=True):
                second[i, j] = second[j, i] = value / row.n
            spread = (second - np.outer(mean, mean)) / row.short
            if row.above is not None:
                own = row.n / (row.n + WEIGHT)
                mean = own * mean + (1 - own) * np.array(row.above)
                spread = own * spread + (1 - own) * np.reshape(row.around, (DIM, DIM))
            whole = spread + floor
            values, vectors = np.linalg.eigh(whole)
            # Rounding may leave an eigenvalue a hair below that of the floor.
            values = np.maximum(values, min(FLOOR) ** 2)
            whitener = (vectors / np.sqrt(values)).T
            out.append((row.group, row.start, mean.tolist(), spread.ravel().tolist(),
                        whitener.ravel().tolist(), float(np.log(values).sum())))
        yield pd.DataFrame(out, columns=[
            "group", "start", "location", "spread", "whitener", "logdet"])


def distance() -> str:
    """Squared Mahalanobis distance of x0.. under the row's location and whitener.

    SQL text, as all long expressions here: built of Columns they would take longer than the job.
    """
    return " + ".join(
        "pow(" + " + ".join(
            f"whitener[{axis * DIM + i}] * ({x} - location[{i}])" for i, x in enumerate(X))
        + ", 2)" for axis in range(DIM))


#: Sums that make up the moments of a group, and the expressions they add up.
SUMS = {"n": "1", **{f"s{x}": x for x in X}, **{f"p{i}_{j}": f"x{i} * x{j}" for i, j in PAIRS}}


def _sums(terms: dict[str, str]) -> list[Column]:
    return [F.expr(f"sum({term}) as {name}") for name, term in terms.items()]


def _estimates(moments: DataFrame, above: DataFrame, short: float) -> DataFrame:
    """``moments`` of each group and start as estimates; ``above`` may hold the language's."""
    rows = moments.selectExpr(
        "group", "start", "n", f"array({', '.join(f's{x}' for x in X)}) as sums",
        f"array({', '.join(f'p{i}_{j}' for i, j in PAIRS)}) as products", f"{short}D as short")
    return stored(rows.join(above, "group", "left").mapInPandas(_estimated, _ESTIMATE))


def quartiles(rows: DataFrame) -> DataFrame:
    """Median and a scale from the quartiles of each statistic per group, on a grid."""
    cells = rows.select("group", F.posexplode(F.array(*X)).alias("axis", "value")).groupBy(
        "group", "axis", F.floor(F.col("value") * GRID).alias("cell")
    ).agg(F.count(F.lit(1)).alias("n"))
    all_of = Window.partitionBy("group", "axis")
    upto = F.sum("n").over(
        all_of.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = cells.select("*", (upto / F.sum("n").over(all_of)).alias("upto"))

    def at(level: float) -> Column:
        return F.min(F.when(F.col("upto") >= level, (F.col("cell") + 0.5) / GRID))

    scale = (at(0.75) - at(0.25)) / 1.349
    axes = share.groupBy("group", "axis").agg(at(0.5).alias("middle"), scale.alias("scale"))
    return axes.groupBy("group").agg(*[
        F.max(F.when(F.col("axis") == i, F.col(c))).alias(f"{c}{i}")
        for c in ("middle", "scale") for i in range(DIM)])


def starts(rows: DataFrame, above: DataFrame) -> DataFrame:
    """Two estimates to concentrate from: quartiles alone, and with damped correlations.

    The second takes the moments of values drawn in by a hyperbolic tangent around the median,
    which outliers move little.
    """
    spots = rows.join(stored(quartiles(rows)), "group")
    drawn = spots.selectExpr("group", *[
        f"middle{i} + (scale{i} + {FLOOR[i]}D) * tanh(({x} - middle{i}) / (scale{i} + {FLOOR[i]}D))"
        f" as {x}" for i, x in enumerate(X)])
    second = drawn.groupBy("group").agg(*_sums(SUMS)).selectExpr("group", "1 as start", *SUMS)
    first = spots.groupBy("group").agg(*_sums({
        "n": "1", **{f"s{x}": f"middle{i}" for i, x in enumerate(X)},
        **{f"p{i}_{j}": f"middle{i} * middle{j}" + (f" + scale{i} * scale{i}" if i == j else "")
           for i, j in PAIRS}})).selectExpr("group", "0 as start", *SUMS)
    return _estimates(first.unionByName(second), above, 1.0)


def concentrated(rows: DataFrame, estimates: DataFrame, above: DataFrame) -> DataFrame:
    """One step: estimates from the nearest CORE of each group under the given ones."""
    near = rows.join(estimates.select("group", "start", "location", "whitener"), "group")
    buckets = near.selectExpr(
        "group", "start", *X, f"floor(ln({distance()} + 1e-12D) * {BUCKETS}) as bucket"
    ).groupBy("group", "start", "bucket").agg(*_sums(SUMS))
    whole = "partition by group, start"
    core = buckets.selectExpr(
        "*", f"sum(n) over ({whole}) as all_rows",
        f"sum(n) over ({whole} order by bucket rows between unbounded preceding and current row)"
        " - n as before"
    ).where(f"before < {CORE} * all_rows").groupBy("group", "start").agg(
        *_sums({name: name for name in SUMS}))
    return _estimates(core, above, SHORT)


def mcd(rows: DataFrame, above: DataFrame) -> DataFrame:
    """The estimate of smallest determinant of every group.

    ``rows`` has group and x0..x5, ``above`` group, above and around: an estimate each leans on.
    """
    now = starts(rows, above)
    for _ in range(STEPS):
        last, now = now, concentrated(rows, now, above)
        fallen = now.join(last.select("group", "start", F.col("logdet").alias("was")),
                          ["group", "start"]).agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        if fallen is None or fallen < SETTLED:
            break
    best = F.min_by(F.struct("location", "spread", "whitener"), F.struct("logdet", "start"))
    return now.groupBy("group").agg(best.alias("best")).select("group", "best.*")


def _key(*columns: str) -> Column:
    """One string for several columns, nulls apart from empty strings."""
    return F.to_json(F.array(*[F.col(c) for c in columns]))


def judged(docs: DataFrame) -> DataFrame:
    """The counts of every document, whether it fails the base rules, its distance, and the verdict.

    Only documents that pass the base rules shape the estimates and have a distance; a null text
    counts as empty and fails. A null language or source is a group of its own; repeated rows count
    each; equal vectors are equally usual. Empty tables give no rows; other columns are not read.
    """
    rows = stored(measured(docs))
    rows = rows.withColumns({"base_failed": base_failed(), **vector()})
    sound = rows.where(~F.col("base_failed"))
    languages = stored(mcd(
        sound.select(_key("lang").alias("group"), *X),
        docs.sparkSession.createDataFrame(
            [], "group string, above array<double>, around array<double>")))
    groups = sound.select(
        _key("lang").alias("language"), _key("lang", "source").alias("group")).distinct()
    above = stored(groups.join(
        languages.withColumnRenamed("group", "language"), "language").select(
        "group", F.col("location").alias("above"), F.col("spread").alias("around")))
    usual = stored(mcd(sound.select(_key("lang", "source").alias("group"), *X), above))
    placed = rows.withColumn("group", _key("lang", "source")).join(
        usual.select("group", "location", "whitener"), "group", "left")
    far = F.when(~F.col("base_failed"), F.expr(distance()))
    return placed.select(
        "doc_id", *COUNTS, "base_failed", F.sqrt(far).alias("distance"),
        F.coalesce(far <= LIMIT, F.lit(False)).alias("kept"))
