"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; each of its documents should occur target / size of
the source times. The whole part is certain. The fractions are rounded in pairs: words move at
random from one document to another of its source until one of the two is decided; the other
goes on. A pair's words stay the same and every document keeps its expected copies, so a
source misses its target by half a document at most. Blocks of a source are rounded in parallel,
and what each leaves undecided is combined block by block, up a tree of tasks.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import hashed, stored

#: Documents of a source that one task rounds, and blocks whose rest it combines.
BLOCK_ROWS = 4096
FAN_IN = 256
#: Weights of the sources in order of their names, repeating, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3
EPSILON = 1e-9
#: A block whose undecided rest is more than this share of its words is drawn anew, so often.
NEAR = 0.001
TRIES = 16

ROUNDED = "doc_id long, text_hash long, number long, size long, share double, node long"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``number``, ``target`` to one row per source (source, source_size, n).

    Shares of all words by weight, none above ``most`` times its source: sources in order of
    the level at which they reach their cap; up to the right level all are capped, beyond it
    the rest shares what is left. One row per source goes through one task.
    """
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(cap / F.col("weight"), "number")
    done = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    frame = sizes.withColumn("number", F.row_number().over(by_name).cast("long") - 1)
    frame = frame.withColumn("weight", weight).withColumns({
        "level": (F.sum("source_size").over(everything)
                  - F.coalesce(F.sum(cap).over(done), F.lit(0))) / F.sum("weight").over(rest),
    })
    frame = frame.withColumn(
        "fits", F.when(F.col("level") * F.col("weight") <= cap, F.col("level")))
    first = F.first("fits", ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    frame = frame.withColumn("level", first)
    return frame.select(
        "source", "source_size", "n", "number",
        F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def pivot(sizes: np.ndarray, shares: np.ndarray, random: np.random.Generator) -> int:
    """Round shares in place; the index of the one left undecided, or -1."""
    held = -1
    for i in range(len(sizes)):
        if not EPSILON < shares[i] < 1 - EPSILON:
            shares[i] = round(shares[i])
        elif not sizes[i]:
            shares[i] = float(random.random() < shares[i])  # moves no words
        elif held < 0:
            held = i
        else:
            a, b, wa, wb = shares[held], shares[i], sizes[held], sizes[i]
            up, down = min((1 - a) * wa, b * wb), min(a * wa, (1 - b) * wb)
            move = up if random.random() * (up + down) < down else -down
            shares[held], shares[i] = a + move / wa, b - move / wb
            for k in (held, i):
                if not EPSILON < shares[k] < 1 - EPSILON:
                    shares[k] = round(shares[k])
            open_ = [k for k in (held, i) if 0 < shares[k] < 1]
            held = open_[0] if open_ else -1
    return held


def _round(df: DataFrame, seed: int, level: int) -> DataFrame:
    """Round each node of the tree; rows still undecided have a share between 0 and 1."""
    def rounded(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: what stays undecided is then short.
        rows = rows.sort_values(
            ["size", "doc_id", "text_hash"], ascending=[False, True, True], ignore_index=True)
        random = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        sizes, given = rows["size"].to_numpy(dtype=float), rows["share"].to_numpy(dtype=float)
        best, least = given, np.inf
        for _ in range(TRIES):
            shares = given.copy()
            held = pivot(sizes, shares, random)
            off = sizes[held] * min(shares[held], 1 - shares[held]) if held >= 0 else 0.0
            if off < least:
                best, least = shares, off
            if least <= NEAR * sizes.sum():
                break
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        return rows.assign(share=best)

    return df.groupBy("number", "node").applyInPandas(rounded, ROUNDED)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17
) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target and copies of every row.

    A null text has no words; a null source is a source of its own, the last one. Documents
    without words are copied by their own chance. Repeated rows are rounded separately. Extra
    columns are not read; an empty input gives no rows.
    """
    slim = stored(docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        hashed(7, F.col("text")).alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        .cast("long").alias("size"),
    ))
    sources = stored(targets(
        slim.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, most))
    rate = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    rows = (
        slim.join(sources, slim["source"].eqNullSafe(sources["source"]))
        .select("doc_id", "text_hash", "number", "size",
                (rate - F.floor(rate)).alias("share"),
                F.pmod(hashed(seed, F.col("doc_id"), F.col("text_hash")),
                       F.ceil(F.col("n") / BLOCK_ROWS)).alias("node"))
    )
    largest = sources.agg(F.max("n")).first()[0] or 0
    nodes, level, decided = -(-largest // BLOCK_ROWS), 0, []
    undecided = (F.col("share") > 0) & (F.col("share") < 1)
    while True:
        rows = stored(_round(rows, seed, level))
        decided.append(rows.filter(~undecided))
        rows = rows.filter(undecided)
        if nodes <= 1:
            break
        nodes, level = -(-nodes // FAN_IN), level + 1
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN_IN))
    # One document of a source at most is left; the nearer side keeps the target closest.
    decided.append(rows.withColumn("share", F.round("share")))
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    return result.join(sources, "number").select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        (F.floor(rate) + F.col("share")).cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns.

    Rows alike in doc_id, source and text are dealt their copies together.
    """
    names = ["__mix_id", "__mix_source", "__mix_hash"]
    copies = (
        mix(docs, **options)
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.sum("copies").alias("__mix_copies"), F.count(F.lit(1)).alias("__mix_rows"))
        .filter("__mix_copies > 0")
        .withColumnsRenamed(dict(zip(["doc_id", "source", "text_hash"], names, strict=True)))
    )
    here = [F.col("doc_id").cast("long"), F.col("source").cast("string"), hashed(7, F.col("text"))]
    joined = docs.join(copies, [x.eqNullSafe(F.col(n)) for x, n in zip(here, names, strict=True)])
    once = joined.filter("__mix_rows = 1")
    alike = joined.filter("__mix_rows > 1").dropDuplicates(names)
    return once.unionByName(alike).withColumn(
        "__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))
    ).select(*docs.columns)
