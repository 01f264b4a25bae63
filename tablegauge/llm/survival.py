"""What each filter of a set removes, alone and in every order, by truth-table survival words.

A document's word has one bit for each of the 32 subsets of five filters: the bit of a subset is
set if the document survives all its filters. Words of one part and label class are added up bit
by bit with carry-save adders: three words of a weight become one of that weight and one of
twice the weight, until one word per weight is left. The 32 sums per part answer every question
about orders: what a filter removes after others, alone, first or on average.

Texts are read once; all later steps work on rows of a digest, an id and a few small columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import stored

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"
#: Cells that the copies of one text are spread over while their smallest id is found.
SALTS = 64
_COUNTS = [f"s{subset}" for subset in range(SUBSETS)]


def survival_words(failed: np.ndarray) -> np.ndarray:
    """The word of each mask of failed filters: the subsets that hold none of them."""
    subsets = np.arange(SUBSETS)
    words = ((subsets[:, None] & subsets) == 0) @ (1 << subsets.astype(np.uint64))
    return words.astype(np.uint32)[failed]


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set."""
    counts = np.zeros(32, dtype=np.int64)
    places = np.arange(32, dtype=np.uint32)
    layer, weight = words, 0
    while layer.size:
        carries = []
        while layer.size > 1:
            if layer.size == 2:
                layer = np.append(layer, np.uint32(0))
            third = layer.size // 3
            a, b, c = layer[:third], layer[third:2 * third], layer[2 * third:3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            layer = np.concatenate([half ^ c, layer[3 * third:]])
        counts += ((layer[0] >> places) & 1).astype(np.int64) << weight
        layer = np.concatenate(carries) if carries else layer[:0]
        weight += 1
    return counts


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and (part, class): survivors of each subset."""
    for batch in batches:
        words = survival_words(batch["failed"].to_numpy())
        for (part, good, toxic), rows in batch.groupby(["part", "good", "toxic"]).indices.items():
            yield pd.DataFrame(
                [[part, good, toxic, *positional_popcount(words[rows])]],
                columns=["part", "good", "toxic", *_COUNTS])


def _bit(letter: str, fails: Column) -> Column:
    return F.when(fails, 1 << FILTERS.index(letter)).otherwise(0)


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the filters A to D that it fails."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    rows = rows.select(
        "doc_id", "part", "text", F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (_bit("A", F.col("n_words") < 50)
         + _bit("B", 100 * F.col("n_distinct").cast("long") < 65 * F.col("n_words").cast("long"))
         + _bit("C", 100 * capitals.cast("long") > 5 * F.length("text").cast("long"))
         + _bit("D", F.col("text").rlike(r"[#$%&*|]"))).alias("failed"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Add filter E to the mask: another row of a smaller id has the same text.

    Copies of one text are spread over cells; only texts with several ids are joined back.
    """
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    cells = rows.groupBy("digest", "cell").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    several = cells.groupBy("digest").agg(*ends).where("low < high").select("digest", "low")
    lowest = cells.select("digest", "cell").join(several, "digest")
    copy = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))
    return rows.join(lowest, ["digest", "cell"], "left").select(
        "doc_id", "part", (F.col("failed") + _bit("E", copy)).alias("failed"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add whether any label of the id calls it good, and toxic; without one it is neither."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(marks, "doc_id", "left").select(
        "part", "failed", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))


def survivors(rows: DataFrame) -> DataFrame:
    """Per part and class, the number of documents that survive each subset of filters."""
    schema = "part string, good boolean, toxic boolean, " + ", ".join(
        f"{name} long" for name in _COUNTS)
    return rows.mapInPandas(_added, schema).groupBy("part", "good", "toxic").agg(
        *[F.sum(name).alias(name) for name in _COUNTS])


def _per_part(counts: DataFrame) -> DataFrame:
    """Arrays of 32 counts per part: of all, of good and of toxic documents; Shapley sums."""
    def totals(where: Column) -> Column:
        return F.array(*[F.sum(F.when(where, F.col(name)).otherwise(0)) for name in _COUNTS])

    parts = counts.groupBy("part").agg(
        totals(F.lit(True)).alias("every"), totals(F.col("good")).alias("good"),
        totals(F.col("toxic")).alias("toxic"))

    def shapley(bit: int) -> Column:
        """What the filter removes, summed over all orders: subsets before it, times orders."""
        terms = []
        for subset in range(SUBSETS):
            if not subset & bit:
                before = subset.bit_count()
                orders = factorial(before) * factorial(len(FILTERS) - 1 - before)
                terms.append(orders * (F.col("every")[subset] - F.col("every")[subset | bit]))
        return reduce(Column.__add__, terms)

    return parts.withColumn(
        "shapleys", F.array(*[shapley(1 << i) for i in range(len(FILTERS))]))


def _mask(letters: Column) -> Column:
    return reduce(Column.__add__, [_bit(f, F.contains(letters, F.lit(f))) for f in FILTERS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each order of the filters keeps and removes, per part.

    A null text counts as empty, a null source as the part "", as an empty one does. A null id is
    no smaller than any other and has no label; repeated rows count each; rows of one id are no
    copies of each other. An empty table gives no rows; other columns are not read.
    """
    rows = with_labels(with_copies(stored(own_failures(docs))), labels)
    orders = " ".join("".join(p) for p in permutations(FILTERS))
    steps = _per_part(survivors(rows)).select(
        "*", F.explode(F.split(F.lit(orders), " ")).alias("filter_order")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    steps = steps.select(
        "*", F.substring("filter_order", F.col("step"), F.lit(1)).alias("letter"),
        _mask(before).alias("before"))
    steps = steps.withColumn("bit", _mask(F.col("letter")))

    def count(counts: str, subset: Column) -> Column:
        return F.get(counts, subset)

    after, full = F.col("before") + F.col("bit"), SUBSETS - 1

    def removed(counts: str) -> Column:
        return count(counts, F.col("before")) - count(counts, after)

    return steps.select(
        "part", "filter_order", "step", count("every", after).alias("kept"),
        removed("every").alias("removed"),
        (count("every", F.lit(0)) - count("every", F.col("bit")) - removed("every"))
        .alias("redundant"),
        (count("every", full - F.col("bit")) - count("every", F.lit(full))).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"),
        F.get("shapleys", F.instr(F.lit(FILTERS), F.col("letter")) - 1).alias("shapley"))
