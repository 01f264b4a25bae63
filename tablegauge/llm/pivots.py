"""Near-equal embeddings by an exact comparison of cells around pivots.

Pivots are a documented sample of the vectors, those too close to an earlier one left out.
Every vector lives in the cell of its nearest pivot. A pair of vectors is compared in the task
of its two cells unless the triangle inequality of angles rules it out: a vector further from
a pivot than the cell's radius and the angle of a link has no link into that cell. So no link
is lost, whatever the density of its region. Where nothing can be ruled out (vectors without
any structure), all pairs are compared.

A cell is cut into blocks; a task sees two blocks, and every pair of vectors meets in one
task only. Tasks return counts and a spanning link per vector, not pairs. Equal vectors are
one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import hashed, stored
from tablegauge.llm.graph import components
from tablegauge.llm.vectors import classes

#: Vectors of a cell that one block holds: this share of all, at least and at most so many.
SHARE = 1 / 20
LEAST, MOST = 2048, 16_384
#: Pivots per block of all vectors, at least; the cosine from which one is too close.
PER_BLOCK, FEW = 2, 8
CLOSE = 0.9
#: Rows of a block that are compared at a time, and what rounding may do to an angle.
ROWS = 256
SLACK = 1e-6


def block_size(n: int) -> int:
    return min(MOST, max(LEAST, math.ceil(SHARE * n)))


def pivots_of(found: DataFrame, n: int) -> np.ndarray:
    """A sample of the vectors by the hash of their class, far apart, as unit vectors."""
    wanted = max(FEW, math.ceil(PER_BLOCK * n / block_size(n)))
    rows = found.orderBy(hashed(61, F.col("class")), "class").limit(wanted).select(
        "vector").collect()
    sample = _units(np.array([r["vector"] for r in rows]))
    kept = []
    for v in sample:
        if not kept or (np.stack(kept) @ v).max() < CLOSE:
            kept.append(v)
    return np.stack(kept)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(x) @ pivots.T, -1, 1))


def _packed(x: np.ndarray) -> list[bytes]:
    """Components in single precision where that is exact."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    exact = (single == x).all(axis=1)
    return [(s if e else d).tobytes() for s, d, e in zip(single, x, exact, strict=True)]


def _unpacked(packed: pd.Series, dimension: int) -> np.ndarray:
    return _units(np.stack([
        np.frombuffer(b, dtype=np.float32 if len(b) == 4 * dimension else np.float64)
        for b in packed]).astype(np.float64))


def describe(found: DataFrame, pivots: np.ndarray) -> DataFrame:
    """node, times, components, cell and angle to its pivot of every class."""
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                x = np.stack(part["vector"].to_list())
                angles = _angles(x, pivots)
                yield pd.DataFrame({
                    "node": part["node"].to_numpy(), "times": part["times"].to_numpy(),
                    "packed": _packed(x), "cell": angles.argmin(axis=1).astype("i4"),
                    "angle": angles.min(axis=1)})

    return found.select("node", "times", "vector").mapInPandas(
        nearest, "node long, times long, packed binary, cell int, angle double")


def place(
    described: DataFrame, pivots: np.ndarray, blocks: dict[int, tuple[int, float]], cosine: float
) -> DataFrame:
    """Every vector once for each pair of blocks in which it may have a link.

    ``blocks`` has the number of blocks and the radius of every cell that is not empty.
    """
    dimension = pivots.shape[1]
    cells = np.array(sorted(blocks), dtype=np.int64)
    counts = np.array([blocks[c][0] for c in cells], dtype=np.int64)
    reach = np.array([blocks[c][1] for c in cells]) + math.acos(
        min(1.0, max(-1.0, cosine))) + SLACK
    first = np.cumsum(counts) - counts
    centres = pivots[cells]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512].reset_index(drop=True)
                x = _unpacked(part["packed"], dimension)
                near = np.arccos(np.clip(x @ centres.T, -1, 1)) <= reach
                home = np.searchsorted(cells, part["cell"].to_numpy())
                near[np.arange(len(part)), home] = True
                # One column per block; the vector's own block first of the pair or second.
                open_ = np.repeat(near, counts, axis=1)
                own = first[home] + part["slot"].to_numpy() % counts[home]
                row, other = np.nonzero(open_)
                yield pd.DataFrame({
                    "left": np.minimum(own[row], other).astype("i4"),
                    "right": np.maximum(own[row], other).astype("i4"),
                    "block": own[row].astype("i4"), "node": part["node"].to_numpy()[row],
                    "times": part["times"].to_numpy()[row],
                    "packed": part["packed"].to_numpy()[row]})

    return described.withColumn(
        "slot", F.pmod(hashed(63, F.col("node")), F.lit(1 << 40))).mapInPandas(
        spread, "left int, right int, block int, node long, times long, packed binary")


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def compare(rows: pd.DataFrame, left: int, right: int, cosine: float, dimension: int
            ) -> pd.DataFrame:
    """What one pair of blocks finds: node, links counted here, a linked node.

    ``links`` counts members of linked classes.
    """
    rows = rows.sort_values("node")
    nodes = rows["node"].to_numpy()
    block = rows["block"].to_numpy()
    times = rows["times"].to_numpy().astype(np.float64)
    one, two = (np.flatnonzero(block == b) for b in (left, right))
    counts = np.zeros(len(rows))
    parent = np.arange(len(rows))
    if len(one) and len(two):
        unit = _unpacked(rows["packed"], dimension)
        other = unit[two].T
        for at in range(0, len(one), ROWS):
            part = one[at:at + ROWS]
            linked = unit[part] @ other >= cosine
            if left == right:
                linked[np.arange(len(part)), np.arange(at, at + len(part))] = False
            if not linked.any():
                continue
            share = linked.astype(np.float64)
            counts[part] += share @ times[two]
            if left != right:
                counts[two] += share.T @ times[part]
            # Components within the task: the greater root joins the least that it is linked to.
            a, b = np.nonzero(linked)
            a, b = part[a], two[b]
            while True:
                a, b = parent[a], parent[b]
                differ = a != b
                if not differ.any():
                    break
                a, b = a[differ], b[differ]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                parent = _root(parent)
    out = pd.DataFrame({
        "node": nodes, "links": counts.astype(np.int64), "other": nodes[parent]})
    return out[out["links"] > 0]


def near_equal(
    rows: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    A vector that is null, zero, of another dimension than most, or has null or non-finite
    components links with nothing and is its own component. Rows of one id count once as
    links. A null id links with nothing; its component is null and it is kept. Extra columns
    are not read; an empty input gives no rows.
    """
    found, every = classes(rows, key, vector, 1)
    n = found.count()
    if n:
        pivots = pivots_of(found, n)
        described = stored(describe(found, pivots))
        sizes = described.groupBy("cell").agg(  # one row per pivot
            F.ceil(F.count(F.lit(1)) / block_size(n)).cast("int"), F.max("angle")).collect()
        placed = place(described, pivots, {r[0]: (r[1], r[2]) for r in sizes}, cosine)
        dimension = pivots.shape[1]

        def task(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            return compare(group, int(key[0]), int(key[1]), cosine, dimension)

        results = stored(placed.groupBy("left", "right").applyInPandas(
            task, "node long, links long, other long"))
    else:
        results = found.selectExpr("node", "node links", "node other")
    counts = results.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(results.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = (
        found.select("class", "node", "times").join(counts, "node", "left")
        .join(joined, "node", "left")
        .select(F.col("class").alias("of"), "times", F.coalesce("links", F.lit(0)).alias("links"),
                F.coalesce("component", "node").alias("component")))
    return every.join(named, every["class"] == named["of"], "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce(F.col("times") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
