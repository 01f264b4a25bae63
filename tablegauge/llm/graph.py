"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import hashed, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (or its smaller) neighbours with its least neighbour.

    Only the least neighbour is aggregated, so a node with very many neighbours is combined
    before the shuffle, and the join that follows may be split.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    linked = near.join(least, "a")
    if large:
        pairs = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return pairs.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component (its least node) of all nodes of the edges."""
    edges = [np.concatenate(x) for x in zip(*(
        (batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches), strict=True)]
    nodes, at = np.unique(np.concatenate(edges), return_inverse=True)
    a, b = np.split(at, 2)
    least = np.arange(len(nodes))
    while (least[a] != least[b]).any():
        np.minimum.at(least, np.maximum(least[a], least[b]), np.minimum(least[a], least[b]))
        while (least[least] != least).any():
            least = least[least]
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes), pa.array(nodes[least])], ["node", "component"])


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """node and component (its least node) of every node that has an edge (a, b) to another.

    Up to ``at_once`` edges are connected by one task. For more, large-star and small-star by
    turns until nothing changes: a number of rounds that grows with the logarithm of the size,
    every one of them linear in the edges.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    edges = stored(edges)
    while True:
        seen = edges.agg(
            F.count(F.lit(1)), F.bit_xor(hashed(41, F.col("a"), F.col("b")))).first()
        if before is None and 0 < seen[0] <= at_once:
            return edges.coalesce(1).mapInArrow(_connected, "node long, component long")
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        edges = stored(_star(_star(edges, True), False))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
