"""Dealing documents to shards: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points of a ring. A document starts at the hash of its text, so that
equal texts start together, and belongs to the next point clockwise. A shard takes its own
documents up to its capacity; those that find it full continue clockwise to the next point
whose shard has room. Capacities are the even shares of the row count, so the counts of any
two shards differ by one at most (law ``rows``).

The walk needs only the number of documents per arc between points, a table bounded by shards
times points; documents then find their shard by their rank within the arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import CELL_ROWS, hashed, ranked, stored

RESULT = ("doc_id long, size long, text_crc32 long, law string, shard int, slot long, "
          "grown_shard int")


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes and their shards."""
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), signed=True),
         s)
        for s in range(shards) for v in range(points))
    return np.array([p for p, _ in nodes]), np.array([s for _, s in nodes])


def walk(counts: np.ndarray, owners: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """Runs of documents in ring order: (first of the run, shard, first slot there).

    Documents are numbered arc by arc. Every shard fills from its own arcs first; the rest of
    an arc, in its order, goes on clockwise.
    """
    total = int(counts.sum())
    room = np.full(shards, total // shards)
    room[: total % shards] += 1
    filled = np.zeros(shards, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    runs: list[tuple[int, int, int]] = []

    def take(start: int, n: int, shard: int) -> int:
        n = min(n, int(room[shard] - filled[shard]))
        if n:
            runs.append((start, shard, int(filled[shard])))
            filled[shard] += n
        return n

    over: list[tuple[int, int, int]] = []  # arc, start, documents
    for arc in np.flatnonzero(counts):
        got = take(int(first[arc]), int(counts[arc]), int(owners[arc]))
        if got < counts[arc]:
            over.append((int(arc), int(first[arc]) + got, int(counts[arc]) - got))
    open_arcs = [a for a in range(len(owners)) if filled[owners[a]] < room[owners[a]]]
    for arc, start, n in over:
        while n:
            open_arcs = [a for a in open_arcs if filled[owners[a]] < room[owners[a]]]
            step = next((a for a in open_arcs if a > arc), open_arcs[0])
            got = take(start, n, int(owners[step]))
            start, n = start + got, n - got
    return sorted(runs)


def deal(docs: DataFrame, shards: int = 40, points: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    A null text has no bytes and its checksum is that of the empty text. Repeated rows get
    slots of their own; an empty input gives no rows; extra columns are not read.
    """
    raw = F.col("text").cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"),
        hashed(3, F.col("text")).alias("position"),
    )
    places, owners = ring(shards, points)

    def on_arc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arc = np.searchsorted(places, batch["position"].to_numpy()) % len(places)
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch.assign(arc=arc)

    slim = stored(slim.mapInPandas(
        on_arc, "doc_id long, size long, text_crc32 long, position long, arc int"))
    counts = np.zeros(len(places), dtype=np.int64)
    for row in slim.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect():  # shards x points
        counts[row["arc"]] = row["n"]
    runs = walk(counts, owners, shards)
    starts, to, slots = (np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) if runs \
        else (np.zeros(0, dtype=np.int64),) * 3
    arc_start = np.concatenate([[0], np.cumsum(counts)])[:-1]

    # An arc is split by text, and only a text with too many copies by document as well.
    slices = docs.sparkSession.createDataFrame(
        [(a, max(1, -(-int(n) // CELL_ROWS))) for a, n in enumerate(counts)],
        "arc int, slices long")
    cells = (
        slim.join(slices, "arc")
        .withColumn("slice", F.col("arc") * F.lit(1 << 32)
                    + F.pmod(hashed(5, F.col("position")), F.col("slices")))
    )
    sizes = cells.groupBy("arc", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.expr(
        "sum(n) over (partition by arc order by slice rows between unbounded preceding and 1 preceding)"),
        F.lit(0))
    sizes = sizes.select("slice", "n", before.alias("base"))
    inside = ranked(
        cells.join(sizes, "slice"), "slice", ["position", "doc_id", "text_crc32"],
        F.ceil(F.col("n") / CELL_ROWS))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = arc_start[batch["arc"]] + batch["base"].to_numpy() + batch["rank"].to_numpy()
            run = np.searchsorted(starts, at, side="right") - 1
            out = batch[["doc_id", "size", "text_crc32"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(law="rows", shard=to[run], slot=slots[run] + at - starts[run],
                             grown_shard=pd.array([None] * len(out), dtype="Int32"))

    return inside.select("doc_id", "size", "text_crc32", "arc", "base", "rank").mapInPandas(
        assign, RESULT)
