"""A Merkle manifest of a document table by time-forward processing.

Every row is a leaf; leaves of a source, in order of their id, and every 16 consecutive nodes
above them become one node until one is left, the source's subroot; the subroots give the root.

A node is labelled by its height and its number, so that children come before their parent. The
tree is worked off in the order of labels: a node takes the digests that wait for it in a
priority queue, and puts its own digest in under its parent's label. The queue is external: what
passes from a block of 16^3 nodes to the blocks above it are rows of a table, which a shuffle
sorts by receiver; only messages within a block are in a task's heap. A reversed sweep
then goes from the root to the leaves: each node takes the part of the proof above it and hands
it on to its children together with their siblings, so that a leaf gets its whole proof without
a join of the leaves with the levels. A proof's upper part travels once per block, not per leaf.

Numbers within a source come from one range partitioning of narrow rows, so neither a source
nor the table is ever gathered in one task.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import stored

FANOUT = 16
#: Levels that one task builds from one block of nodes.
LEVELS = 3
BLOCK = FANOUT**LEVELS
#: The columns a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Path = tuple[tuple[str, str], ...]
Runs = dict[tuple[int, int], list[str]]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_above(total: int) -> int:
    """Levels from ``total`` nodes up to a single one."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FANOUT), levels + 1
    return levels


def forward(digests: list[str], levels: int) -> tuple[str, Runs]:
    """Digest of the node ``levels`` above the given ones, and the children of every node."""
    queue = [(0, number, 0, text) for number, text in enumerate(digests)]  # sorted: a heap
    runs: Runs = {}
    while True:
        height, number = label = queue[0][:2]
        inbox = []
        while queue and queue[0][:2] == label:
            inbox.append(heapq.heappop(queue)[3])
        if height:
            runs[label] = inbox
        made = digest("".join(inbox)) if height else inbox[0]
        if height == levels:
            return made, runs
        heapq.heappush(queue, (height + 1, number // FANOUT, number, made))


def backward(runs: Runs, count: int, levels: int, above: Path) -> list[Path]:
    """The proof of each of ``count`` nodes, from its siblings up to what is ``above``."""
    queue: list[tuple[int, int, Path]] = [(-levels, 0, above)]
    proofs: list[Path] = [()] * count
    while queue:
        height, number, path = heapq.heappop(queue)
        if not height:
            proofs[number] = path
            continue
        inbox = runs[-height, number]
        for place in range(len(inbox)):
            own = "".join(inbox[:place]), "".join(inbox[place + 1:])
            heapq.heappush(queue, (height + 1, number * FANOUT + place, (own, *path)))
    return proofs


def folded(leaf: str, proof: Path) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in proof:
        leaf = digest(before + leaf + after)
    return leaf


def _written(path: Path) -> str:
    return "/".join(f"{before}.{after}" for before, after in path)


def _read(path: str) -> Path:
    return tuple(tuple(step.split(".")) for step in path.split("/")) if path else ()


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``index``, the row's number from 0 within its key, and the key's ``total``."""
    ends = [F.asc_nulls_first(c) for c in (key, *order)]
    dealt = df.withColumn("_any", F.rand(1)).repartitionByRange(*ends, "_any")
    placed = stored(
        dealt.sortWithinPartitions(*ends).drop("_any")
        .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(key, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(key)
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = parts.select(
        key, "_part", (F.sum("_n").over(upto) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("total"))
    return placed.join(starts, [key, "_part"]).withColumn(
        "index", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _climb(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("index")
    total, key = int(block["total"].iloc[0]), block["key"].iloc[0]
    levels = min(LEVELS, levels_above(total))
    made, _ = forward(block["digest"].tolist(), levels)
    return pd.DataFrame({
        "key": [key], "index": [int(block["index"].iloc[0]) // BLOCK],
        "total": [-(-total // FANOUT**levels)], "digest": [made]})


def _in_block() -> Column:
    return F.expr(f"index div {BLOCK}").alias("block")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes, each the tops of the blocks of the one before; the last has one per key.

    ``nodes`` has key, index, total and digest, and is a stored table.
    """
    tables = [nodes]
    total = nodes.agg(F.max("total")).first()[0] or 0
    while total > 1:
        total = -(-total // BLOCK)
        tables.append(stored(
            tables[-1].select("key", "index", "total", "digest").groupBy("key", _in_block())
            .applyInPandas(_climb, "key string, index long, total long, digest string")))
    return tables


_MESSAGE = "key string, index long, path string, subroot string, root string"


def _meet(nodes: DataFrame, messages: DataFrame, *carried: str) -> DataFrame:
    """The nodes of each block and, before them, the message to it."""
    def empty(df: DataFrame, *names: str) -> list[Column]:
        return [F.lit(None).cast(df.schema[name].dataType).alias(name) for name in names]

    node = ["total", "digest", *carried]
    return nodes.select(
        "key", _in_block(), "index", *node, *empty(messages, "path", "subroot", "root")
    ).unionByName(messages.select(
        "key", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"),
        *empty(nodes, *node), "path", "subroot", "root"))


def _proofs(block: pd.DataFrame) -> tuple[pd.Series, pd.DataFrame, list[Path]]:
    """The message to a block, its nodes and their proofs."""
    block = block.sort_values("index")
    head, nodes = block.iloc[0], block.iloc[1:]
    levels = min(LEVELS, levels_above(int(nodes["total"].iloc[0])))
    _, runs = forward(nodes["digest"].tolist(), levels)
    return head, nodes, backward(runs, len(nodes), levels, _read(head["path"]))


def _hand_on(block: pd.DataFrame) -> pd.DataFrame:
    head, nodes, proofs = _proofs(block)
    return pd.DataFrame({
        "key": head["key"], "index": nodes["index"], "path": [_written(p) for p in proofs],
        "subroot": head["subroot"], "root": head["root"]})


def _verify(block: pd.DataFrame) -> pd.DataFrame:
    head, nodes, proofs = _proofs(block)
    altered = nodes["altered"].where(nodes["altered"].notna(), nodes["digest"])
    roots = [folded(leaf, proof) for leaf, proof in zip(altered, proofs, strict=True)]
    return pd.DataFrame({
        "doc_id": nodes["shown_id"], "leaf": nodes["digest"], "subroot": head["subroot"],
        "root": head["root"], "proof_sha256": [
            digest("".join(b + a for b, a in proof)) for proof in proofs],
        "folded_root": roots, "verified": [r == head["root"] for r in roots]})


def descended(tables: list[DataFrame], messages: DataFrame) -> DataFrame:
    """Carry messages for the tops of trees down to one message per node of the lowest table."""
    for nodes in reversed(tables[:-1]):
        messages = stored(
            _meet(nodes, messages).groupBy("key", "block").applyInPandas(_hand_on, _MESSAGE))
    return messages


def leaf_digest(text: Column) -> Column:
    """SHA-256 of a row: each value's length in bytes, a colon and the value; null is a dash."""
    def value(column: Column) -> Column:
        shown = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown),
                          F.lit("-"))

    return F.sha2(F.concat(*[value(F.col(c)) for c in FIELDS[:-1]], value(text)), 256)


def manifest(docs: DataFrame, altered: Column, when: Column) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that follows from a changed row.

    Where ``when`` holds, the row is checked with the text ``altered`` against its proof; every
    other row is checked as it is. Null ids and sources come first; rows of one id follow by
    their leaf. An empty table gives no rows; columns other than FIELDS are not read.
    """
    leaves = stored(docs.select(
        F.col("doc_id").cast("long"),
        F.col("doc_id").cast("string").alias("shown_id"),  # pandas has no nullable long
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        leaf_digest(F.col("text")).alias("digest"),
        F.when(when, leaf_digest(altered)).alias("altered")))
    tables = grown(stored(numbered(leaves, "key", ["doc_id", "digest"])))

    subroots = tables[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), "digest")
    upper = grown(stored(numbered(subroots, "key", ["source"])))
    start = upper[-1].select(
        "key", "index", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"),
        F.col("digest").alias("root"))
    tops = descended(upper, start).join(
        upper[0].select("index", "source", F.col("digest").alias("own")), "index").select(
        F.col("source").alias("key"), F.lit(0).cast("long").alias("index"), "path",
        F.col("own").alias("subroot"), "root")

    # A source of at most one block has its message already; larger ones pass it down.
    messages = descended(tables[1:], tops) if len(tables) > 1 else tops
    rows = _meet(tables[0], messages, "shown_id", "altered").groupBy("key", "block").applyInPandas(
        _verify, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def audited(docs: DataFrame) -> DataFrame:
    """The manifest, with a fifth of the rows (by checksum of the id) lower-cased before the check."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, lowered(F.col("text")), fifth)
