"""Documents whose sets of word n-grams are alike: a grouped prefix join.

Equal texts are one class. A class's shingles have an order that is the same for all: rare
ones before frequent ones, then by hash. Two sets with a Jaccard similarity of t or more share
at least k shingles among the first n - ceil(t n) + k of each, for any k. Classes with the same
such prefix and the same size are one group; groups that share k prefix shingles and fit in
size are candidates.

Candidates are verified in rounds. Within a group, and among the groups that share a shingle,
each is first held against one hub. Only members of a shingle that are then still in different
components are compared with each other. So a large group of copies costs as many comparisons
as it has members, and yet no link between two components is missed.

Shingles are cut in Arrow batches, which takes a fraction of the time of nested expressions.
How many texts have a shingle is counted over all texts. A batch of texts sends all its shingles,
sorted and as bytes, to the tasks that count a part of the hashes each, and gets back those that
several texts have. The others are rarer than these, so their number alone gives the ranks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import discard, in_small_batches, stored, stored_alone
from tablegauge.llm.graph import components

#: A shingle of more texts than this is frequent; up to this many, hashes alone give the order.
FREQUENT = 2
#: Parts that hashes are counted in, at least, and bytes of texts that one part more is made for.
PARTS = 256
PART_BYTES = 16_000_000
#: Bits of a set's mark, and nodes that are sent to all tasks at most.
MARK = 1024
SENT = 1_000_000
#: Numbers of 64 bits that a mark is folded into where parts of groups meet.
FOLDED = 4
#: Shingles before its own that a part's entry names, so that a pair is made where it first meets.
BEFORE = 8
#: An odd factor that spreads the bits of a hash.
ODD = np.uint64(0x9E3779B97F4A7C15)
#: What a byte adds to the hash of its word: nothing for white space, A-Z as a-z.
VALUES = np.array(
    [0 if b == 32 or 9 <= b <= 13 else b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)],
    np.uint64)
#: Bytes of texts that a task cuts and hands on at a time, and of words that it hashes at a time.
BATCH_BYTES = 4_000_000
BLOCK_BYTES = 1_000_000
#: Texts of a batch at most, so that two bytes number them and count them.
BATCH_TEXTS = 65_535
#: Links that one task connects at once; more are connected in rounds.
AT_ONCE = 200_000
#: Rounds of comparisons with hubs before the rest is compared with each other.
HUB_ROUNDS = 3


@dataclass(frozen=True)
class Alike:
    """Words per shingle, and the similarity of a link in percent."""

    words: int
    percent: int

    def least(self, n: Column) -> Column:
        """Shingles that the prefixes must share: a fifth of those that may differ, 1 at least."""
        return F.floor((n - F.ceil(n * self.percent / 100) + 1) / 5) + 1

    def prefix(self, n: Column) -> Column:
        """Length of the prefix of a set of n."""
        return n - F.ceil(n * self.percent / 100) + self.least(n)

    def reach(self, n: np.ndarray) -> np.ndarray:
        """:meth:`prefix` of numbers; none of an empty set."""
        rest = n - -(-n * self.percent // 100)
        return np.minimum(n, rest + (rest + 1) // 5 + 1)

    def shared(self, a: Column, b: Column) -> Column:
        """Shingles that the prefixes of sets of these sizes must share.

        All common shingles but those beyond the end of the shorter-reaching prefix are in both.
        """
        beyond = F.greatest(a - self.prefix(a), b - self.prefix(b))
        return F.greatest(self.least(F.least(a, b)), self.common(a, b) - beyond)

    def common(self, a: Column, b: Column) -> Column:
        """Shingles that linked sets of these sizes have in common at least."""
        return F.ceil((a + b) * self.percent / (100 + self.percent))

    def fits(self, a: Column, b: Column) -> Column:
        """Whether sets of these sizes can be alike."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def differing(self, a: Column, b: Column) -> Column:
        """Shingles that only one of two linked sets of these sizes has, at most."""
        return F.floor((a + b) * (100 - self.percent) / (100 + self.percent))

    def near(self, x: str, y: str, a: str, b: str) -> Column:
        """Whether the marks x and y of sets of sizes a and b leave a link possible."""
        differ = F.aggregate(
            F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, k: s + k)
        return differ <= self.differing(F.col(a), F.col(b))

    def apart(self, a: Column, b: Column) -> Column:
        """Whether the bounds ``a`` and ``b`` of two parts (see :func:`_bounds`) rule out all links.

        A bit that all of one part have and none of the other differs between any two of them.
        """
        differ = F.lit(0)
        for i in range(FOLDED):
            differ += F.bit_count(
                a[f"all{i}"].bitwiseAND(F.bitwise_not(b[f"any{i}"]))
                .bitwiseOR(b[f"all{i}"].bitwiseAND(F.bitwise_not(a[f"any{i}"]))))
        return differ > self.differing(a["n"], b["n"])

    def linked(self, common: Column, a: Column, b: Column) -> Column:
        return common * 100 >= (a + b - common) * self.percent


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of every number spread over all of it; different numbers stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """Random 64-bit factors of the first n places in a word."""
    return _spread(np.arange(1, n + 1, dtype=np.uint64) * ODD)


def _words(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and where each text's words begin and end.

    ``texts`` holds the texts' ends in ``data``, from 0. A word's hash sums its bytes times the
    factors of their places, a block of ``BLOCK_BYTES`` at a time (more if one word is longer).
    """
    begins = VALUES[data] > 0
    after = begins[:-1].copy()
    after[texts[(texts > 0) & (texts < len(data))] - 1] = False  # a text ends there
    begins[1:] &= ~after
    starts = np.flatnonzero(begins)
    ends = np.searchsorted(starts, texts)
    found = np.empty(len(starts), np.uint64)
    factors = _factors(256)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK_BYTES)))
        stop = starts[j] if j < len(starts) else len(data)
        own = starts[i:j] - starts[i]
        place = np.arange(stop - starts[i])
        place -= np.repeat(own, np.diff(np.append(own, len(place))))
        far = int(place.max()) + 1
        if far > len(factors):
            factors = _factors(far)
        found[i:j] = np.add.reduceat(VALUES[data[starts[i]:stop]] * factors[place], own)
        i = j
    return _spread(found), ends


def _windows(found: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    many = max(0, len(found) - n + 1)
    mixed = np.full(many, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ found[k:k + many]) * ODD
        mixed ^= mixed >> np.uint64(32)
    mixed *= ODD
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers in order; sorting takes a tenth of the time of ``np.unique``."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _mark(found: np.ndarray) -> np.ndarray:
    """Which of ``MARK`` bits an odd number of these hashes have as their last ones."""
    bits = np.bincount(found & (MARK - 1), minlength=MARK) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _cut(texts: list[bytes], n: int) -> tuple[list[bytes | None], list[np.ndarray]]:
    """Key and set of every text; the n-gram of a text with fewer words is all of them."""
    found, ends = _words(
        np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    grams = _windows(found, n)
    keys, sets = [], []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        keys.append(hashlib.md5(found[a:b].tobytes()).digest() if b > a else None)
        sets.append(_distinct(grams[a:b - n + 1]) if b - a >= n else
                    _windows(found[a:b], b - a) if b > a else np.empty(0, np.int64))
    return keys, sets


def _cut_batches(
    batches: Iterator[pa.RecordBatch], n: int,
) -> Iterator[tuple[pa.Array, list[bytes | None], list[np.ndarray]]]:
    """Ids, keys and sets of Arrow batches of ids and texts, ``BATCH_BYTES`` of texts at a time."""
    pa.default_memory_pool().release_unused()  # what the worker's earlier tasks left
    for batch in batches:
        texts, at, held = [], 0, 0
        for row, text in enumerate(batch.column(1), 1):
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= BATCH_BYTES or row == batch.num_rows or len(texts) == BATCH_TEXTS:
                keys, sets = _cut(texts, n)
                yield batch.column(0).slice(at, len(keys)), keys, sets
                texts, at, held = [], row, 0


def _ids_and_texts(rows: DataFrame, node: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select(F.col(node).cast("long").alias("node"), text.alias("text"))


def shingled(rows: DataFrame, node: str, words: int) -> DataFrame:
    """node and set of every row's whole text: the hashes of its distinct n-grams.

    Words are split at white space of ASCII, A-Z in lower case. A task holds one Arrow batch, and
    works on ``BATCH_BYTES`` of its texts at a time, or on one text that is longer.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, _, sets in _cut_batches(batches, words):
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [nodes, pa.ListArray.from_arrays(ends, np.concatenate(sets))], ["node", "set"])

    return _ids_and_texts(rows, node).mapInArrow(cut, "node long, set array<long>")


def _blobs(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of ``x`` between ``ends``, as bytes."""
    x = np.ascontiguousarray(x)
    ends = (np.asarray(ends) * x.itemsize * math.prod(x.shape[1:])).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _unblobbed(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_blobs` packed, end to end, and where each slice ends, from 0."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind), np.cumsum(
        [0, *map(len, blobs)]) // np.dtype(kind).itemsize


def _split(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two bytes of hashes, which hardly change in their order, and the other six."""
    return (tokens >> 48).astype(np.int16), tokens.view(np.uint8).reshape(-1, 8)[:, :6]


def _rejoined(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The hashes that :func:`_split` split."""
    both = np.concatenate([tails.reshape(-1, 6), heads.view(np.uint8).reshape(-1, 2)], axis=1)
    return both.view(np.int64)[:, 0]


def _sent(sets: list[np.ndarray], parts: int) -> tuple[np.ndarray, list[pa.Array]]:
    """The part of all hashes that each row is for; its shingles, how many texts have each, which."""
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    texts = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[:len(tokens)])
    tokens, all_starts = tokens[starts], np.append(starts, len(texts))
    part = (tokens >> 32) * parts >> 32
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)])
    ends = np.append(cuts, len(tokens))
    return part[cuts], [
        *[_blobs(x, ends) for x in _split(tokens)],
        _blobs(np.diff(all_starts).astype(np.uint16), ends), _blobs(texts, all_starts[ends])]


#: Rows to the tasks that count, and back.
SENT_ROWS = ("part int, batch long, heads binary, tails binary, counts binary, texts binary, "
             "rows binary")
COUNTED = ("batch long, heads binary, tails binary, times binary, counts binary, texts binary, "
           "rows binary")


def frequent(docs: DataFrame, alike: Alike) -> DataFrame:
    """Per batch of texts: its texts, and their shingles that several of all texts have.

    A row has shingles, how many of all texts have them (``times``), how many of the batch do
    (``counts``) and which these are (``texts``), or ids, keys, sizes and marks of the batch's
    texts (``rows``). Rows of a part of the hashes are counted together, by one task; a shingle
    that very many texts have takes two bytes there for each.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(PARTS, -(-size // PART_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The same numbers if the task runs again.
        number = TaskContext.get().partitionId() << 32
        for nodes, keys, sets in _cut_batches(batches, alike.words):
            marks = np.concatenate([_mark(s) for s in sets])
            places = np.arange(0, len(marks) + 1, MARK // 64, dtype=np.int32)
            rows = pa.RecordBatch.from_arrays(
                [nodes, pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                 pa.ListArray.from_arrays(places, marks)], ["doc_id", "key", "n", "mark"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_batch(rows)
            part, blobs = _sent(sets, parts)
            none = pa.nulls(len(part), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(part, (number + (number >> 32)) % parts - parts // 2), pa.int32()),
                 pa.array(np.full(len(part) + 1, number)),
                 *[pa.concat_arrays([x, pa.nulls(1, pa.binary())]) for x in blobs],
                 pa.concat_arrays([none, pa.array([sink.getvalue().to_pybytes()], pa.binary())])],
                ["part", "batch", "heads", "tails", "counts", "texts", "rows"])
            number += 1

    def count(sent: pa.Table) -> pa.Table:
        texts = sent.filter(pa.compute.is_valid(sent["rows"]))
        sent = sent.filter(pa.compute.is_null(sent["rows"]))
        out = [pa.table({"batch": texts["batch"], **{
            c: pa.nulls(len(texts), pa.binary()) for c in ("heads", "tails", "times", "counts", "texts")},
            "rows": texts["rows"]})]
        if len(sent):
            heads, ends = _unblobbed(sent["heads"], np.int16)
            tokens = _rejoined(heads, _unblobbed(sent["tails"], np.uint8)[0])
            counts, _ = _unblobbed(sent["counts"], np.uint16)
            which, _ = _unblobbed(sent["texts"], np.uint16)
            order = np.argsort(tokens, kind="stable")
            ordered = tokens[order]
            starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            sums = np.add.reduceat(counts[order].astype(np.int64), starts)
            times = np.empty(len(tokens), np.uint32)
            times[order] = np.repeat(
                np.minimum(sums, 2**32 - 1), np.diff(np.append(starts, len(tokens))))
            several = times > 1
            kept = np.append(0, np.cumsum(several))[ends]
            named = np.append(0, np.cumsum(np.where(several, counts, 0)))[ends]
            heads, tails = _split(tokens[several])
            out.append(pa.table({
                "batch": sent["batch"], "heads": _blobs(heads, kept), "tails": _blobs(tails, kept),
                "times": _blobs(times[several], kept), "counts": _blobs(counts[several], kept),
                "texts": _blobs(which[np.repeat(several, counts)], named),
                "rows": pa.nulls(len(sent), pa.binary())}))
        return pa.concat_tables(out)

    return _ids_and_texts(docs, "doc_id").mapInArrow(cut, SENT_ROWS).groupBy("part").applyInArrow(
        count, COUNTED)


def cut_texts(docs: DataFrame, alike: Alike) -> DataFrame:
    """doc_id, key, n, mark, first and prefix of every row.

    The key is equal for equal sequences of words, and null without words or text; n is the
    number of distinct n-grams. Bit i of the mark tells whether an odd number of their hashes end
    in i, so two sets differ in as many n-grams at least as their marks in bits. The order of all
    begins with the shingles that one text has; the prefix holds what follows them in the
    prefix, from place ``first`` on.
    """
    def order(found: pa.Table) -> pa.Table:
        rows = found["rows"].drop_null()[0].as_py()
        rows = pa.ipc.open_stream(rows).read_all()
        found = found.filter(pa.compute.is_valid(found["heads"]))
        heads, tails, times, counts, texts = (_unblobbed(found[c], kind)[0] for c, kind in (
            ("heads", np.int16), ("tails", np.uint8), ("times", np.uint32), ("counts", np.uint16),
            ("texts", np.uint16)))
        tokens = _rejoined(heads, tails)
        tokens, often = np.repeat(tokens, counts), np.repeat(np.maximum(times, FREQUENT), counts)
        places = np.lexsort((tokens, often, texts))
        tokens, texts = tokens[places], texts[places]
        n = rows["n"].to_numpy().astype(np.int64)
        many = np.bincount(texts, minlength=len(n))
        first = n - many
        rank = np.arange(len(tokens)) - np.repeat(np.cumsum(many) - many - first, many)
        kept = rank < alike.reach(n)[texts]
        ends = np.append(0, np.cumsum(np.bincount(texts[kept], minlength=len(n))))
        return rows.append_column("first", pa.array(first, pa.int32())).append_column(
            "prefix", pa.ListArray.from_arrays(ends.astype(np.int32), tokens[kept]))

    return frequent(docs, alike).groupBy("batch").applyInArrow(
        order, "doc_id long, key binary, n int, mark array<long>, first int, prefix array<long>")


def classes(cut: DataFrame, *more: str) -> DataFrame:
    """One row per different text: key, node (least doc_id), n and more columns of ``cut``."""
    return (
        cut.filter("key is not null").groupBy("key").agg(
            F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ["n", *more]]))


def _texts(docs: DataFrame, nodes: DataFrame, alike: Alike) -> DataFrame:
    """node and set of the texts of these nodes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    if nodes.count() <= SENT:  # else the texts move
        nodes = F.broadcast(nodes)
    return shingled(rows.join(nodes, "node", "left_semi"), "node", alike.words)


def _prefixes(cut: DataFrame) -> DataFrame:
    """node, n, token, rank (place in the order of all) of prefix shingles that several share."""
    entries = classes(cut, "first", "prefix").filter("node is not null").select(
        "node", "n", "first", F.posexplode("prefix").alias("rank", "token")).select(
        "node", "n", "token", (F.col("first") + F.col("rank")).alias("rank"))
    # Counted where they meet: a second look-up would move all of them again.
    times = F.count(F.lit(1)).over(Window.partitionBy("token"))
    return stored(entries.withColumn("times", times).filter("times > 1").drop("times"))


def _bounds(parts: DataFrame, marks: DataFrame) -> DataFrame:
    """head, component and bounds (a struct) of the parts of groups, from their members.

    Words of a mark are folded by exclusive or: a bit then stands for several residues, and two
    sets still differ in as many shingles as in bits. ``all`` are the bits of every member,
    ``any`` those of some; of one member, both are its folded mark.
    """
    words = MARK // 64
    folded = [F.expr(" ^ ".join(f"mark[{k}]" for k in range(i, words, FOLDED))) for i in range(FOLDED)]
    members = parts.join(marks.select("node", "mark"), "node").select(
        "head", "component", "n", *[folded[i].alias(f"fold{i}") for i in range(FOLDED)])
    found = members.groupBy("head", "component").agg(
        F.first("n").alias("n"),
        *[F.bit_and(f"fold{i}").alias(f"all{i}") for i in range(FOLDED)],
        *[F.bit_or(f"fold{i}").alias(f"any{i}") for i in range(FOLDED)])
    return found.select("head", "component", F.struct(
        *[c for c in found.columns if c not in ("head", "component")]).alias("bounds"))


def _met(entries: DataFrame) -> DataFrame:
    """The entries of parts with ``before``: the shingles next before each among the part's own.

    Two parts meet at every shingle they share, a fifth of their prefixes or more if they may be
    linked. Where both name the same earlier one, they have met there, so the pair is known. At
    their first common shingle they cannot, so no pair is lost.
    """
    order = Window.partitionBy("head", "component").orderBy(F.desc("from")).rowsBetween(-BEFORE, -1)
    return entries.withColumn("before", F.collect_list("token").over(order))


def _near(pairs: DataFrame, marks: DataFrame, alike: Alike) -> DataFrame:
    """The pairs (a, b) whose marks, which are much shorter than sets, do not rule out a link."""
    a = marks.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("mark").alias("x"))
    b = marks.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("mark").alias("y"))
    return pairs.join(a, "a").join(b, "b").filter(alike.near("x", "y", "n1", "n2")).select(
        "a", "b").distinct()


def _verified(pairs: DataFrame, marks: DataFrame, sets: DataFrame, alike: Alike) -> DataFrame:
    """The pairs (a, b) that are links; only the sets of near ones move."""
    pairs = stored(_near(pairs, marks, alike))
    named = pairs.select(F.col("a").alias("node")).unionByName(
        pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets.join(named, "node", "left_semi")
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return stored(
        pairs.join(a, "a").join(b, "b")
        .filter(alike.linked(common, F.size("x"), F.size("y"))).select("a", "b"))


def _with_component(rows: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links, AT_ONCE)
    return rows.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))


def links(docs: DataFrame, cut: DataFrame, alike: Alike) -> DataFrame:
    """Links (a, b) between classes: enough to connect all that any links connect."""
    rows = _prefixes(cut)
    grouped = rows.groupBy("node").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_set("token")).alias("prefix"),
    ).filter(F.size("prefix") >= alike.least(F.col("n")))
    rows = rows.join(grouped.select("node"), "node", "left_semi")
    members = grouped.select("node", "n", F.xxhash64("n", "prefix").alias("group"))
    heads = members.groupBy("group").agg(F.min("node").alias("head"))
    members = stored(members.join(heads, "group").select("node", "n", "head"))
    tokens = rows.join(members.filter("node = head").select("node"), "node")
    several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    tokens = stored(tokens.join(several.select("token"), "token", "left_semi"))

    in_groups = members.filter("node <> head").select(
        F.col("node").alias("a"), F.col("head").alias("b"))
    sets = stored(_texts(docs, members.select("node").distinct(), alike))
    marks = stored(classes(cut, "mark").join(members.select("node"), "node", "left_semi").select(
        "node", "n", "mark"))
    known = _verified(in_groups.distinct(), marks, sets, alike)
    checked = None
    for _ in range(HUB_ROUNDS):
        seen = _with_component(tokens, known)
        # A shingle's hub is its largest component, the least of equal ones; components meet
        # through the members that have the shingle foremost, so the fewest shingles of their
        # own: the texts copied from, or the nearest to them.
        leads = seen.groupBy("token", "component").agg(
            F.min(F.struct("rank", "node", "n")).alias("lead"), F.count(F.lit(1)).alias("k"))
        hub = leads.groupBy("token").agg(
            F.max_by(F.struct("component", "lead"), F.struct("k", -F.col("component"))).alias("hub"),
            F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        pairs = (
            leads.join(hub, "token").filter("component <> hub.component")
            .filter(alike.fits(F.col("lead.n"), F.col("hub.lead.n")))
            .groupBy(F.greatest("lead.node", "hub.lead.node").alias("a"),
                     F.least("lead.node", "hub.lead.node").alias("b"))
            .agg(F.count(F.lit(1)).alias("k"), F.max(F.least("lead.n", "hub.lead.n")).alias("n"))
            .filter(F.col("k") >= F.least(F.lit(2), alike.least(F.col("n")))).select("a", "b"))
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        if pairs.isEmpty():
            break
        more = _verified(pairs, marks, sets, alike)
        checked = pairs if checked is None else checked.unionByName(pairs)
        if more.isEmpty():
            break
        known = known.unionByName(more)

    # What is left: members of a shingle in different components, all but its largest one
    # against every other.
    joined = stored(_with_component(members, known))
    placed = stored(tokens.join(joined.select("node", "head", "component"), "node"))
    # A group whose members are in several components takes part with each of them.
    parts = joined.groupBy("head", "component").agg(F.first("n").alias("n"))
    spread = stored(
        placed.select("token", F.col("node").alias("head")).join(parts, "head"))
    discard(placed)
    sizes = spread.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"),
        F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    # The first shingle that two linked sets share has all their common ones at its place or
    # behind it, in both. Members of a group may differ in place; the foremost counts.
    ranks = rows.join(members.select("node", "head"), "node").groupBy("head", "token").agg(
        F.min("rank").alias("rank"))
    seen = stored(
        spread.join(main.select("token", "main"), "token").join(ranks, ["head", "token"])
        .withColumn("from", F.col("n") - F.col("rank")).drop("rank")
        .filter(F.col("from") >= F.ceil(F.col("n") * alike.percent / 100)))
    discard(spread)
    # Parts meet with their bounds, so that only those that may hold a link become pairs.
    bounded = stored(_met(seen.join(_bounds(joined, marks), ["head", "component"])))
    discard(seen)
    one = bounded.filter("component <> main").select(
        "token", F.col("head").alias("head1"), F.col("component").alias("c1"), F.col("n").alias("n1"),
        F.col("from").alias("from1"), F.col("bounds").alias("bounds1"), F.col("before").alias("before1"))
    two = bounded.select(
        "token", "main", F.col("head").alias("head2"), F.col("component").alias("c2"),
        F.col("n").alias("n2"), F.col("from").alias("from2"), F.col("bounds").alias("bounds2"),
        F.col("before").alias("before2"))
    heads = (
        one.join(two, "token")
        .filter((F.col("c1") < F.col("c2"))
                | ((F.col("c2") == F.col("main")) & (F.col("c1") != F.col("c2"))))
        .filter(F.least("from1", "from2") >= alike.common(F.col("n1"), F.col("n2")))
        .filter(~alike.apart(F.col("bounds1"), F.col("bounds2")))
        .filter(~F.arrays_overlap("before1", "before2")))
    # Which of two is the first may differ by shingle.
    turned = F.col("c1") > F.col("c2")
    heads = (
        heads.select(
            F.when(turned, F.col("head2")).otherwise(F.col("head1")).alias("head1"),
            F.least("c1", "c2").alias("c1"),
            F.when(turned, F.col("head1")).otherwise(F.col("head2")).alias("head2"),
            F.greatest("c1", "c2").alias("c2"),
            F.least("n1", "n2").alias("n1"), F.greatest("n1", "n2").alias("n2")).distinct())
    prefixes = tokens.groupBy("node").agg(F.collect_set("token").alias("prefix"))
    heads = (
        heads.join(prefixes.select(F.col("node").alias("head1"), F.col("prefix").alias("p1")), "head1")
        .join(prefixes.select(F.col("node").alias("head2"), F.col("prefix").alias("p2")), "head2")
        .filter(F.size(F.array_intersect("p1", "p2")) >= alike.shared(F.col("n1"), F.col("n2")))
        .select("head1", "c1", "head2", "c2"))
    # Members meet with their marks, so that only near ones of two large groups become pairs.
    marked = joined.join(marks.select("node", "mark"), "node")
    first = marked.select(
        F.col("node").alias("x"), F.col("head").alias("head1"), F.col("component").alias("c1"),
        F.col("n").alias("m1"), F.col("mark").alias("mark1"))
    second = marked.select(
        F.col("node").alias("y"), F.col("head").alias("head2"), F.col("component").alias("c2"),
        F.col("n").alias("m2"), F.col("mark").alias("mark2"))
    pairs = stored(
        heads.join(first, ["head1", "c1"]).join(second, ["head2", "c2"])
        .filter(alike.near("mark1", "mark2", "m1", "m2"))
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if checked is not None:
        pairs = pairs.join(checked, ["a", "b"], "left_anti")
    return known.unionByName(_verified(pairs, marks, sets, alike))


def join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    A text without words, or none, has no shingles and links with nothing; its component is
    itself. Rows alike in text are one class; rows of one doc_id with several texts pool their
    links. A null doc_id links through its text and never names a component. Extra columns are
    not read; an empty input gives no rows. Shingles are 64-bit hashes. The session's Arrow
    batches are bounded.
    """
    in_small_batches(docs.sparkSession)
    return stored_alone(lambda: _joined(docs, Alike(words, percent)))


def _joined(docs: DataFrame, alike: Alike) -> DataFrame:
    """The result of :func:`join`, from tables that are no longer needed once it is stored."""
    cut = stored(cut_texts(docs, alike))
    linked = components(links(docs, cut, alike), AT_ONCE)
    named = classes(cut).join(linked, "node", "left").select(
        F.col("key").alias("class"), "n", F.coalesce("component", "node").alias("component"))
    return cut.join(named, cut["key"] == named["class"], "left").select(
        "doc_id", F.coalesce(named["n"], F.lit(0)).cast("long").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each component of near copies, all columns kept.

    The least doc_id stays: once if its row is repeated, with each of its texts if they differ.
    Rows with a null doc_id all stay.
    """
    found = join(docs, words, percent)
    stay = (
        found.filter("doc_id is not null and doc_id = component_id")
        .groupBy(F.col("doc_id").alias("__stay")).agg(F.count(F.lit(1)).alias("__rows")))
    kept = docs.join(stay, docs["doc_id"] == stay["__stay"])
    once = kept.filter(F.col("__rows") == 1).select(*docs.columns)
    repeated = kept.filter(F.col("__rows") > 1).dropDuplicates(["__stay", "text"]).select(*docs.columns)
    nameless = docs.filter("doc_id is null")
    return once.unionByName(repeated).unionByName(nameless)
