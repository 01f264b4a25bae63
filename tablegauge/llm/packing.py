"""Packing documents into token sequences of a fixed length.

Method: exact-complement hashing. Only the number of pieces of each length decides how
sequences are filled, and there are at most as many lengths as a sequence has tokens; so the
plan is made on the driver from that bounded table, and the pieces are placed by their rank
among the pieces of their length. Lengths that fill a gap exactly, alone, in pairs or in
threes, are looked up by their sum and used as often as all their counts allow; what remains
is placed best-fit, longest first.

Texts are tokenized once. ``place`` gives the places, ``sequences`` the packed tokens.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import CELL_ROWS, ranked, stored

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: White space on which the fast library's pattern would run out of stack.
LONG_SPACE = re.compile(r"\s{10000}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids as the tokenizers library gives them for ``<vocabulary>.json``.

    The same vocabulary as ranks is several times faster and gives the same ids; a text that
    holds the special token's string or a very long run of white space goes through the slower
    library.
    """

    def __init__(self, vocabulary: str, end_id: int):
        import base64

        import public_tokenizers
        import tiktoken

        self.slow_file = public_tokenizers.path(f"{vocabulary}.json")
        self.slow = None
        self.end = [end_id]
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if text and (SPECIAL in text or LONG_SPACE.search(text)):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.slow_file)
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text or "")
        return np.array(ids + self.end, dtype="<u4")


def cuts(total: int, length: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be shorter."""
    first = total % length or length
    return [(0, min(first, total))] + [(s, length) for s in range(first, total, length)]


def pieces(
    docs: DataFrame, length: int, end_id: int, vocabulary: str = VOCABULARY, ids: bool = False
) -> DataFrame:
    """One row per piece: document, number, start, length and checksum, on demand the ids.

    A null text is an empty one, which is the end token alone. Repeated rows are packed as
    often as they occur; a null doc_id is kept.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocabulary, end_id)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = encode(text)
                for number, (start, size) in enumerate(cuts(len(tokens), length)):
                    part = tokens[start:start + size]
                    row = (doc_id, number, start, size, zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype("i4")) if ids else row)
            out = pd.DataFrame(rows, columns=[*names])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = PIECES + (", ids array<int>" if ids else "")
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, schema)


def exact_combinations(
    left: np.ndarray, longest: int, gap: int, number: int
) -> Iterator[tuple[int, ...]]:
    """Lengths at hand, ``number`` of them, that sum to the gap, the most even ones first.

    Counts go down while the caller uses what it gets; every combination is checked anew.
    """
    if number == 1:
        if 0 < gap <= longest and left[gap]:
            yield (gap,)
    elif number == 2:
        for b in range((gap + 1) // 2, min(gap - 1, longest) + 1):
            if left[b] and left[gap - b]:
                yield (b, gap - b)
    else:
        for b in range((gap + 2) // 3, min(gap - 2, longest) + 1):
            if left[b]:
                rest = gap - b
                second = np.arange((rest + 1) // 2, min(b, rest - 1) + 1)
                for c in second[(left[second] > 0) & (left[rest - second] > 0)]:
                    yield (b, int(c), int(rest - c))


def fill(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences that follow it.

    With few pieces the exact step can use up the short ones that the long ones would need; so
    it is tried down to several lengths, and the plan with the fewest sequences stays.
    """
    plans = (_fill(counts, length, length * eighths // 8) for eighths in (0, 4, 5, 6, 7))
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _fill(counts: dict[int, int], length: int, down_to: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(length + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] += n
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = min(int(left[size]) // n for size, n in need.items())
        if times:
            for size, n in need.items():
                left[size] -= times * n
            plan.append((pattern, times))

    if left[length]:
        use((length,))
    for number in (1, 2, 3):
        for size in range(length - 1, down_to - 1, -1):
            if left[size]:
                for others in exact_combinations(left, size, length - size, number):
                    use((size, *others))
                    if not left[size]:
                        break
    # Best fit, longest first: sequences alike in what they hold are one entry.
    gaps: dict[int, dict[tuple[int, ...], int]] = {}
    for size in range(length - 1, 0, -1):
        while left[size]:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:
                each = min(length // size, int(left[size]))
                pattern, times = (size,) * each, int(left[size]) // each
                left[size] -= times * each
                rest = length - size * each
            else:
                held, n = next(iter(gaps[gap].items()))
                each = min(gap // size, int(left[size]))
                times = min(n, int(left[size]) // each)
                gaps[gap][held] -= times
                if not gaps[gap][held]:
                    del gaps[gap][held]
                if not gaps[gap]:
                    del gaps[gap]
                pattern = held + (size,) * each
                left[size] -= times * each
                rest = gap - size * each
            if rest:
                at = gaps.setdefault(rest, {})
                at[pattern] = at.get(pattern, 0) + times
            else:
                plan.append((pattern, times))
    plan += [item for groups in gaps.values() for item in groups.items()]
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length the runs of ranks that go to consecutive sequences at one offset."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for size in pattern:
            rows.append((size, used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(
        ["length", "first"], ignore_index=True)


def place(
    docs: DataFrame, length: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Where each piece of each document goes: sequence_id and offset, no gaps, few sequences.

    Empty input gives no rows. Extra columns of ``docs`` are not read.
    """
    cut = stored(pieces(docs, length, end_id, vocabulary))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # at most one row per possible length
    runs = slots(fill(counts, length))
    by_length = {size: part for size, part in runs.groupby("length")}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence = np.zeros(len(batch), dtype=np.int64)
            offset = np.zeros(len(batch), dtype=np.int64)
            for size, rows in batch.reset_index(drop=True).groupby("length"):
                part, rank = by_length[size], rows["rank"].to_numpy()
                run = np.searchsorted(part["first"].to_numpy(), rank, side="right") - 1
                at = rows.index.to_numpy()
                sequence[at] = part["sequence"].to_numpy()[run] + rank - part["first"].to_numpy()[run]
                offset[at] = part["offset"].to_numpy()[run]
            out = batch.drop(columns="rank")
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(sequence_id=sequence, offset=offset)

    per_length = [-(-counts.get(size, 1) // CELL_ROWS) for size in range(length + 1)]
    cells = F.get(F.lit(per_length), F.col("length").cast("int"))
    return ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], cells).mapInPandas(
        assign, f"{PIECES}, sequence_id long, offset long")


def sequences(
    docs: DataFrame, length: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY
) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids and ids, at most ``length`` tokens."""
    tokens = pieces(docs, length, end_id, vocabulary, ids=True).withColumnRenamed("ids", "_ids")
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    places = place(docs, length, end_id, vocabulary).groupBy(same).agg(
        F.collect_list(F.struct("sequence_id", "offset")).alias("_at"))
    parts = (
        tokens.dropDuplicates(same)
        .join(places, [tokens[c].eqNullSafe(places[c]) for c in same])
        .select(tokens["doc_id"], "_ids", F.explode("_at").alias("_at"))
    )
    return (
        parts.groupBy(F.col("_at.sequence_id").alias("sequence_id"))
        .agg(F.array_sort(F.collect_list(F.struct("_at.offset", "doc_id", "_ids"))).alias("p"))
        .select("sequence_id", F.col("p.doc_id").alias("doc_ids"),
                F.flatten(F.col("p._ids")).alias("ids"))
    )
