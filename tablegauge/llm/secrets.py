"""Secrets in texts: fixed rules, and formats learnt from what they find.

Method: grammar inference. The strings that the rules find are labelled credentials. Per kind a
bounded sample of them becomes a prefix tree; states whose continuations are statistically
alike are merged until a small probabilistic automaton is left. Every other long run of
credential characters of the corpus is then scored by its likelihood under each automaton and
under one learnt from the runs of ordinary text, which repeat where credentials do not; likely ones are spans of kind ``format``.

The corpus is read once: rules and candidates of a text are found together and stored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import hashed, stored

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: The shortest value of an assignment, and the shortest run that is scored.
VALUE = 12
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{VALUE},}}")
#: Strings per kind that an automaton is learnt from, as many again to set its threshold.
SAMPLE = 400
#: An ordinary run counts once for each text that it is in, up to so many times.
WEIGHT = 10
#: Error level of the test that two states are alike.
ALPHA = 0.05
#: A run must be as likely as all but this share of the credentials, and clearly more likely
#: per character than as ordinary text.
REJECTED = 0.01
MARGIN = 0.5

SPAN = "struct<kind:string,start:int,end:int,text:string>"
FOUND = f"doc_id long, spans array<{SPAN}>, runs array<{SPAN}>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed rules, by start and kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def runs(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Long runs of credential characters that no rule has found, without full stops around.

    What a rule has found cuts a run; the parts beside it count if they are long enough.
    """
    found = []
    for m in RUN.finditer(text):
        at, end = m.span()
        for a, b in [*sorted((a, b) for _, a, b in spans if a < end and at < b), (end, end)]:
            if a - at >= VALUE:
                part = text[at:a]
                start = at + len(part) - len(part.lstrip("."))
                stop = at + len(part.rstrip("."))
                if stop - start >= VALUE:
                    found.append((start, stop))
            at = max(at, b)
    return found


# ---- automata ------------------------------------------------------------------------------

def symbols(value: str) -> list[str]:
    """The first characters as they are, since formats mark themselves there; then classes."""
    out = list(value[:4])
    for c in value[4:]:
        if c.isdigit():
            out.append("digit")
        elif "a" <= c <= "f":
            out.append("low hex")
        elif c.islower():
            out.append("low")
        elif "A" <= c <= "F":
            out.append("high hex")
        elif c.isupper():
            out.append("high")
        else:
            out.append(c)
    return out


@dataclass
class State:
    seen: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    times: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton learnt by merging the states of a prefix tree."""

    def __init__(self, values: list[str]):
        self.states = [State()]
        for value in values:
            at = 0
            for s in symbols(value):
                self.states[at].seen += 1
                self.states[at].times[s] = self.states[at].times.get(s, 0) + 1
                if s not in self.states[at].next:
                    self.states[at].next[s] = len(self.states)
                    self.states.append(State())
                at = self.states[at].next[s]
            self.states[at].seen += 1
            self.states[at].ends += 1
        self.alphabet = len({s for state in self.states for s in state.times}) + 1
        self._merge_all()

    def _differ(self, k1: int, n1: int, k2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (n1 ** -0.5 + n2 ** -0.5)
        return abs(k1 / n1 - k2 / n2) > bound

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states, and the states that follow both, may be one."""
        todo = [(a, b)]
        while todo:
            x, y = (self.states[i] for i in todo.pop())
            if self._differ(x.ends, x.seen, y.ends, y.seen):
                return False
            for s in x.times.keys() | y.times.keys():
                if self._differ(x.times.get(s, 0), x.seen, y.times.get(s, 0), y.seen):
                    return False
                if s in x.next and s in y.next:
                    todo.append((x.next[s], y.next[s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree at b to the automaton at a."""
        todo = [(a, b)]
        while todo:
            i, j = todo.pop()
            x, y = self.states[i], self.states[j]
            x.seen += y.seen
            x.ends += y.ends
            for s, n in y.times.items():
                x.times[s] = x.times.get(s, 0) + n
                if s in x.next:
                    todo.append((x.next[s], y.next[s]))
                else:
                    x.next[s] = y.next[s]

    def _merge_all(self) -> None:
        kept = [0]
        while True:
            # States one step from the kept ones, the most seen first.
            border = sorted(
                {(-self.states[t].seen, t, i, s) for i in kept
                 for s, t in self.states[i].next.items() if t not in kept})
            if not border:
                break
            _, state, parent, symbol = border[0]
            for other in kept:
                if self._alike(other, state):
                    self.states[parent].next[symbol] = other
                    self._fold(other, state)
                    break
            else:
                kept.append(state)
        place = {old: new for new, old in enumerate(kept)}
        self.states = [self.states[i] for i in kept]
        for state in self.states:
            state.next = {s: place[t] for s, t in state.next.items()}

    def score(self, value: str) -> float:
        """Log-likelihood per character; what was never seen gets a small share."""
        at, total, spread = 0, 0.0, 0.01
        values = symbols(value)
        for s in values:
            state = self.states[at]
            total += math.log(
                (state.times.get(s, 0) + spread) / (state.seen + spread * self.alphabet))
            at = state.next.get(s, at)
        return total / max(1, len(values))


@dataclass
class Formats:
    """Automata by kind with their thresholds, and the one of ordinary runs."""

    kinds: dict[str, tuple[Automaton, float]]
    ordinary: Automaton | None

    def likely(self, value: str) -> bool:
        scores = [s for a, least in self.kinds.values() if (s := a.score(value)) >= least]
        if not scores:
            return False
        return self.ordinary is None or max(scores) >= self.ordinary.score(value) + MARGIN


def learn(credentials: dict[str, list[str]], ordinary: list[str]) -> Formats:
    """Automata from half of each list, thresholds from the other half."""
    kinds = {}
    for kind, values in credentials.items():
        half = (len(values) + 1) // 2
        if half < 8:  # too few to tell a format
            continue
        automaton = Automaton(values[:half])
        scores = sorted(automaton.score(v) for v in values[half:])
        kinds[kind] = (automaton, scores[int(REJECTED * len(scores))] - 1e-9)
    return Formats(kinds, Automaton(ordinary) if len(ordinary) >= 8 else None)


# ---- on the corpus -------------------------------------------------------------------------

def _find(docs: DataFrame) -> DataFrame:
    """Spans of the rules and candidate runs of every text, with their strings."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans, others = [], []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                spans.append([
                    {"kind": k, "start": a, "end": b,
                     "text": ASSIGN.match(text[a:b])[2] if k == "assign" else text[a:b]}
                    for k, a, b in base])
                others.append([
                    {"kind": "format", "start": a, "end": b, "text": text[a:b]}
                    for a, b in runs(text, base)])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "spans": spans, "runs": others})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(find, FOUND)


def _sample(found: DataFrame, column: str, kind: str) -> list[str]:
    """At most two samples of distinct strings, always the same ones of a corpus."""
    rows = (
        found.select(F.explode(column).alias("s")).filter(F.col("s.kind") == kind)
        .select("s.text").distinct()
        .orderBy(hashed(23, F.col("text")), "text").limit(2 * SAMPLE).collect())
    return [r["text"] for r in rows]


def _ordinary(found: DataFrame) -> list[str]:
    """The candidate runs of most texts, each as often as its texts, up to a weight.

    Words repeat and credentials hardly do, so runs of a single text are left out unless
    too few others are there to learn from.
    """
    rows = (
        found.select(F.explode(F.array_distinct(F.transform("runs", lambda r: r["text"])))
                     .alias("text"))
        .groupBy("text").agg(F.count(F.lit(1)).alias("texts"))
        .orderBy(F.desc("texts"), hashed(23, F.col("text")), "text").limit(SAMPLE).collect())
    often = [r for r in rows if r["texts"] > 1]
    return [r["text"] for r in (often if len(often) >= 8 else rows)
            for _ in range(min(WEIGHT, r["texts"]))]


def learnt(found: DataFrame) -> Formats:
    """Automata from bounded samples of what the rules found, and of the other runs."""
    credentials = {kind: _sample(found, "spans", kind) for kind in KINDS[:3]}
    return learn(credentials, _ordinary(found))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row, by start and kind.

    Spans of the rules always stay; ``format`` spans do not overlap them. A null text is empty;
    repeated rows are scanned each; extra columns are not read. Without enough labelled
    credentials there are no ``format`` spans.
    """
    found = stored(_find(docs))
    formats = learnt(found)
    kept = "array<struct<kind:string,start:int,end:int>>"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for spans, others in zip(batch["spans"], batch["runs"], strict=True):
                both = [*spans, *(r for r in others if formats.likely(r["text"]))]
                both.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
                out.append([{k: s[k] for k in ("kind", "start", "end")} for s in both])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": out})

    return found.mapInPandas(judge, f"doc_id long, spans {kept}")


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> Column:
    """The column ``text`` of these documents with every span replaced."""
    formats = learnt(stored(_find(docs)))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if not text:
                return text
            spans = base_spans(text)
            cuts = [(a, b) for _, a, b in spans]
            cuts += [(a, b) for a, b in runs(text, spans) if formats.likely(text[a:b])]
            parts, at = [], 0
            for a, b in sorted(cuts):
                if a >= at:
                    parts += [text[at:a], mask]
                at = max(at, b)
            return "".join([*parts, text[at:]])

        return texts.map(one)

    return clean(F.col("text"))
