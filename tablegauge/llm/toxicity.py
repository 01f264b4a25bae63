"""Toxicity as an ordinal grade of severity.

A cumulative-link model: one weight per word, shared by all grades, and an ordered threshold
per grade; the chance that a text is worse than grade k is the logistic of its score less
threshold k. The expected severity is the sum of these chances. Features are sparse: the logs
of the counts of those words whose share of toxic documents differs beyond chance.

The model is fitted to a bounded sample of labelled documents (``per_label`` of each label);
every document is then scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import bound, hashed, stored

WORD = re.compile(r"\w+")
#: Labelled documents of each label that the model is fitted to, and words it may use.
PER_LABEL = 4000
FEATURES = 1024
#: Documents that a word must occur in, and standard errors that its share must differ by.
SUPPORT = 5
CERTAIN = 5.0
#: Expected severity from which a text counts as toxic.
LIMIT = 0.25

SCORED = "doc_id long, severity double, grade int, toxic boolean"


@dataclass
class Model:
    """Words with their weights, and the ordered thresholds between the grades."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, text: str | None) -> np.ndarray:
        """The chance to be worse than each grade but the last."""
        if not self.words:
            return np.zeros(len(self.thresholds))
        counts: dict[int, int] = {}
        for word in WORD.findall((text or "").lower()):
            i = self.words.get(word)
            if i is not None:
                counts[i] = counts.get(i, 0) + 1
        score = sum(self.weights[i] * np.log1p(n) for i, n in counts.items())
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))

    def severity(self, text: str | None) -> float:
        return float(self.chances(text).sum())

    def grade(self, text: str | None) -> int:
        """The likeliest grade."""
        above = np.concatenate([[1.0], self.chances(text), [0.0]])
        return int(np.argmax(above[:-1] - above[1:]))


def fit_ordinal(
    x: np.ndarray, grades: np.ndarray, n_grades: int, penalty: float = 1e-4, steps: int = 800
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by gradient descent with moments.

    Thresholds are a first value and positive steps, so they stay in order.
    """
    rows, width = x.shape
    present = np.bincount(grades, minlength=n_grades) + 1.0
    share = 1 - np.cumsum(present)[:-1] / present.sum()
    start = -np.log(share / (1 - share))
    at = np.concatenate([
        np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for t in range(1, steps + 1):
        weights, gaps = at[:width], np.exp(at[width + 1:])
        thresholds = at[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = x @ weights
        above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -50, 50)))
        edges = np.concatenate([np.ones((rows, 1)), above, np.zeros((rows, 1))], axis=1)
        likely = np.maximum(
            edges[np.arange(rows), grades] - edges[np.arange(rows), grades + 1], 1e-12)
        slope = edges * (1 - edges)
        down, up = slope[np.arange(rows), grades], slope[np.arange(rows), grades + 1]
        by_score = -(down - up) / likely / rows
        by_threshold = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            by_threshold[k] = (
                (down / likely)[grades == k + 1].sum() - (up / likely)[grades == k].sum()) / rows
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([
            x.T @ by_score + penalty * weights, tail[:1], tail[1:] * gaps])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        at = at - 0.1 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
    gaps = np.exp(at[width + 1:])
    return at[:width], at[width] + np.concatenate([[0.0], np.cumsum(gaps)])


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """label and text of a bounded sample of labelled documents, copies once.

    The sample is of labels, by the hash of their ids, so it is the same on every run. Texts
    whose five-word shingle of the smallest hash is the same count as copies: many copies of
    one text would make its words look telling.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label"))
        .filter("doc_id is not null and label is not null").distinct())
    parts = [
        known.filter(F.col("label") == label).orderBy(hashed(31, F.col("doc_id")), "doc_id")
        .limit(per_label) for label in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    shingles = bound(F.split(F.lower("text"), r"\s+"), lambda words: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1))),
        lambda i: hashed(37, F.slice(words, i, 5))))
    return stored(
        docs.select(F.col("doc_id").cast("long"), "text")
        .join(F.broadcast(chosen), "doc_id")  # at most per_label rows of each label
        .filter("text is not null").withColumn("least", F.array_min(shingles))
        .groupBy("label", "least").agg(F.min("text").alias("text")).select("label", "text"))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """The model of three grades: clean, toxic, and toxic with much of it.

    Labels only say whether a document is toxic; a toxic one has the higher grade if it holds
    more telling words than the median toxic one. With one label only, or no telling word, the model
    has no words and finds everything clean.
    """
    texts = sample(docs, labels, per_label)
    size = {r["label"]: r["n"] for r in
            texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Model({}, np.zeros(0), np.array([50.0, 100.0]))
    if len(size) < 2:
        return nothing

    def distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(w, label) for label, text in zip(batch["label"], batch["text"], strict=True)
                     for w in set(WORD.findall(text.lower()))]
            yield pd.DataFrame(pairs, columns=["word", "label"])

    share = [F.col(f"n{label}") / F.lit(size[label]) for label in (0, 1)]
    both = (F.col("n0") + F.col("n1")) / F.lit(size[0] + size[1])
    error = F.sqrt(both * (1 - both) * F.lit(1 / size[0] + 1 / size[1]))
    words = (
        texts.mapInPandas(distinct_words, "word string, label int")
        .groupBy("word").agg(
            F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
        .filter(F.col("n0") + F.col("n1") >= SUPPORT)
        .withColumn("z", (share[1] - share[0]) / error)
        .filter(F.abs("z") >= CERTAIN)
        .orderBy(F.abs("z").desc(), "word").limit(FEATURES).collect())
    if not words:
        return nothing
    index = {r["word"]: i for i, r in enumerate(words)}
    telling = {i for i, r in enumerate(words) if r["z"] > 0}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for label, text in zip(batch["label"], batch["text"], strict=True):
                counts: dict[int, int] = {}
                for word in WORD.findall(text.lower()):
                    if word in index:
                        counts[index[word]] = counts.get(index[word], 0) + 1
                hits = sum(n for i, n in counts.items() if i in telling)
                rows.append((label, hits, list(counts), list(counts.values())))
            yield pd.DataFrame(rows, columns=["label", "hits", "word", "times"])

    rows = texts.mapInPandas(
        features, "label int, hits int, word array<int>, times array<int>"
    ).orderBy("label", "hits", "word", "times").collect()  # bounded by the sample
    x = np.zeros((len(rows), len(index)), dtype=np.float32)
    for k, row in enumerate(rows):
        x[k, row["word"]] = np.log1p(row["times"])
    hits = np.array([r["hits"] for r in rows])
    toxic = np.array([r["label"] for r in rows]) == 1
    grades = np.where(toxic, 1 + (hits > np.median(hits[toxic])), 0)
    weights, thresholds = fit_ordinal(x, grades, 3)
    return Model(index, weights, thresholds)


def score(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """doc_id, severity, grade and toxic of every row.

    A null text is empty and clean; repeated rows are scored each; extra columns are not read.
    """
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            severity = [model.severity(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "severity": severity,
                "grade": [model.grade(t) if s > 0.01 else 0
                          for t, s in zip(batch["text"], severity, strict=True)],
                "toxic": [s >= limit for s in severity]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(judge, SCORED)


def severity(model: Model) -> Column:
    """Expected severity of the column ``text``; 0 for a null one."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.severity(t) if t else 0.0, na_action=None).astype(float)

    return of(F.col("text"))
