"""Manifest, filter audit and quality rules against brute force, and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablegauge.llm import merkle, outliers, queries, survival
from tests.compare import connect, difference
from tests.conftest import SMALL

DOC = "doc_id long, text string, lang string, source string, n_chars long, digest string, part int"
LABEL = "doc_id long, quality int, toxic int"
ODD = [
    (1, None, "en", "a", None, "x", 9), (2, "", "en", None, 0, "x", 9),
    (3, "One two\nOne two\nthree #", None, "b", 5, "x", 9),
    (3, "One two\nOne two\nthree #", None, "b", 5, "x", 9),
    (None, "One two\nOne two\nthree #", "en", "a", 5, "x", 9), (None, None, None, None, None, None, 9),
    (4, "word Word\x85w x $ " * 40_000, "en", "a", 5, "x", 9), (5, " \t\n", "en", "", 5, "x", 9),
    (6, "\U0001f642 É one\x1ctwo " * 60, "de", "ß", 5, "x", 9), (7, "", "de", "ß", 5, "x", 9),
]
LABELS = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (4, None, 1), (None, 1, 1), (99, 1, 1), (7, 0, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, LABEL)


def nothing(spark):
    return spark.createDataFrame([], DOC)


# ---- manifest ----------------------------------------------------------------------------

def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(digests):
    """All levels of a tree, leaves first."""
    tree = [digests]
    while len(tree[-1]) > 1:
        last = tree[-1]
        tree.append([h(*last[i:i + 16]) for i in range(0, len(last), 16)])
    return tree


def siblings(tree, index):
    for level in tree[:-1]:
        start = index // 16 * 16
        yield level[start:index], level[index + 1:start + 16]
        index //= 16


def manifest_by_hand(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row["source"]].append((row, leaf_of(row, row["text"])))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by_source[source].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[source] = levels([leaf for _, leaf in by_source[source]])
    top = levels([trees[s][-1][0] for s in order])
    root = top[-1][0]
    for number, source in enumerate(order):
        for index, (row, leaf) in enumerate(by_source[source]):
            way = [*siblings(trees[source], index), *siblings(top, number)]
            changed = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                text = row["text"] and re.sub("[A-Z]", lambda m: m[0].lower(), row["text"])
                changed = leaf_of(row, text)
            for before, after in way:
                changed = h(*before, changed, *after)
            yield (row["doc_id"], leaf, trees[source][-1][0], root,
                   h(*[d for pair in way for side in pair for d in side]), changed, changed == root)


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_manifest_of_odd_rows(odd):
    got = merkle.audited(odd)
    assert in_order(got.collect()) == in_order(manifest_by_hand(odd.collect()))


def test_manifest_over_several_blocks_of_a_hot_source(spark):
    """A source of two rounds of blocks, ragged last runs, and many small sources."""
    size = merkle.BLOCK * 2 + 17
    docs = spark.range(size + 300).select(
        (F.col("id") * 7 % 9001).alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"),
        F.lit("en").alias("lang"), F.col("id").alias("n_chars"),
        F.when(F.col("id") >= size, F.concat(F.lit("s"), (F.col("id") % 290).cast("string")))
        .when(F.col("id") >= 1, "hot").alias("source"))
    got = merkle.audited(docs).collect()
    assert in_order(got) == in_order(manifest_by_hand(docs.collect()))
    assert not all(r["verified"] for r in got)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096])
def test_sweeps_inside_a_block(n):
    digests = [h(str(i)) for i in range(n)]
    tree = levels(digests)
    root, runs = merkle.forward(digests, len(tree) - 1)
    assert root == tree[-1][0]
    above = (("x", "y"),)
    proofs = merkle.backward(runs, n, len(tree) - 1, above)
    for index in {0, n // 2, n - 1}:
        way = tuple(("".join(b), "".join(a)) for b, a in siblings(tree, index))
        assert proofs[index] == way + above
        assert merkle.folded(digests[index], way) == root
        assert merkle._read(merkle._written(proofs[index])) == proofs[index]


def test_manifest_of_nothing_and_of_one_row(spark):
    assert merkle.audited(nothing(spark)).collect() == []
    one = spark.createDataFrame(ODD[:1], DOC)
    row = merkle.audited(one).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"]
    assert row["proof_sha256"] == h("") and row["verified"]


# ---- filter audit ------------------------------------------------------------------------

def failures(rows):
    for row in rows:
        text = row["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any((o["text"] or "") == text and o["doc_id"] is not None
                      and row["doc_id"] is not None and o["doc_id"] < row["doc_id"] for o in rows)
        yield row, "".join(name for name, fails in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
            ("D", bool(re.search(r"[#$%&*|]", text))), ("E", smaller)) if fails)


def audit_by_hand(rows, marks):
    good = {m["doc_id"] for m in marks if m["quality"] == 1} - {None}
    toxic = {m["doc_id"] for m in marks if m["toxic"] == 1} - {None}
    found, total = Counter(), Counter()
    parts = defaultdict(list)
    for row, fails in failures(rows):
        parts[row["source"] or ""].append((row["doc_id"], fails))
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            gone = set()
            for step, letter in enumerate(order, 1):
                now = {i for i, (_, fails) in enumerate(docs) if letter in fails} - gone
                before, gone = gone, gone | now
                total[part, letter] += len(now)
                found[part, "".join(order), step] = [
                    len(docs) - len(gone), len(now),
                    sum(letter in docs[i][1] for i in before),
                    sum(fails == letter for _, fails in docs),
                    sum(docs[i][0] in good for i in now), sum(docs[i][0] in toxic for i in now)]
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def test_audit_of_odd_rows(odd, labels):
    got = survival.audit(odd, labels).collect()
    assert set(map(tuple, got)) == audit_by_hand(odd.collect(), labels.collect())
    assert len(got) == 600 * 4  # the sources a, b and ß; null counts with the empty one


def test_audit_of_nothing(spark, labels):
    assert survival.audit(nothing(spark), labels).collect() == []


def test_audit_without_labels(spark, odd):
    got = survival.audit(odd, spark.createDataFrame([], LABEL))
    assert got.agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0] == 0


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_carry_save_counts(words):
    got = survival.positional_popcount(np.array(words, dtype=np.uint32))
    assert got.tolist() == [sum(w >> bit & 1 for w in words) for bit in range(32)]


def test_survival_words_are_truth_tables():
    words = survival.survival_words(np.arange(32))
    for failed, word in enumerate(words.tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(not s & failed) for s in range(32)]


# ---- quality rules -----------------------------------------------------------------------

def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated,
            len(inside))


def test_counts(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = docs.unionByName(odd.select(*docs.columns)).collect()
    frame = spark.createDataFrame(rows, docs.schema)
    got = outliers.measured(frame).select("doc_id", *outliers.COUNTS[:5]).collect()
    assert in_order(got) == in_order((r["doc_id"], *counts_by_hand(r["text"])) for r in rows)


@settings(deadline=None, max_examples=200)
@given(st.text("ab \n é#", max_size=60))
def test_counts_of_any_text(text):
    assert outliers.counts(text.encode())[:5] == counts_by_hand(text)


def mcd_by_hand(points, above=None):
    """Concentration steps from both starts by sorting, with the operator's constants."""
    n, best = len(points), None
    floor = np.array(outliers.FLOOR)
    low, middle, high = (
        (np.floor(np.sort(points * outliers.GRID, axis=0)[
            [max(0, int(np.ceil(share * n)) - 1)]][0]) + 0.5) / outliers.GRID
        for share in (0.25, 0.5, 0.75))
    scale = (high - low) / 1.349
    drawn = middle + (scale + floor) * np.tanh((points - middle) / (scale + floor))
    firsts = [(middle, np.diag(scale**2)), (drawn.mean(0), np.cov(drawn.T, bias=True))]

    def leaning(mean, spread, rows):
        if above is None:
            return mean, spread
        own = rows / (rows + outliers.WEIGHT)
        return own * mean + (1 - own) * above[0], own * spread + (1 - own) * above[1]

    def far(mean, spread):
        off = points - mean
        return np.einsum("ij,ij->i", off @ np.linalg.inv(spread + np.diag(floor**2)), off)

    for mean, spread in firsts:
        mean, spread = leaning(mean, spread, n)
        for _ in range(outliers.STEPS):
            near = points[np.argsort(far(mean, spread))[:int(np.ceil(outliers.CORE * n))]]
            mean, spread = leaning(
                near.mean(0), np.cov(near.T, bias=True) / outliers.SHORT, len(near))
        logdet = np.linalg.slogdet(spread + np.diag(floor**2))[1]
        if best is None or logdet < best[0]:
            best = logdet, mean, spread, far(mean, spread)
    return best[1:]


def test_estimates_of_a_contaminated_group(spark):
    """A fifth of a group is junk in one spot: estimates are those of the rest."""
    random = np.random.default_rng(5)
    mix = random.normal(size=(6, 6)) * 0.6
    points = random.normal(size=(2000, 6)) @ mix + 3
    points[:400] = random.normal(size=(400, 6)) * 0.05 + [9, 0, 9, 0, 9, 0]
    frame = spark.createDataFrame(
        [("g", *map(float, p)) for p in points], "`group` string, " + ", ".join(
            f"{x} double" for x in outliers.X))
    none = spark.createDataFrame([], "group string, above array<double>, around array<double>")
    got = outliers.mcd(frame, none).collect()[0]
    mean, _, _ = mcd_by_hand(points)
    assert np.allclose(got["location"], mean, atol=0.05)
    clean = points[400:]
    assert np.allclose(got["location"], clean.mean(0), atol=0.15)
    spread, true = np.reshape(got["spread"], (6, 6)), np.cov(clean.T)
    # The core is nearly all of the clean rows, so they look a little wider than they are.
    assert np.allclose(np.diag(spread) / np.diag(true), 1.2, atol=0.15)
    scale = np.sqrt(np.outer(np.diag(true), np.diag(true)))
    assert np.abs(spread / 1.2 - true).max() < 0.12 * scale.max()
    far = frame.crossJoin(F.broadcast(spark.createDataFrame(
        [got], "`group` string, location array<double>, spread array<double>, "
               "whitener array<double>").drop("group"))).select(
        F.expr(outliers.distance()).alias("d")).toPandas()["d"].to_numpy()
    assert (far[:400] > outliers.LIMIT).all() and (far[400:] <= outliers.LIMIT).mean() > 0.99


def test_chi_square():
    assert outliers.quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)
    assert outliers.below(outliers.quantile(0.3, 8), 8) == pytest.approx(0.3)


def test_verdicts_by_hand_on_the_given_documents(spark):
    """Verdicts equal those of estimates by sorting, but for documents right at the limit."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = outliers.judged(docs).toPandas().set_index("doc_id")
    source = docs.drop("text").toPandas().set_index("doc_id")
    rows = outliers.measured(docs).withColumns(outliers.vector()).toPandas().set_index("doc_id")
    sound = rows[~got["base_failed"]].join(source[["lang", "source"]], rsuffix="_of")
    assert not got[got["base_failed"]]["kept"].any()
    for _, language in sound.groupby("lang"):
        above = mcd_by_hand(language[outliers.X].to_numpy())
        for _, group in language.groupby("source"):
            far = mcd_by_hand(group[outliers.X].to_numpy(), above)[2]
            clear = np.abs(np.log(far / outliers.LIMIT)) > 0.3
            assert (got.loc[group.index[clear], "kept"] == (far[clear] <= outliers.LIMIT)).all()


def test_ordinary_documents_stay_and_junk_goes(spark):
    """Held against labels, which the operator never sees."""
    folder = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = outliers.judged(docs).join(marks, "doc_id").where("not base_failed").groupBy(
        "quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, rows))
    assert share[1] > 0.98 and share[0] < 0.15


def test_verdicts_of_odd_rows(spark, odd):
    got = outliers.judged(odd).collect()
    assert len(got) == len(ODD)
    assert all(r["base_failed"] and not r["kept"] and r["distance"] is None for r in got
               if r["n_words"] < 50)
    assert outliers.judged(nothing(spark)).collect() == []


def test_one_ordinary_document_alone_stays(spark):
    words = " ".join(f"word{i}" for i in range(80))
    one = spark.createDataFrame([(1, words, None, None)], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in outliers.judged(one).collect()] == [True]


# ---- queries -----------------------------------------------------------------------------

COLUMNS = {
    "op11_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, "
                            "proof_sha256 string, folded_root string, verified boolean",
    "op12_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, "
                         "redundant bigint, unique_fails bigint, good_lost bigint, "
                         "toxic_lost bigint, shapley bigint",
    "op13_quality_outliers": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
                             "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
                             "kept boolean, distance double",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_sql(spark, name):
    frame = queries.QUERIES[name](spark, SMALL)
    assert ", ".join(f"{n} {kind}" for n, kind in frame.dtypes) == COLUMNS[name]
    if name in queries.ORACLES:
        assert difference(frame, connect(SMALL), queries.ORACLES[name]) is None
