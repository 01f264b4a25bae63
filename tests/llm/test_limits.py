"""Rows that once stopped a task: cut pages, long white space, many pieces of many lengths."""

import math
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.llm import common, graph, html, ngrams, packing


@pytest.mark.parametrize("page", [
    "<p>text</p><div " + " ".join(f'a{i}="v{i}"' for i in range(20_000)),
    "<p>text</p>" + "a <b " * 100_000,
    "<p>text</p><div " + "x='" * 100_000,
    "<p>text</p>" + "<div title=\"a" * 50_000,
])
def test_cut_pages_take_linear_time(page):
    start = time.perf_counter()
    assert html.main_text(page).startswith("text")
    assert time.perf_counter() - start < 10


def test_tags_keep_their_quoted_values():
    assert html.main_text("<p>a<b title='x > y' c=\"'>\">d</b> e</p><img alt=\"<p>\"/>f") == "ad e\nf"


@pytest.mark.parametrize("run", [" ", "\n", " \t"])
def test_very_long_white_space(run):
    encode = packing.Encoder("byte_bpe_50k", 2)
    for text in (run * 1_000_000, "a" + run * 20_000 + "b"):
        ids = encode(text)
        assert len(ids) > 1 and ids[-1] == 2 and encode.slow is not None


def test_many_pieces_of_many_lengths(spark, monkeypatch):
    """Every length has more pieces than a cell: the plan stays small, the places stay right."""
    monkeypatch.setattr(packing, "CELL_ROWS", 3)
    words = spark.range(6000).selectExpr(
        "id as doc_id", "repeat('word ', cast(id % 600 as int)) as text")
    rows = packing.place(words, 1024).toPandas()
    assert rows["length"].nunique() > 500
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        ends = part["length"].cumsum().to_numpy()
        assert ends[-1] <= 1024 and part["offset"].iloc[0] == 0
        assert (part["offset"].to_numpy()[1:] == ends[:-1]).all()


@pytest.mark.parametrize("block", [1, 7, 1_000_000])
def test_shingles_are_those_of_the_words(block, monkeypatch):
    """Keys and sets against words split by Python, whatever the size of a block."""
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", block)
    random.seed(3)
    parts = ["a", "B", "b", "Ab", "ab", "ÄÖ", "x" * 300, "x" * 301, "\x1c", "\xa0", *" \t\n\x0b\x0c\r"]
    texts = [b"", b" ", b"\n", b"a", b" a ", b"A"] + [
        "".join(random.choices(parts, k=random.choice([1, 2, 5, 40, 400]))).encode()
        for _ in range(600)]
    keys, sets = ngrams._cut(texts, 3)
    by_key, by_set = {}, {}
    for text, key, found in zip(texts, keys, sets, strict=True):
        words = tuple(text.lower().split())
        n = min(3, len(words))
        grams = frozenset(words[i:i + n] for i in range(len(words) - n + 1)) if words else frozenset()
        assert (key is None) == (not words) and len(found) == len(grams)
        assert by_key.setdefault(key, words) == words
        assert by_set.setdefault(tuple(found), grams) == grams
    assert len(set(by_key.values())) == len(by_key) and len(set(by_set.values())) == len(by_set)


def test_different_texts_of_one_id_all_stay(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in ngrams.one_of_each(docs).collect())
    assert kept == [(0, "a b c d e f"), (1, "a b c d e f"), (1, "u v w x y z")]


def test_near_copies_leave_one_stored_table(spark):
    """What a join stored on the way is removed; its result can be read again and again."""
    texts = ["a b c d e f g h i j k l", "a b c d e f g h i j k l", "x y z", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = Path(common.run_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    result = ngrams.join(docs)
    assert len(set(folder.glob("*")) - before) == 1
    for _ in range(2):
        assert sorted(map(tuple, result.collect())) == [(0, 10, 0), (1, 10, 0), (2, 1, 2), (3, 0, 3)]


@pytest.mark.parametrize("frequent", [1, 2, 100])
def test_prefixes_are_moved_once_and_sets_of_near_pairs_only(spark, monkeypatch, frequent):
    """Whatever counts as frequent, entries are made once and unlike texts are not compared."""
    plans, near = [], []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        table = common.stored(df)
        if df.columns == ["a", "b"]:
            near.append(table.count())
        return table

    monkeypatch.setattr(ngrams, "stored", noted)
    monkeypatch.setattr(ngrams, "FREQUENT", frequent)
    random.seed(5)
    shared = [f"s{i}" for i in range(60)]  # every text has these, in its own order, and 10 pairs are alike
    texts = []
    for i in range(20):
        words = shared + [f"u{i}x{k}" for k in range(40)]
        random.shuffle(words)
        texts += [" ".join(words), " ".join([*words[:-1], "last"])] if i < 10 else [" ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngrams.join(docs, 1, 90).collect()}
    assert got == {i: i - i % 2 if i < 20 else i for i in range(30)}
    assert sum(p.count("posexplode") for p in plans) == 1
    assert near and max(near[-2:]) <= 10


def test_marks_differ_in_no_more_bits_than_sets():
    random.seed(9)
    for n in (0, 1, 50, 3_000):
        a = np.array(random.sample(range(-2**63, 2**63, 7), n), np.int64)
        for common_part in (0, n // 2, n - n // 20):
            b = np.concatenate([a[:common_part], np.array(
                random.sample(range(-2**63 + 1, 2**63, 7), n // 2), np.int64)])
            bits = sum(bin(x & 2**64 - 1).count("1") for x in (ngrams._mark(a) ^ ngrams._mark(b)).tolist())
            assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_bounds_of_parts_rule_out_unlike_ones_and_no_link(spark):
    """Parts of groups that hold a link stay together, those of unlike texts become no pair."""
    random.seed(11)
    alike, sets, rows = ngrams.Alike(1, 90), {}, []
    for family in range(8):
        base = random.sample(range(-2**63, 2**63, 7), 200)
        for _ in range(4):  # heads 0 and 1 of a family have two members each, all near copies
            node = len(sets)
            sets[node] = np.array(base[:196] + random.sample(range(-2**63 + 1, 2**63, 7), 4), np.int64)
            rows.append((node, 2 * family + node % 2, family, 200, ngrams._mark(sets[node]).tolist()))
    frame = spark.createDataFrame(
        rows, "node long, head long, component long, n int, mark array<long>")
    found = ngrams._bounds(frame.drop("mark"), frame.select("node", "mark"))
    a = found.select(F.col("head").alias("a"), F.col("bounds").alias("x"))
    b = found.select(F.col("head").alias("b"), F.col("bounds").alias("y"))
    kept = a.crossJoin(b).filter(~alike.apart(F.col("x"), F.col("y"))).select("a", "b").collect()
    assert {(r["a"], r["b"]) for r in kept} == {
        (i, j) for i in range(16) for j in range(16) if i // 2 == j // 2}


def test_parts_make_a_pair_where_they_first_meet(spark):
    """Every two parts that share a shingle become a pair, near copies hardly more than once."""
    random.seed(13)
    base, rows, sets = list(range(400)), [], {}
    for head in range(12):  # the last one has little in common with the others
        own = random.sample(base, 300) if head < 11 else random.sample(base, 3)
        sets[head] = set(own)
        rows += [(token, head, head, 400 - rank) for rank, token in enumerate(sorted(own))]
    random.shuffle(rows)
    met = ngrams._met(spark.createDataFrame(rows, "token long, head long, component long, from int"))
    a = met.select("token", F.col("head").alias("a"), F.col("before").alias("x"))
    b = met.select("token", F.col("head").alias("b"), F.col("before").alias("y"))
    kept = a.join(b, "token").filter("a < b").filter(~F.arrays_overlap("x", "y")).select("a", "b").collect()
    pairs = {(i, j) for i in sets for j in sets if i < j and sets[i] & sets[j]}
    assert {tuple(r) for r in kept} == pairs
    assert len(kept) <= 2 * len(pairs) < sum(len(sets[i] & sets[j]) for i, j in pairs) / 20


def _brute_prefixes(texts, alike, frequent=1):
    """(node, n, token, rank) of prefix shingles of several texts, counted over all of them."""
    sets = {i: ngrams._cut([(t or "").encode()], alike.words)[1][0].tolist() for i, t in texts}
    times = Counter(token for found in sets.values() for token in found)
    prefixes = {}
    for i, found in sets.items():
        found.sort(key=lambda x: (times[x] > 1 and max(times[x], frequent), x))
        n = len(found)
        reach = min(n, n - math.ceil(n * alike.percent / 100)
                    + (n - math.ceil(n * alike.percent / 100) + 1) // 5 + 1)
        prefixes[i] = found[:reach]
    met = Counter(token for prefix in prefixes.values() for token in prefix)
    return sorted((i, len(sets[i]), token, rank) for i, prefix in prefixes.items()
                  for rank, token in enumerate(prefix) if met[token] > 1)


def test_shingles_are_counted_over_all_texts(spark):
    """Frequencies are of the whole input, with no bound on the texts or on the frequent shingles."""
    random.seed(11)
    texts = [(i, " ".join([f"w{int(random.paretovariate(0.6))}" for _ in range(8)] + [f"u{i}"]))
             for i in range(16_000)] + [(16_000, None), (16_001, " "), (16_002, "w1")]
    alike = ngrams.Alike(1, 50)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = ngrams._prefixes(ngrams.cut_texts(docs, alike)).select("node", "n", "token", "rank")
    assert sorted(map(tuple, got.collect())) == _brute_prefixes(texts, alike)


def test_one_task_connects_what_rounds_connect(spark):
    random.seed(13)
    edges = [(i, i + 1) for i in range(60)] + [(200 - i, 199 - i) for i in range(40)] + [(5, 5), (None, 7)]
    edges += [(random.randrange(300, 900), random.randrange(300, 900)) for _ in range(300)]
    random.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = [sorted(map(tuple, graph.components(frame, n).collect())) for n in (0, 1_000)]
    assert got[0] == got[1] and len(got[0]) > 100
    assert graph.components(frame.limit(0), 1_000).count() == 0


def test_prefixes_do_not_depend_on_how_texts_are_dealt(spark, monkeypatch):
    """The pipeline's shingles, counted in one part by one task or in many from many batches."""
    random.seed(12)
    passages = [" ".join(f"p{i}x{k}" for k in range(9)) for i in range(12)]
    texts = [(i, " ".join([*random.sample(passages, 3), *(f"u{i}x{k}" for k in range(random.choice([0, 2, 40])))]))
             for i in range(90)] + [(90, None), (91, "p0x0 p0x1")]
    alike, key = ngrams.Alike(5, 80), "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expected = _brute_prefixes(texts, alike)
    assert expected
    before = spark.conf.get(key)
    for parts, size, rows, tasks in ((1, 10**9, 2_000, 1), (3, 500, 7, 5)):
        monkeypatch.setattr(ngrams, "PARTS", parts)
        monkeypatch.setattr(ngrams, "PART_BYTES", size)
        spark.conf.set(key, rows)
        try:
            got = ngrams._prefixes(ngrams.cut_texts(docs.repartition(tasks), alike)).select(
                "node", "n", "token", "rank").collect()
        finally:
            spark.conf.set(key, before)
        assert sorted(map(tuple, got)) == expected
