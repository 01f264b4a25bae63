"""Every operator against a brute-force version, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablegauge.llm import (
    chat, html, mixing, ngrams, nndescent, packing, pivots, queries, secrets, sharding, toxicity,
)
from tests.conftest import SMALL

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, n int"
ODD = [
    (1, None, "en", "a", None, 9, 9, 9), (2, "", "en", None, 0, 9, 9, 9),
    (3, "one two three four five", "en", "b", 5, 9, 9, 9),
    (3, "one two three four five", "en", "b", 5, 9, 9, 9),
    (None, "one two three four five", "en", "a", 5, 9, 9, 9),
    (4, "word " * 30_000, "en", "a", 5, 9, 9, 9), (5, " \t\n", "en", "a", 5, 9, 9, 9),
    (6, "token = 'abcdefghijkl0123' </s>", "en", "c", 5, 9, 9, 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def test_packing_places_every_token_without_gaps(docs, odd):
    for frame in (docs, odd):
        rows = packing.place(frame, 128).toPandas()
        for _, part in rows.sort_values("offset").groupby("sequence_id"):
            ends = part["length"].cumsum().to_numpy()
            assert ends[-1] <= 128 and (part["offset"].to_numpy()[1:] == ends[:-1]).all()
            assert part["offset"].iloc[0] == 0
        least = -(-rows["length"].sum() // 128)
        assert rows["sequence_id"].nunique() <= least * 1.03 + 1


def test_packing_uses_the_tokenizers_ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.Encoder("byte_bpe_50k", 2)
    texts = [r["text"] for r in docs.limit(60).collect()]
    for text in [*texts, "", "a<|endoftext|>b", "  x\n\n y z ", "日本語 ñandú 🙂", "'s 'LL 12345"]:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids + [2]


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_packing_plan_uses_each_piece_once(counts):
    used = Counter()
    for pattern, times in packing.fill(counts, 64):
        assert sum(pattern) <= 64
        for size in pattern:
            used[size] += times
    assert used == Counter(counts)


def test_sequences_hold_the_pieces(docs):
    rows = packing.sequences(docs.limit(20), 256).collect()
    total = packing.place(docs.limit(20), 256).agg(F.sum("length")).first()[0]
    assert sum(len(r["ids"]) for r in rows) == total and all(len(r["ids"]) <= 256 for r in rows)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<div id="top-menu"><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div>
<div class="content"><h2>Title &amp; more</h2><p>First <b>bold</b> paragraph, with
 commas; and   spaces.<p>Second paragraph, closed by nothing.
<div class="ad-box">Buy now!</div><ul><li>item one</li><li>item two</li></ul>
<table><tr><td>cell</td></tr></table></div>
<form><p>Your name</p></form><div class="comments"><p>Great read, thanks, all!</p></div>
<footer>&copy; 2024</footer><script>var a = "</p>";</script></body></html>"""


def test_html_keeps_the_article_only(spark):
    assert html.main_text(PAGE) == (
        "Title & more\nFirst bold paragraph, with commas; and spaces.\n"
        "Second paragraph, closed by nothing.\nitem one\nitem two\ncell")
    rows = spark.createDataFrame(
        [(1, "u", None), (2, None, ""), (None, "u", "plain <b>text"), (1, "u", "<nav>x</nav>")],
        "page_id long, url string, html string")
    assert [r["text"] for r in html.extract(rows).collect()] == ["", "", "plain text", ""]


@pytest.mark.parametrize("open_tag, head", [
    ('<div class="content with-sidebar">', "<h1>Title</h1>"),
    ('<div id="content" class="no-sidebar">', "<h1>Title</h1>"),
    ('<div class="sidebar-right">', "<h1>Title</h1>"), ('<form id="page">', "<h1>Title</h1>"),
    ('<div class="search-results-study">', "<h1>Title</h1>"),
    ("<article>", '<div class="article-header"><h1>Title</h1></div>')])
def test_html_names_of_layout_keep_the_article(open_tag, head):
    said = "A sentence of the article, long enough to count; and it goes on for a while."
    tag = re.match(r"<(\w+)", open_tag)[1]
    page = (f"<body><div class='sidebar'><a href=x>link</a></div>{open_tag}{head}"
            f"<p>{said}</p><p>{said}</p><div class='comments'><p>{said}</p></div>"
            f"<div class='share-buttons'>Share this</div></{tag}></body>")
    assert html.main_text(page) == f"Title\n{said}\n{said}"


@pytest.mark.parametrize("box", ["div class=body", "ul", "blockquote", "section"])
def test_html_keeps_what_stands_beside_the_long_part(box):
    said = "A sentence of the article, long enough to count; and it goes on for a while."
    tag, inner = box.split()[0], "li" if box == "ul" else "p"
    page = (f"<body><div class=top><a href=x>home</a></div><div class=post><h1>Title</h1>"
            f"<p>{said}</p><{box}>" + f"<{inner}>{said}</{inner}>" * 20 + f"</{tag}></div></body>")
    assert html.main_text(page) == "\n".join(["Title", *[said] * 21])


def test_html_of_the_pages_is_their_article(spark):
    for row in spark.read.parquet(f"{SMALL}/pages.parquet").limit(80).collect():
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        import html as codec

        marked = re.sub(r"</?(?:p|h1)>", "\n", article)
        marked = re.sub(r"<!--.*?-->|<div class=\"ad\">.*?</div>", "", marked, flags=re.S)
        lines = [" ".join(codec.unescape(re.sub(r"<[^>]+>", " ", x)).split())
                 for x in re.split("\n", marked)]
        assert html.main_text(row["html"]).replace("\n", " ") == " ".join(x for x in lines if x)


def test_shards_are_even_and_copies_stay_together(docs, odd):
    for frame, shards in ((docs, 40), (odd, 3)):
        rows = sharding.deal(frame, shards).toPandas()
        sizes = rows.groupby("shard")["slot"].agg(["count", "max", "nunique"])
        assert sizes["count"].max() - sizes["count"].min() <= 1 and len(rows) == frame.count()
        assert (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sharding.deal(docs, 4).toPandas()
    for doc_id, size, crc in rows[["doc_id", "size", "text_crc32"]].itertuples(index=False):
        raw = texts[doc_id].encode()
        assert size == len(raw) + 16 and crc == zlib.crc32(raw)
    assert (rows["law"] == "rows").all() and rows["grown_shard"].isna().all()


def test_another_shard_moves_a_part_of_the_rows(docs):
    one, two = (sharding.deal(docs, n, 256).toPandas().set_index("doc_id")["shard"] for n in (8, 9))
    assert (one.loc[two.index] != two).mean() < 0.5  # dealing anew would move eight ninths


def test_secret_spans_of_the_rules():
    text = "x API_KEY: 'abcDEF123456+' AKIA" + "A1" * 8 + " 0123456789abcdef0 token=short"
    spans = secrets.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [
        ("assign", "API_KEY: 'abcDEF123456+"), ("access", "AKIA" + "A1" * 8),
        ("hex", "0123456789abcdef0")]


def test_secret_candidates_are_as_long_as_labelled_values():
    text = "Use sk.aB3dE5gH7jK. or Zx81Kq02Lm9P, not short.one; AKIA" + "A1" * 8 + ".Zx81Kq02Lm9Q..."
    found = secrets.runs(text, secrets.base_spans(text))
    assert [text[a:b] for a, b in found] == ["sk.aB3dE5gH7jK", "Zx81Kq02Lm9P", "Zx81Kq02Lm9Q"]


def test_automata_tell_formats():
    random = np.random.default_rng(1)
    keys = ["sk-" + "".join(random.choice(list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789"), 32))
            for _ in range(200)]
    words = ["".join(random.choice(["tion", "ment", "able", "er", "an"], 6)) for _ in range(200)]
    formats = secrets.learn({"key": keys[:150]}, words[:150])
    assert np.mean([formats.likely(k) for k in keys[150:]]) > 0.9
    assert not any(formats.likely(w) for w in words[150:])
    assert len(formats.kinds["key"][0].states) < 60  # merged, not the prefix tree


def test_unlabelled_credentials_are_not_ordinary(spark):
    random = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    keys = ["sk-" + "".join(random.choice(letters, 30)) for _ in range(300)]
    words = [a + b + c for a in ("inter", "counter", "under") for b in ("nation", "develop", "manage")
             for c in ("alisation", "ability", "mental")]
    rows = [(i, f"{words[i % 27]} and {words[i * 7 % 27]} "
                + (f"token={k}" if i < 100 else f"see {k} here")) for i, k in enumerate(keys)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [rows[r["doc_id"]][1][s["start"]:s["end"]] for s in r["spans"]
                         if s["kind"] == "format"] for r in secrets.scan(frame).collect()}
    assert not any(got[i] for i in range(100))
    assert np.mean([got[i] == [keys[i]] for i in range(100, 300)]) > 0.9


def test_secret_scan_equals_the_rules(docs, odd):
    for frame in (docs, odd):
        texts = Counter((r["doc_id"], str(secrets.base_spans(r["text"] or ""))) for r in frame.collect())
        got = Counter(
            (r["doc_id"], str([tuple(s) for s in r["spans"] if s["kind"] != "format"]))
            for r in secrets.scan(frame).collect())
        assert got == texts
    clean = odd.withColumn("text", secrets.redacted(odd)).filter("doc_id = 6").first()["text"]
    assert clean == "[SECRET]' </s>"


def test_mix_meets_targets(docs, odd):
    for frame in (docs, odd):
        rows = mixing.mix(frame).toPandas()
        total = rows["size"].sum()
        taken = (rows["copies"] * rows["size"]).groupby(rows["source"].fillna("~")).sum()
        target = rows.groupby(rows["source"].fillna("~"))["target"].first()
        longest = rows.groupby(rows["source"].fillna("~"))["size"].max()
        assert ((taken - target).abs() <= longest / 2 + 1e-6).all()
        assert abs(target.sum() - total) < 1e-6 * max(1, total) and rows["copies"].between(0, 3).all()
        again = mixing.mix(frame).toPandas()
        key = ["doc_id", "source", "copies"]
        assert Counter(map(str, rows[key].values)) == Counter(map(str, again[key].values))
    rows = mixing.mix(docs).groupBy().agg(F.sum("copies")).first()[0]
    assert mixing.mixed(docs).count() == rows and mixing.mixed(docs).columns == docs.columns


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 500, "c": 400, "d": 3, None: 87}
    rows = mixing.targets(spark.createDataFrame(
        [(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n long")).collect()
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    capped, left = {}, dict(sizes)
    while True:
        rest = 1000 - sum(capped.values())
        share = {k: rest * weights[k] / sum(weights[x] for x in left) for k in left}
        over = [k for k in left if share[k] > 3 * sizes[k]]
        if not over:
            break
        for k in over:
            capped[k] = 3 * sizes[k]
            del left[k]
    expected = capped | share
    assert all(abs(r["target"] - expected[r["source"]]) < 1e-9 for r in rows)


def test_toxicity_on_held_out_documents(spark):
    folder = SMALL.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.filter("doc_id % 5 <> 0")
    scored = toxicity.score(docs, toxicity.fit(docs, fit)).join(
        labels.filter("doc_id % 5 = 0").withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    toxic = scored["truth"] == 1
    assert scored.loc[toxic, "toxic"].mean() > 0.85 and scored.loc[~toxic, "toxic"].mean() < 0.01


def test_toxicity_without_labels_finds_all_clean(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd, toxicity.fit(odd, none)).collect()
    assert len(rows) == len(ODD) and not any(r["toxic"] for r in rows)


def test_ordinal_thresholds_are_ordered():
    random = np.random.default_rng(3)
    x = random.standard_normal((600, 3)).astype(np.float32)
    hidden = x @ np.array([2.0, -1.0, 0.0]) + random.logistic(size=600)
    weights, cuts = toxicity.fit_ordinal(x, np.digitize(hidden, [-1, 0.5, 2]), 4)
    assert (np.diff(cuts) > 0).all() and weights[0] > 1 and weights[1] < -0.4


def brute_join(rows, words, percent):
    sets, root = {}, {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or (
            {tuple(w)} if w else set())
        root[doc_id] = doc_id

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders = defaultdict(list)
    for doc_id, grams in sets.items():
        common = Counter(other for g in grams for other in holders[g])
        for other, k in common.items():
            if 100 * k >= percent * (len(grams) + len(sets[other]) - k):
                a, b = find(doc_id), find(other)
                root[max(a, b)] = min(a, b)
        for g in grams:
            holders[g].append(doc_id)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def family(n=60, seed=0):
    """Near copies of a few texts, with a passage that all share."""
    random = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = []
    for i in range(n):
        base = np.random.default_rng(i % 4)
        words = [f"w{x}" for x in base.integers(0, 5000, 30 + 40 * (i % 4))]
        for _ in range(i % 7):
            words[random.integers(len(words))] = f"x{random.integers(9999)}"
        texts.append(passage + " " + " ".join(words) if i % 2 else " ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (3, 50)])
def test_join_finds_the_components_of_all_links(spark, words, percent):
    rows = family()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in ngrams.join(frame, words, percent).collect()}
    assert got == brute_join(rows, words, percent)


def test_join_on_odd_rows(odd):
    rows = ngrams.join(odd, 3, 90).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == Counter([
        (1, 0, 1), (2, 0, 2), (3, 3, 3), (3, 3, 3), (None, 3, 3), (4, 1, 4), (5, 0, 5), (6, 2, 6)])
    assert sorted(r["doc_id"] or 0 for r in ngrams.one_of_each(odd).collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_layouts_become_turns(spark):
    records = [
        '{"messages": [{"content": "hi", "role": "user"}, {"role": "assistant", "content": null}]}',
        '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}',
        '{"output": "3", "instruction": "add", "input": "1 2"}', '{"prompt": "p", "response": "r"}',
        '{"other": 1}', '{"role": "user", "text": "t"}']
    frame = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string").withColumn(
        "record", F.parse_json("record"))
    got = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]]
           for r in chat.format_records(frame).collect()}
    assert got == {
        0: [("user", "hi"), ("assistant", "")], 1: [("user", "hi"), ("assistant", "yo")],
        2: [("user", "add\n\n1 2"), ("assistant", "3")], 3: [("user", "p"), ("assistant", "r")],
        4: None, 5: [("user", "t")]}


def test_chat_reads_back_what_it_wrote(spark):
    texts = ["<|im_end|>", "\\.", "<\\.|", "</s>[INST] ok [/INST]", "a\\\\<|im_sep|>", "", "é🙂<s>", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(2, None, None, None), (2, 0, "assistant", "x"), (None, 1, "we<|ird\n", "y")]
    out = chat.format_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in out.select(
        "conv_id", chat.parse(F.col("formatted")).alias("turns"), "formatted",
        chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()}
    assert [t["text"] for t in got[1]["turns"]] == texts
    assert got[1]["learnt"] == "".join(texts[1::2])
    assert got[1]["formatted"].count("<|im_end|>") == len(texts) and "</s>" not in got[1]["formatted"]
    assert [tuple(t) for t in got[2]["turns"]] == [("", ""), ("assistant", "x")]
    assert [tuple(t) for t in got[None]["turns"]] == [("we<|ird\n", "y")]


VECTORS = "vec_id long, embedding array<float>, class string, node int"


def some_vectors(n=400, d=16):
    random = np.random.default_rng(5)
    x = random.standard_normal((n, d)).astype(np.float32)
    x[50:80] = x[7] + 0.05 * random.standard_normal((30, d))
    x[90:140] = x[8]
    rows = [(i, [float(v) for v in r], "c", 1) for i, r in enumerate(x)]
    nan, gone = [float("nan")] * d, [None] * d
    rows += [(n, None, "c", 1), (n + 1, [0.0] * d, "c", 1), (n + 2, nan, "c", 1), (n + 3, gone, "c", 1),
             (n + 4, [1.0], "c", 1), (None, rows[0][1], "c", 1), (n + 5, [], "c", 1)]
    return x.astype(float), rows


def test_near_equal_vectors(spark):
    x, rows = some_vectors()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(20):
        root = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
    got = {r["vec_id"]: r for r in pivots.near_equal(spark.createDataFrame(rows, VECTORS)).collect()}
    assert all(got[i]["n_links"] == linked[i].sum() and got[i]["component_id"] == root[i]
               for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(x), len(x) + 6))


def test_near_equal_vectors_of_a_large_group(spark):
    import pandas as pd

    n, d = 9_000, 64
    random = np.random.default_rng(6)
    x = random.standard_normal((n, d))
    x[:n // 3] = x[0] + 0.2 * random.standard_normal((n // 3, d))  # cosines about 0.96
    x = random.permutation(x).astype(np.float32)
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": range(n), "embedding": x.tolist()}),
                                 "vec_id long, embedding array<float>")
    got = pivots.near_equal(rows).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == linked.sum(axis=1) - 1).all()


def test_nearest_neighbours(spark):
    x, rows = some_vectors()
    frame = spark.createDataFrame(rows, VECTORS)
    got = nndescent.search(frame, frame.filter("vec_id % 20 = 0"), 10).toPandas()
    found = 0
    for i in range(0, len(x), 20):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        mine = got[got["query_id"] == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine["score"], np.sort(d[mine["vec_id"]]))
        found += len(set(best) & set(mine["vec_id"]))
    assert found >= 0.9 * len(got) and set(got["query_id"]) == set(range(0, len(x), 20))


def recall(x, got, every):
    found = 0
    for i in range(0, len(x), every):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        mine = got[got["query_id"] == i].sort_values("rank")
        assert np.allclose(mine["score"], np.sqrt(d[mine["vec_id"]]))
        found += len(set(np.lexsort((np.arange(len(x)), d))[:10]) & set(mine["vec_id"]))
    return found / len(got)


@pytest.mark.parametrize("shape", ["one far larger", "far from zero", "a third alike"])
def test_nearest_neighbours_over_several_cells(spark, shape):
    random = np.random.default_rng(8)
    x = random.standard_normal((2_500, 32))
    if shape == "one far larger":
        x[17] *= 1e9
    elif shape == "far from zero":
        x += 1000
    else:
        x[::3] = x[0] + 0.01 * random.standard_normal((len(x[::3]), 32))
    x = x.astype(np.float32)
    frame = spark.createDataFrame(
        [(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = nndescent.search(frame, frame.filter("vec_id % 50 = 0"), 10).toPandas()
    assert len(got) == 500 and recall(x.astype(float), got, 50) >= 0.95


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    vectors = spark.createDataFrame([], VECTORS)
    for frame in (
        packing.place(docs), sharding.deal(docs), secrets.scan(docs), mixing.mix(docs),
        mixing.mixed(docs), ngrams.join(docs), pivots.near_equal(vectors),
        nndescent.search(vectors, vectors),
    ):
        assert frame.count() == 0


def test_the_chat_query_digests_as_named(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    turns = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    for r in queries.op8_chat_formatting(spark, SMALL).filter("conv_id >= 0").collect():
        said = "".join(f"{a}\n{b}\n" for a, b in turns[r["conv_id"]])
        learnt = "".join(b for a, b in turns[r["conv_id"]] if a == "assistant")
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (
            len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_what_a_walk_has_seen_moves_as_bytes(spark, monkeypatch):
    """No step takes up the numbers that queries have seen; a graph's edges move once a round."""
    kinds, plans, nndescent_stored = [], [], nndescent.stored

    def noted(df):
        if "done" in df.columns:
            kinds.append([df.schema[c].dataType.simpleString() for c in ("node", "d", "done")])
        if df.columns == ["node", "other", "d", "fresh"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return nndescent_stored(df)

    monkeypatch.setattr(nndescent, "stored", noted)
    x = np.random.default_rng(5).standard_normal((1_200, 8)).astype(np.float32)
    frame = spark.createDataFrame(
        [(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = nndescent.search(frame, frame.filter("vec_id % 100 = 0"), 10).toPandas()
    assert recall(x.astype(float), got, 100) >= 0.95
    assert kinds and all(k == ["binary"] * 3 for k in kinds)
    moved = [p.count("hashpartitioning(node") for p in plans]
    assert len(moved) > 1 and moved[0] == 1


def test_a_walk_is_one_row_per_query_and_expands_the_nearest(spark, monkeypatch):
    """The walk's state holds a query's nodes in one row, and sees what a plain walk sees."""
    states, nndescent_stored = [], nndescent.stored

    def noted(df):
        table = nndescent_stored(df)
        if "done" in df.columns:
            states.append(table.count())
        return table

    monkeypatch.setattr(nndescent, "stored", noted)
    monkeypatch.setattr(nndescent, "WIDTH", 8)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 4)).astype(np.float32)
    links = {i: sorted({*rng.integers(0, 300, 5).tolist()} - {i}) for i in range(300)}
    asked = range(0, 300, 15)
    found = spark.createDataFrame(
        [(i, bytearray(x[i].tobytes())) for i in range(300)], "node long, packed binary")
    queries = spark.createDataFrame(
        [(q, bytearray(x[q].tobytes()), [q, 7]) for q in asked],
        "query long, packed binary, start array<long>")
    got = nndescent.walk(
        spark.createDataFrame([(i, j) for i in links for j in links[i]], "node long, other long"),
        found, queries, 3, 5).collect()
    assert states and set(states) == {len(asked)}

    def far(q, i):
        return float(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())

    seen, done = {q: {q, 7} for q in asked}, {q: set() for q in asked}
    width, answer = 8, None
    while True:
        while True:
            fronts = {q: [i for i in sorted(seen[q], key=lambda i: (far(q, i), i))[:width]
                          if i not in done[q]][:-(-width // nndescent.STEPS)] for q in asked}
            if not any(fronts.values()):
                break
            for q, front in fronts.items():
                done[q] |= set(front)
                seen[q] |= {j for i in front for j in links[i]}
        nearest = {(q, i) for q in asked for i in sorted(seen[q], key=lambda i: (far(q, i), i))[:3]}
        if answer is not None and len(nearest - answer) <= nndescent.NEW_FOUND * len(nearest):
            break
        width, answer = 2 * width, nearest
    assert {(r["query"], r["node"]) for r in got} == {
        (q, i) for q in asked for i in sorted(seen[q], key=lambda i: (far(q, i), i))[:8]}
