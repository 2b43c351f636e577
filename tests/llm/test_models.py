"""Vectors, language identification, quality, and page text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import embedding, html, langid, quality, rolling

from . import plain_language

VECTOR = "vec_id long, embedding array<float>, label int"


def linked_by_brute_force(rows, threshold=0.93):
    good = []
    for vec_id, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and any(v):
            good.append((vec_id, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)), label))
    links = {(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and len(x) == len(y) and x @ y >= threshold}
    comp = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    count = {r[0]: sum(r[0] in x for x in links) for r in rows}
    return {r[0]: (count[r[0]], comp[r[0]]) for r in rows}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.standard_normal(64)
            for n in range(int(rng.integers(1, 5))):
                rows.append((k, [float(x) for x in (base + 0.25 * n * rng.standard_normal(64)).astype(np.float32)], label))
                k += 1
    same = rows[0][1]
    rows += [(k + n, same, 0) for n in range(6)] + [(k + 6, [2 * x for x in same], 0), (k + 7, same, 1), (k + 8, same[:32], 0)]
    rows += [(k + 9, None, 0), (k + 10, [0.0] * 64, 0), (k + 11, [None, 1.0], 0), (k + 12, [float("nan")] * 64, 0), (k + 13, [], 0), (k + 14, [1.0], 0), (k + 15, [3.0], 0)]
    return rows


def test_vectors_match_brute_force(spark, vectors):
    out = embedding.near_duplicates(spark.createDataFrame(vectors, VECTOR)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == linked_by_brute_force(vectors)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_vectors_in_tiles(spark, vectors, monkeypatch):
    monkeypatch.setattr(embedding, "TILE", 4)
    out = embedding.near_duplicates(spark.createDataFrame(vectors, VECTOR).withColumn("rep", F.lit(1)).withColumn("data", F.lit("x"))).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == linked_by_brute_force(vectors)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is barely enough: the hardest that must be found."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b = 0.935 * a + np.sqrt(1 - 0.935**2) * b / np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, b.tolist(), 0)]
    out = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert out.where("n_links > 0").count() >= 0.98 * 800


def test_vectors_without_ids(spark):
    rows = [(None, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (5, [2.0, 4.0], 0), (5, [1.0, 2.0], 0)]
    out = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in embedding.near_duplicates(spark.createDataFrame(rows, VECTOR)).collect()))
    assert out == [(-1, 0, -1), (3, 2, 3), (5, 2, 3), (5, 2, 3)]


def test_rows_without_ids(spark):
    rows = spark.createDataFrame([(None, "the house", "en"), (1, "das haus", "de"), (None, None, None)], "doc_id long, text string, lang string")
    assert [r["held_out"] for r in langid.identify(rows).where("doc_id IS NULL").collect()] == [False, False]
    wide = rows.withColumn("source", F.lit(None)).withColumn("n_chars", F.lit(None))
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 5), (1, 1)], "doc_id long, quality int")
    assert quality.classify(wide, labels).count() == 3


def test_no_vectors(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], VECTOR)).collect() == []
    lone = embedding.near_duplicates(spark.createDataFrame([(1, None, None)], VECTOR)).first()
    assert (lone["n_links"], lone["component_id"], lone["kept"]) == (0, 1, True)


def test_languages_by_held_out_rows(documents):
    want = {r["doc_id"]: (r["text"], r["lang"]) for r in documents.collect()}
    right = total = 0
    for r in langid.identify(documents).collect():
        text, lang = want[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if r["held_out"] and lang and len(text or "") > 100 and "a b " not in text and "AAAA" not in text:
            right, total = right + (r["lang_pred"] == lang), total + 1
    assert total > 10 and right >= 0.9 * total


def test_languages_without_examples(documents, no_documents):
    assert langid.identify(no_documents).collect() == []
    out = langid.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}


def test_languages_against_plain_loops(documents):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    want = plain_language.judged(rows)
    for r in langid.identify(documents).collect():
        held, lang, score, _ = want[r["doc_id"]]
        assert (r["held_out"], r["lang_pred"]) == (held, lang) and r["score"] == pytest.approx(score, abs=1e-3)


def test_accepted_documents(documents):
    """Texts that say one or two letters over and over are like no language; without labelled rows all with a letter stay."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    letters = sorted(d for d, t, _ in rows if any(c.isalpha() for c in t or ""))
    odd = {d for d, t, _ in rows if t and len(t) > 100 and len(set(t.lower())) < 4}
    some = sorted(plain_language.accepted(rows))
    assert some == [d for d in letters if d not in odd] and len(odd) == 3
    for docs, want in ((documents, some), (documents.withColumn("lang", F.lit(None).cast("string")), letters)):
        out = langid.accepted(docs)
        assert sorted(r["doc_id"] for r in out.collect()) == want and out.columns == documents.columns


def test_languages_of_awkward_rows(spark, no_documents):
    """Null, empty and very long texts, repeated rows, and columns named as the operator names its own."""
    texts = [(1, "the house and the tree in the wood"), (2, "das haus und der baum im wald"), (3, None), (3, None), (4, ""), (6, "the house " * 200_000), (6, "the house " * 200_000), (None, "der baum")]
    rows = spark.createDataFrame([(d, t, "en" if k in (0, 5, 6) else "de") for k, (d, t) in enumerate(texts)], "doc_id long, text string, lang string")
    wide = rows.select("*", *[F.lit("x").alias(c) for c in ("row", "score", "held_out", "lang_pred", "vector", "k", "x")])
    out = [sorted(map(tuple, langid.identify(d).collect()), key=str) for d in (rows, wide)]
    assert out[0] == out[1] and len(out[0]) == 8
    assert [r[2] for r in out[0] if r[0] in (3, 4)] == ["und"] * 3
    kept = langid.accepted(wide)
    assert kept.columns == wide.columns and langid.accepted(wide.limit(0)).collect() == []


def test_profile_of_a_text_ignores_its_neighbours():
    alone, _ = langid.profiles(["the cat"])
    among, lettered = langid.profiles(["über", "the cat", None, "", "12"])
    assert np.allclose(alone[0], among[1]) and lettered.tolist() == [True, True, False, False, False]


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(2)
    words = "the of and to in house tree walks river stone light".split()
    docs, labels = [], []
    for k in range(400):
        text = " ".join(rng.choice(words, 60))
        good = k % 4 != 0
        text = text if good else [text.upper() + "!!", " ".join(w + "***" for w in text.split()), " | ".join(text.split()), "spam " * 60][k // 4 % 4]
        docs.append((k, text, "en", "a" if good or k % 3 else "b", len(text)))
        if k < 250:
            labels.append((k, int(good)))
    docs.append((400, None, None, None, None))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_unseen_rows(rated):
    docs, labels = rated
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == 401 and all(0 <= r["score"] <= 1 for r in out.values())
    assert sum(out[k]["keep"] == (k % 4 != 0) for k in range(250, 400)) >= 0.95 * 150


def test_quality_without_enough_labels(rated, no_documents):
    docs, labels = rated
    assert quality.classify(no_documents, labels).collect() == []
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    one = quality.classify(docs, labels.where("quality = 1")).collect()
    assert all(r["keep"] for r in one)


@pytest.fixture(scope="module")
def noisy(spark):
    """Texts and sources that each tell the label of a row fairly well, by themselves; 120 of 3000 rows have labels."""
    rng = np.random.default_rng(4)
    docs = []
    for k in range(3000):
        good = int(rng.integers(2))
        words = [f"{'gb'[int(rng.random() < (0.35 if good else 0.65))]}{rng.integers(150)}" for _ in range(12)]
        source = f"{'gb'[int(rng.random() < (0.2 if good else 0.8))]}{rng.integers(12)}"
        docs.append((k, " ".join(words), "en", source, 40, good))
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, y int")
    return rows.repartition(4).cache(), {d[0]: d[5] for d in docs}


def test_views_learn_from_each_other(noisy):
    rows, truth = noisy
    labels = rows.where("doc_id % 25 = 0").selectExpr("doc_id", "y AS quality")
    right = {}
    for rounds in (0, 2):
        out = quality.classify(rows, labels, rounds=rounds).toPandas()
        right[rounds] = [((out[c] >= 0.5).astype(int) == out["doc_id"].map(truth)).mean() for c in ("text_score", "meta_score", "score")]
    assert right[2][2] > max(right[2][:2]) > 0.75
    assert right[2][0] > right[0][0] + 0.02 and right[2][2] > right[0][2]


def plain_score(row, model):
    """One row's scores by loops over its words, trigrams and metadata."""
    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * factor % 2**64
        return x

    def word_bucket(word):
        return (mixed(sum(int(rolling._CODE[b]) * pow(int(rolling._BASE), k, 2**64) for k, b in enumerate(word)) % 2**64) >> 51) % quality.WORDS

    def gram_bucket(a, b, c):
        return ((a * 0x9E3779B1 % 2**32 ^ b * 0x85EBCA77 % 2**32 ^ c * 0xC2B2AE3D % 2**32) >> 19) % quality.GRAMS

    def mean(table, buckets):
        return sum(float(table[b]) for b in buckets) / max(len(buckets), 1)

    def logit(view, means, dense):
        if view.weights is None:
            return view.shift
        return view.slope * (sum(w * x for w, x in zip(view.weights, [*means, *dense, 1.0], strict=True))) + view.shift

    data = (row["text"] or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    cls = [int(quality._CLASS[b]) for b in data]
    pairs = Counter(zip(cls, cls[1:], strict=False))
    dense = [math.sqrt(pairs[a, b] / max(len(data) - 1, 1)) for a in range(16) for b in range(16)]
    n, first, last = len(words), [int(quality._CLASS[w[0]]) for w in words], [int(quality._CLASS[w[-1]]) for w in words]
    dense += [
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n, 1), math.log1p(len(set(words))) / math.log1p(max(n, 1)), math.log1p(n) / 10,
        sum(map(len, words)) / max(n, 1) / 10, sum(len(w) == 1 for w in words) / max(n, 1), sum(c == 1 for c in first) / max(n, 1), sum(c >= 6 for c in last) / max(n, 1),
    ]
    tables = model.text.tables or [np.zeros(1)] * 2
    text = logit(model.text, [mean(tables[0], [word_bucket(w) for w in words]), mean(tables[1], [gram_bucket(*g) for g in zip(data, data[1:], data[2:], strict=False)])], dense)
    size = None if row["n_chars"] is None else math.log1p(max(row["n_chars"], 0))
    kinds = [row["source"], row["lang"], (row["source"], row["lang"]), None if size is None else int(2 * size)]
    tables = model.meta.tables or [np.zeros(quality.META)] * 4
    meta = logit(model.meta, [float(t[zlib.crc32(repr(k).encode()) % quality.META]) for t, k in zip(tables, kinds, strict=True)], [(size or 0) / 10, ((size or 0) / 10) ** 2, float(size is None)])
    return [1 / (1 + math.exp(-min(max(v, -30), 30))) for v in (text, meta, text + meta - model.prior)]


def test_scores_against_plain_loops(rated):
    docs, labels = rated
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    for row in docs.collect():
        want = plain_score(row, model)
        out = got[row["doc_id"]]
        assert [out["text_score"], out["meta_score"], out["score"]] == pytest.approx(want, abs=1e-4)
        assert out["keep"] == (out["score"] >= 0.5)


def test_counts_against_plain_loops(spark, rated):
    """What naive Bayes learns: each row gives each kind of feature the weight 1 in all, whatever its length and the batches."""
    docs, labels = rated
    chosen = dict(quality.sample_labels(labels, 100))
    assert len(chosen) == 100 and quality.sample_labels(labels, 100) == quality.sample_labels(labels.repartition(7), 100)
    some = docs.where(F.col("doc_id").isin(list(chosen)))
    ids = {d: y for d, y in chosen.items()}

    def emit(batch):
        y = np.array([ids[d] for d in batch.column("doc_id").to_pylist()])
        return quality._joined(batch, (y, y), quality._views(batch))

    sums = quality._sums(quality._columns(some), emit)
    for v in (0, 1):
        for y in (0, 1):
            rows = sum(k == y for k in chosen.values())
            at = 0
            for size in quality.KINDS[v]:
                assert sums[v, y][at : at + size].sum() == pytest.approx(rows)
                at += size
    source = Counter((ids[r["doc_id"]], r["source"]) for r in some.collect())
    for (y, name), n in source.items():
        assert sums[1, y][zlib.crc32(repr(name).encode()) % quality.META] == pytest.approx(n)


def test_quality_of_awkward_rows(rated):
    """Clashing columns, a very long text, repeated rows, and labels of no document."""
    docs, labels = rated
    long = docs.sparkSession.createDataFrame([(900, "word " * 200_000, None, None, None), (7, None, "en", "a", 0), (7, None, "en", "a", 0)], docs.schema)
    rows = docs.union(long)
    wide = rows.select("*", *[F.lit("x").alias(c) for c in ("y", "part", "score", "keep", "h", "k", "meta")])
    lost = labels.union(labels.selectExpr("doc_id + 10000 AS doc_id", "quality"))
    out = quality.classify(wide, labels)
    assert sorted(map(str, out.collect())) == sorted(map(str, quality.classify(rows, labels).collect())) and out.count() == 404
    assert quality.classify(rows, lost).count() == 404


ARTICLE = "The cat sat on the mat and it was not in the house of the man who was there with us on that day. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""),
        (f"<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>{ARTICLE}<p>Short.\n  one</article><footer>f</footer>", f"A & B\n\n{ARTICLE.strip()}\n\nShort. one"),
        ("<article><p>Be.</p><p>So.</p></article><div class=ad>Buy the thing that is for you and not for the others in the house now, it is good</div>", "Be.\n\nSo."),
        (f"<article><p>{ARTICLE}</p><aside><p>{ARTICLE}</p></aside><form>The name of the man</form><div class='comment-list'><p>{ARTICLE}</p></div></article>", ARTICLE.strip()),
        (f"<div><p>Menu</p><p>{ARTICLE}</p><p>Tail of it.</p><div id=sidebar><p>{ARTICLE}</p></div></div>", f"Menu\n\n{ARTICLE.strip()}\n\nTail of it."),
        (f"<script>var a='<article><p>no</p></article>'</script><style>p{{}}</style><main><p>{ARTICLE}</p><ul><li><a href=a>link one</a><li><a href=b>link two</a></ul></main>", ARTICLE.strip()),
        (f'<article><p title="a>b">{ARTICLE}</p><!-- <p>gone</p> --><p>x&nbsp;&eacute;&#233;<br>y</p></article>', f"{ARTICLE.strip()}\n\nx éé y"),
        (f"<article><p>{ARTICLE}", ARTICLE.strip()),
        (f"<article><p><span class=ad>Buy now</span>{ARTICLE}<span class='promo'>Only today</span></p><p class=notice>{ARTICLE}</p></article>", ARTICLE.strip()),
        (f"<div id=header>{ARTICLE}</div><article><div class=entry-header><h1>Head</h1></div><p>{ARTICLE}</p></article><section id=comments><article class=comment><p>{ARTICLE}</p></article></section>", f"Head\n\n{ARTICLE.strip()}"),
        (f"<article><header><h1>Head</h1><p>By the man of the house and of the paper, on the day that it was</p></header><p>{ARTICLE}</p></article>", f"Head\n\n{ARTICLE.strip()}"),
        (f"<div role=banner>The name of the site and all that is in it for you to see</div><p>{ARTICLE}</p><p>&copy; 2020 the company and all of its parts</p>", ARTICLE.strip()),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_long_and_broken_pages():
    assert html.main_text("<article>" + f"<p>{ARTICLE}</p>" * 5000).count("\n\n") == 4999
    for page in ("<" * 5000, "<a" * 5000, "<p " + '"' * 5001, "<div>" * 5000 + "x", "<script>" * 100, "</p>" * 1000, "<!--" * 1000):
        assert isinstance(html.main_text(page), str)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, None, f"<article><p>{ARTICLE}</p></article>", 6), (2, None, "", 7)], "page_id long, url string, html string, text int")
    out = sorted(html.extract(pages).collect(), key=lambda r: (r["page_id"], r["n_chars"]))
    assert [r["n_chars"] for r in out] == [0, 0, len(ARTICLE.strip())]
    assert html.extract(pages.limit(0)).collect() == []


def pairs_at(rng, n, dim, cosine):
    a, b = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [1, 2, 7, 64, 300])
def test_estimates_are_unbiased_and_bounded(dim):
    rng = np.random.default_rng(dim)
    x = np.concatenate(pairs_at(rng, 300, dim, 0.9301)) if dim > 1 else rng.choice([-1.0, 1.0], (600, 1))
    keys = embedding._keys(x, 4, 3)
    codes = embedding.Codes(embedding.encode(x, keys), dim, 3)
    every = np.arange(600)
    error = codes.estimate(every, every) - x @ x.T
    assert abs(error.mean()) < 2e-3
    assert (np.abs(error) <= codes.slack[:, None] + codes.length[:, None] * codes.rest + 1e-3).mean() > 0.9999
    open_pairs = {p for i, j in codes.open(every, every, 0, 0.93) for p in zip(i.tolist(), j.tolist(), strict=True)}
    links = {tuple(p) for p in np.argwhere(np.triu(x @ x.T >= 0.93, 1)).tolist()}
    assert links <= open_pairs
    later = {p for i, j in codes.open(every, every, 3, 0.93) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert later == {(i, j) for i, j in open_pairs if (keys[i] != keys[j]).all()}


def test_recall_just_above_the_threshold(spark):
    a, b = pairs_at(np.random.default_rng(9), 1500, 64, 0.9301)
    rows = [(2 * k + s, v[k].tolist(), 0) for k in range(1500) for s, v in enumerate((a, b))]
    out = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert out.where("n_links > 0").count() >= 0.997 * 3000


def test_vectors_with_one_id_are_told_apart(spark):
    rows = [(5, [1.0, 0.0, 0.0], 0), (5, [0.0, 1.0, 0.0], 0), (7, [0.0, 2.0, 0.1], 0), (9, [5.0, 0.1, 0.0], 0), (9, [1.0, 0.0, 0.0], 1), (11, [0.0, 0.0, 1.0], 0)]
    wide = spark.createDataFrame(rows, VECTOR).select("*", *[F.lit("x").alias(c) for c in ("at", "digest", "code", "hot", "c", "u", "component_id", "keys", "dim")])
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding.near_duplicates(wide).collect())
    assert out == [(5, 1, 5), (5, 1, 5), (7, 1, 5), (9, 0, 9), (9, 1, 5), (11, 0, 11)]
