"""Queries that take the whole of a cluster, against plain loops over small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import corpus, graph, links
from lectern.plans import registry, retrieval, similarity

TERM = re.compile(r"\w{2,}")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three clusters: 140 sentences of which half score, one whose query shares no term, one without a query."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    text = lambda n, more="": " ".join(f"{' '.join(rng.choice(words, 5))} {more if k % 2 else 'other'}." for k in range(n))
    docs = [(d, text(10, "asked"), "en", "src0", 1) for d in range(14)]
    docs += [(20 + d, text(4), "en", "src1", 1) for d in range(3)] + [(30 + d, text(3), "en", "src77", 1) for d in range(2)]
    docs += [(40, "!? !? lonely words.", "en", "src1", 1)]
    to = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(0, "asked w1 w2"), (1, "nothing shared")], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to)


def clusters(spark, folder):
    out = defaultdict(list)
    for r in sorted(retrieval.english_sentences(spark, folder).collect(), key=lambda r: (r["cid"], r["doc_id"], r["sent_idx"])):
        out[r["cid"]].append(((r["doc_id"], r["sent_idx"]), Counter(TERM.findall(r["sent"]))))
    return out


def by_documents(rows):
    """The cosines of all sentences, document frequencies counted over the cluster's documents; the diagonal is 0."""
    docs = {k[0] for k, _ in rows}
    df = Counter(t for _, t in {(k[0], t) for k, c in rows for t in c})
    unit = []
    for _, c in rows:
        raw = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        unit.append({t: x / norm for t, x in raw.items()})
    return np.array([[0.0 if i == j else sum(x * b.get(t, 0) for t, x in a.items()) for j, b in enumerate(unit)] for i, a in enumerate(unit)])


def test_lexrank_ranks_all_sentences(spark, folder):
    got = defaultdict(dict)
    for r in registry.QUERIES["lexrank_baseline"](spark, folder).collect():
        got[r["cid"]][r["i"]] = (r["score"], r["rank"])
    want = clusters(spark, folder)
    assert {c: len(x) for c, x in got.items()} == {c: len(x) for c, x in want.items()} and len(got["src0"]) == 140
    for cid, rows in want.items():
        m = by_documents(rows)
        n, total = len(rows), m.sum(axis=1, keepdims=True)
        m = np.where(total > 0, m / np.where(total > 0, total, 1), 1 / n)
        p = np.full(n, 1 / n)
        for _ in range(graph.STEPS):
            p = 0.85 * p @ m + 0.15 / n
        assert [got[cid][i][0] for i in range(n)] == pytest.approx(p.tolist(), abs=1e-11)
        order = sorted(range(n), key=lambda i: (-round(p[i] * n, 9), i))
        assert [got[cid][i][1] for i in order] == list(range(1, n + 1))


def test_lexrank_of_small_clusters_takes_no_job_a_step(spark, folder):
    spark.sparkContext.setJobGroup("lexrank", "")
    registry.QUERIES["lexrank_baseline"](spark, folder).collect()
    spark.sparkContext.setJobGroup("other", "")
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("lexrank")) < graph.STEPS


def test_lexrank_of_large_clusters_is_the_same(spark, folder):
    docs = corpus.documents(spark, folder)
    small, mixed, large = ({(r["cid"], r["i"]): (r["rank"], r["score"]) for r in similarity.lexrank(docs, those).collect()} for those in ([], ["src0"], ["src0", "src1", "src77"]))
    assert small.keys() == mixed.keys() == large.keys() and len(small) > 150
    for other in (mixed, large):
        assert all(other[k][0] == r and other[k][1] == pytest.approx(x, abs=1e-12) for k, (r, x) in small.items())


def test_document_frequencies_of_all_sentences(spark, folder):
    got = {(r["cid"], (r["i_doc"], r["i_sent"]), (r["j_doc"], r["j_sent"])): r["w"] for r in similarity.doc_level_pairs(spark, folder).collect()}
    want = {}
    for cid, rows in clusters(spark, folder).items():
        m = by_documents(rows)
        want |= {(cid, rows[i][0], rows[j][0]): m[i, j] for i, j in zip(*np.nonzero(m), strict=True)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_links_of_all_sentences(spark, folder):
    got = {(r["cid"], (r["doc_id"], r["sent_idx"])): r for r in registry.QUERIES["doc_level_idf_edges"](spark, folder).collect()}
    want = clusters(spark, folder)
    assert len(got) == sum(map(len, want.values()))  # a row a sentence, with or without links
    for cid, rows in want.items():
        m = by_documents(rows)
        for i, (key, bag) in enumerate(rows):
            r = got[cid, key]
            assert r["n_links"] == np.count_nonzero(m[i]) and r["w"] == pytest.approx(m[i].sum(), abs=2e-6)
            assert (r["c_doc"], r["c_sent"]) == next(k for k, other in rows if other == bag)
    assert min(r["n_links"] for r in got.values()) == 0


def test_links_of_odd_documents(spark):
    docs = [(1, "Aa bb. Bb cc! ?", "a"), (None, "cc cc dd", "a"), (2, None, "a"), (3, "aa bb", "a"), (4, "aa bb", None), (5, "zz zz. ! a", "b"), (6, "", "c")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, cid string").select("cid", "doc_id", "text")
    of = lambda d: [tuple(r)[:6] for r in links.linked(d, F.transform(corpus.sentence_texts(F.col("text")), T.terms)).collect()]
    a, b = [("a", 1, 0, 1, 0, 2), ("a", 1, 1, 1, 1, 3), ("a", 1, 2, 1, 2, 0), ("a", None, 0, None, 0, 1), ("a", 3, 0, 1, 0, 2)], [("b", 5, 0, 5, 0, 0), ("b", 5, 1, 5, 1, 0), ("b", 5, 2, 5, 1, 0)]
    assert sorted(of(docs), key=str) == sorted(a + b, key=str) and of(docs.limit(0)) == []


def test_chunks_cut_and_join():
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.list_(pa.int64())))], names=["s"]) for x in ([[[1]] * 3, None, [[2]] * 9, [[3], []]], [[[4]]] * 5, [[]])]
    for most in (1, 3, 4, 100):
        got = [t["s"].to_pylist() for t in links._chunks(iter(batches), most)]
        assert sum(got, []) == sum((b.column("s").to_pylist() for b in batches), [])
        opened = [links._opened(t.append_column("cid", pa.array(["a"] * len(t)))) for t in links._chunks(iter(batches), most)]
        assert [h for o in opened for h in o[5]] == [1, 1, 1, *[2] * 9, 3, *[4] * 5]
        assert all(len(x) == 1 or sum(len(d or []) for d in x) <= most for x in got)
    assert len(got) == 1


def test_reach_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(40):
        monkeypatch.setattr(links, "RARE", int(rng.choice([2, 5, 1000])))
        monkeypatch.setattr(links, "DENSE", int(rng.choice([0, 2, 1024])))
        monkeypatch.setattr(links, "AT_ONCE", int(rng.choice([1, 10, 2000])))
        sets = lambda n: [sorted({int(40 * x**3) for x in rng.random(rng.integers(0, 9))}) for _ in range(n)]
        a, b = sets(int(rng.integers(1, 70))), sets(int(rng.integers(1, 70)))
        weight = rng.integers(1, rng.choice([2, 9, 100_000]), len(b))
        flat = lambda those: (np.cumsum([0] + [len(x) for x in those]), np.array([c for x in those for c in x], np.int32))
        assert links.reach(*flat(a), *flat(b), weight).tolist() == [sum(int(w) for y, w in zip(b, weight, strict=True) if {*x} & {*y}) for x in a]


def test_graph_nodes_reach_the_bound(spark, folder):
    best = sum("asked" in r["sent"] or {"w1", "w2"} & set(TERM.findall(r["sent"])) != set() for r in retrieval.english_sentences(spark, folder).where("cid = 'src0'").collect())
    rows = registry.QUERIES["graph_nodes"](spark, folder).where("cid = 'src0'").collect()
    assert len(rows) == min(best, retrieval.TOP_K) > 30


def test_weights_of_all_sentences(spark, folder):
    got = {(r["cid"], (r["doc_id"], r["sent_idx"]), r["term"]): r["w"] for r in registry.QUERIES["tfidf_weights"](spark, folder).collect()}
    queries, want = {"src0": {"asked", "w1", "w2"}, "src1": {"nothing", "shared"}}, {}
    for cid, rows in clusters(spark, folder).items():
        every = [set(c) for _, c in rows] + [queries[cid] for _ in "x" if cid in queries]
        df = Counter(t for x in every for t in x)
        for key, c in rows:
            raw = {t: n * (math.log((1 + len(every)) / (1 + df[t])) + 1) for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            want |= {(cid, key, t): x / norm for t, x in raw.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_scaling_of_all_sentences(spark, folder):
    scores = {(r["cid"], r["doc_id"], r["sent_idx"]): r["score"] for r in retrieval.scored(spark, folder).collect()}
    own = lambda k: [x for c, x in scores.items() if c[0] == k[0]]
    soft = {(r["cid"], r["doc_id"], r["sent_idx"]): r["score"] for r in registry.QUERIES["softmax_scores"](spark, folder).collect()}
    assert soft == {k: pytest.approx(math.exp(x) / sum(map(math.exp, own(k))), abs=1e-6) for k, x in scores.items()}
    flat = {(r["cid"], r["doc_id"], r["sent_idx"]): r["score"] for r in registry.QUERIES["minmax_scores"](spark, folder).collect()}
    assert flat == {k: pytest.approx(x / max(own(k)) if max(own(k)) else 0.0, abs=1e-6) for k, x in scores.items()}


def test_masks_of_all_documents(spark, folder):
    got = {(r["cid"], r["doc_id"]): r["mask"] for r in registry.QUERIES["length_masks"](spark, folder).collect()}
    sizes = Counter((cid, k[0]) for cid, rows in clusters(spark, folder).items() for k, _ in rows)
    assert got == {k: ("1" * min(n, 20)).ljust(20, "0") for k, n in sizes.items()} and len(got) == 20


def test_pairs_of_all_ranked_sentences(spark, folder):
    ranked = {r["rank"]: Counter(r["sent"].split()) for r in registry.QUERIES["rank_records"](spark, folder).where("cid = 'src0'").collect()}
    norm = lambda c: math.sqrt(sum(n * n for n in c.values()))
    want = {(i, j): sum(n * b[t] for t, n in a.items()) / norm(a) / norm(b) for i, a in ranked.items() for j, b in ranked.items() if i < j}
    got = {(r["i"], r["j"]): r["cosine"] for r in registry.QUERIES["bow_cosine_pairs"](spark, folder).where("cid = 'src0'").collect()}
    assert len(want) > 45 and got == {k: pytest.approx(x, abs=1e-6) for k, x in want.items()}
