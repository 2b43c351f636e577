"""Centrality, diverse ranking, selection and evaluation against plain versions."""

from collections import Counter

import numpy as np
import pytest

from lectern.functions import text as T
from lectern.operators import evaluate, graph, summarize


def random_graph(spark, n=12, seed=0):
    rng = np.random.default_rng(seed)
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.5), 1)
    w = w + w.T
    w[3, :] = w[:, 3] = 0
    rel = rng.random(n)
    rel /= rel.sum()
    nodes = spark.createDataFrame([("c", k, float(rel[k])) for k in range(n)] + [("lone", 0, 1.0)], "cid string, i int, rel double")
    edges = spark.createDataFrame([("c", i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "cid string, i int, j int, w double")
    return nodes, edges, w, rel


def transition(w):
    total = w.sum(axis=1, keepdims=True)
    return np.divide(w, total, out=np.zeros_like(w), where=total > 0)


@pytest.mark.parametrize("damp", [0.85, 0.5, 1.0])
def test_walk(spark, damp):
    nodes, edges, w, rel = random_graph(spark)
    rel = rel if damp < 1 else np.full(len(rel), 1 / len(rel))
    d = damp if damp < 1 else 0.85
    m = transition(w)
    m[m.sum(axis=1) == 0] = rel
    p = rel.copy()
    for _ in range(graph.STEPS):
        p = d * p @ m + (1 - d) * rel
    out = {(r["cid"], r["i"]): r["score"] for r in graph.markov(nodes, edges, damp).collect()}
    assert [out["c", k] for k in range(len(rel))] == pytest.approx(p.tolist())
    assert out["lone", 0] == pytest.approx(1.0)


@pytest.mark.parametrize("omega", [0, 4, 10])
def test_diverse_ranking(spark, omega):
    nodes, edges, w, rel = random_graph(spark, seed=1)
    scored = nodes.withColumnRenamed("rel", "score")
    m = transition(w)
    left, order = {k: s for k, s in enumerate(rel)}, []
    while left:
        k = max(left, key=lambda x: (round(left[x], 9), -x))
        order.append((k, left.pop(k)))
        for j in left:
            left[j] -= omega * m[j, k] * rel[k]
    out = sorted((r for r in graph.diversity_rank(scored, edges, omega).collect() if r["cid"] == "c"), key=lambda r: r["rank"])
    assert [r["i"] for r in out] == [k for k, _ in order]
    assert [r["score"] for r in out] == pytest.approx([s for _, s in order])


def test_negative_penalty(spark):
    nodes, edges, _, _ = random_graph(spark)
    with pytest.raises(ValueError, match="negative"):
        graph.diversity_rank(nodes.withColumnRenamed("rel", "score"), edges, -1)


def test_relevance_without_scores(spark):
    rows = spark.createDataFrame([("c", 1, 0, 0.0), ("c", 1, 1, 0.0), ("d", 1, 0, 3.0), ("d", 2, 0, 1.0)], "cid string, doc_id long, sent_idx int, score double")
    out = {(r["cid"], r["i"]): r["rel"] for r in graph.nodes(rows).collect()}
    assert out == {("c", 0): 0.5, ("c", 1): 0.5, ("d", 0): 0.75, ("d", 1): 0.25}


def ranking(spark, sents):
    return spark.createDataFrame([("c", k + 1, s, s) for k, s in enumerate(sents)], "cid string, rank int, orig string, sent string")


def test_selection_crosses_the_budget(spark):
    rows = ranking(spark, ["a b c", "d e f", "g h i"])
    assert [r["rank"] for r in summarize.select(rows, 5, 1.0).collect()] == [1, 2]
    assert [r["rank"] for r in summarize.select(rows, 5, 0.99).collect()] == [1, 2]


def test_selection_skips_what_is_alike(spark):
    rng = np.random.default_rng(3)
    sents = [" ".join(rng.choice(list("abcdefg"), 6)) for _ in range(30)]
    chosen, used = [], 0
    for s in sents:
        if used >= 40:
            break
        if all(summarize.bow_cosine(Counter(s.split()), Counter(c.split())) < 0.6 for c in chosen):
            chosen.append(s)
            used += 6
    out = sorted(summarize.select(ranking(spark, sents), 40, 0.6).collect(), key=lambda r: r["pos"])
    assert [r["orig"] for r in out] == chosen
    text = summarize.text_of(summarize.select(ranking(spark, sents), 40, 0.6)).first()["summary"]
    assert text == "\n".join(chosen)


def test_lead(spark):
    rows = spark.createDataFrame([("c", d, k, "x") for d in range(4) for k in range(30)], "cid string, doc_id long, sent_idx int, orig string")
    assert {r["doc_id"] for r in summarize.lead(rows).collect()} == {0, 1}


def counted(text, metric):
    ws = text.lower().split()
    if metric == "rouge1":
        return Counter(ws)
    if metric == "rouge2":
        return Counter(zip(ws, ws[1:], strict=False))
    return Counter(ws) + Counter((a, ws[j]) for i, a in enumerate(ws) for j in range(i + 1, min(len(ws), i + 6)))


@pytest.mark.parametrize("metric", evaluate.METRICS)
def test_overlap(spark, metric):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcde"), n)) for n in (12, 9, 15, 1)]
    candidate = spark.createDataFrame([("c", texts[0])], "cid string, text string")
    refs = spark.createDataFrame([("c", k, t) for k, t in enumerate(texts[1:])], "cid string, ref_idx int, text string")
    want = []
    for t in texts[1:]:
        a, b = counted(texts[0], metric), counted(t, metric)
        hit = sum((a & b).values())
        r, p = (hit / sum(b.values()) if b else 0), hit / sum(a.values())
        want.append((r, p, 2 * r * p / (r + p) if r + p else 0))
    out = evaluate.scores(candidate, refs, metric).first()
    assert (out["recall"], out["precision"], out["f1"]) == pytest.approx(tuple(np.mean(want, axis=0)))


def test_overlap_of_equal_texts_and_cuts(spark):
    one = spark.createDataFrame([("c", "The cats sat down")], "cid string, text string")
    refs = spark.createDataFrame([("c", 1, "the cat sat"), ("c", 2, "the cats sat down")], "cid string, ref_idx int, text string")
    assert evaluate.scores(one, refs.where("ref_idx = 2"), "rougeSU4").first()["f1"] == pytest.approx(1.0)
    assert evaluate.scores(one, refs.where("ref_idx = 1"), "rouge1", 3, stem=True).first()["f1"] == pytest.approx(1.0)
    both = evaluate.leave_one_out(refs, "rouge1").first()
    assert both["recall"] == pytest.approx((2 / 4 + 2 / 3) / 2)
    assert T.SPACE
