"""Rankings, filters and their edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import ensemble, passages, rank, scoring

SCHEMA = "cid string, doc_id long, sent_idx int, sent string, score double"


def table(spark, scores, cid="c", sents=None):
    return spark.createDataFrame([(cid, k // 3, k % 3, sents[k] if sents else f"s{k}", float(s)) for k, s in enumerate(scores)], SCHEMA)


def kept(rows):
    return [r["doc_id"] * 3 + r["sent_idx"] for r in sorted(rows.collect(), key=lambda r: r["rank"])]


def by_hand(scores, conf, least=None):
    """The filter as a loop."""
    order = sorted(range(len(scores)), key=lambda k: (-round(scores[k], 9), k))
    total, out, share = sum(scores), [], 0.0
    for k in order:
        if total and round(share, 9) >= conf and len(out) >= (least or 0):
            break
        out.append(k)
        share += scores[k] / total if total else 0
    return out


@pytest.mark.parametrize(("conf", "least", "want"), [(0.75, None, [0, 1]), (0.75, 3, [0, 1, 2]), (0.5, None, [0]), (1.0, None, [0, 1, 2, 3])])
def test_confidence(spark, conf, least, want):
    assert kept(rank.by_confidence(table(spark, [5, 3, 1, 1]), conf, min_rows=least)) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9]), min_size=1, max_size=30), st.sampled_from([0.05, 0.5, 0.75, 0.95]))
def test_confidence_is_the_loop(spark, scores, conf):
    live = [s for s in scores if s > 0]
    if live:
        found = kept(rank.by_confidence(rank.prune(table(spark, scores)), conf))
        index = [k for k, s in enumerate(scores) if s > 0]
        assert found == [index[k] for k in by_hand(live, conf)]


def test_larger_confidence_keeps_more(spark):
    rows = table(spark, [0.9, 0.5, 0.5, 0.2, 0.1, 0.1, 0.05])
    last = set()
    for conf in (0.2, 0.4, 0.6, 0.8, 1.0):
        now = set(kept(rank.retrieve(rows, "conf", conf)))
        assert last <= now
        last = now


def test_zero_best_passes_whole(spark):
    rows = table(spark, [0, 0, 0]).union(table(spark, [1, 0, 3], "d"))
    assert rank.retrieve(rows, "topK", 1).groupBy("cid").count().sort("cid").collect()[0]["count"] == 3
    assert kept(rank.retrieve(rows, "topK", 1).where("cid = 'd'")) == [2]
    assert kept(rank.retrieve(rows, "conf", 0.9).where("cid = 'c'")) == [0, 1, 2]
    assert kept(rank.retrieve(rows, "conf", 0.9).where("cid = 'd'")) == [2, 0]
    with pytest.raises(ValueError, match="filter"):
        rank.retrieve(rows, "best", 1)


def test_prune_and_ties(spark):
    assert rank.prune(table(spark, [0.5, 1e-11])).count() == 1
    assert kept(rank.ranked(table(spark, [1, 2, 2, 1]))) == [1, 2, 0, 3]
    assert kept(rank.reverse_ranked(table(spark, [1, 2, 2, 1]))) == [2, 1, 3, 0]


def test_ranks_over_many_slices(spark):
    rows = spark.range(6000).select(F.lit("c").alias("cid"), F.col("id").alias("doc_id"), F.lit(0).alias("sent_idx"), (F.col("id") % 700 / 700.0 * F.when(F.col("id") % 2 == 0, 1).otherwise(0)).alias("score"))
    out = rank.ranked(rows).toPandas().sort_values("rank")
    assert out["rank"].tolist() == list(range(1, 6001))
    want = out.sort_values(["score", "doc_id"], ascending=[False, True])
    assert want["doc_id"].tolist() == out["doc_id"].tolist()
    assert (abs(out["cum"] - out["score"].cumsum()) < 1e-6).all()


def test_reversed_ranks_over_many_slices(spark):
    score = F.when(F.col("id") % 5 == 0, float("-inf")).when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") % 300 / 300.0)
    rows = spark.range(6000).select(F.lit("c").alias("cid"), F.col("id").alias("doc_id"), F.lit(0).alias("sent_idx"), score.alias("score"))
    out = rank.reverse_ranked(rows).toPandas().sort_values("rank")
    assert out["rank"].tolist() == list(range(1, 6001))
    assert out["doc_id"].tolist() == out.sort_values(["score", "doc_id"], ascending=[False, False])["doc_id"].tolist()


def test_small_scores_rank_above_zeros_of_all_documents(spark):
    small = F.when(F.col("id") == 5, 1e-4).when(F.col("id") == 1500, -1e-4).when(F.col("id") == 7, 1e300).when(F.col("id") == 2500, float("inf")).otherwise(0.0)
    rows = spark.range(-1500, 3000).select(F.lit("c").alias("cid"), F.col("id").alias("doc_id"), F.lit(0).alias("sent_idx"), small.alias("score"))
    for ranks, ascending in ((rank.reverse_ranked, False), (rank.ranked, True)):
        out = ranks(rows).toPandas().sort_values("rank")
        assert out["rank"].tolist() == list(range(1, 4501))
        assert out["doc_id"].tolist() == out.sort_values(["score", "doc_id"], ascending=[False, ascending])["doc_id"].tolist()


def test_deduplicate(spark):
    rows = table(spark, [1, 3, 3, 2], sents=["a", "a", "b", "b"])
    out = rank.deduplicate(rows)
    assert sorted((r["sent"], r["doc_id"], r["sent_idx"], r["score"]) for r in out.collect()) == [("a", 0, 1, 3.0), ("b", 0, 2, 3.0)]
    assert sorted(map(str, rank.deduplicate(out).collect())) == sorted(map(str, out.collect()))


def test_constant_scores_scale_to_zero(spark):
    assert [r["score"] for r in rank.scaled(table(spark, [2, 2, 2])).collect()] == [0.0] * 3


def test_sweep_is_each_filter(spark):
    rows = table(spark, [5, 3, 1, 1, 0.5])
    out = rank.sweep(rows, "conf", [0.5, 0.75, 1.0], "conf").toPandas()
    for conf in (0.5, 0.75, 1.0):
        assert (out["conf"] == conf).sum() == len(kept(rank.by_confidence(rows, conf)))


@pytest.mark.parametrize(("n", "want"), [(4, 0), (5, 1), (8, 1), (9, 2), (0, 0)])
def test_passages(spark, n, want):
    rows = spark.createDataFrame([("c", 1, k, f"o{k}", f"s{k}") for k in range(n)], "cid string, doc_id long, sent_idx int, orig string, sent string")
    out = passages.sliding(rows).collect()
    assert len(out) == want and (not out or len(out[-1]["sents"]) <= 8)
    if want:
        assert {s["sent_idx"] for r in out for s in r["sents"]} == set(range(n))


def test_span_scores(spark):
    import math

    rows = spark.createDataFrame(
        [("c", 0, [0.0, 1.0, 2.0], [0.0, 1.0, 2.0], [(0, 3), (0, -1)]), ("c", 1, [0.0, 5.0], [5.0, 0.0], [(0, 2)])],
        "cid string, pid int, start_logits array<double>, end_logits array<double>, spans array<struct<s:int,e:int>>",
    )
    out = {(r["pid"], r["span_idx"]): r["score"] for r in ensemble.span_scores(rows).collect()}
    assert out == {(0, 0): pytest.approx(math.exp(4)), (1, 0): pytest.approx(math.exp(5))}
    bad = spark.createDataFrame([("c", 0, [0.0], [0.0], [(0, 2)])], rows.schema)
    with pytest.raises(Exception, match="beyond"):
        ensemble.span_scores(bad).collect()


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        ("sqrt", {"both": 0.6, "s": 0.5, "p": 0.7, "none": 0.0}), ("avg", {"both": 0.65, "s": 0.5, "p": 0.7, "none": 0.0}),
        ("sqrt_global", {"both": 0.6, "s": 0.0005, "p": 0.0007, "none": 0.0}), ("avg_global", {"both": 0.65, "s": 0.25, "p": 0.35, "none": 0.0}),
        ("weight_avg_sent_only", {"both": 0.9 * 0.75 + 0.4 * 0.25, "s": 0.375, "none": 0.0}),
    ],
)
def test_ensembles(spark, mode, want):
    s = spark.createDataFrame([("c", "both", 0.9), ("c", "s", 0.5), ("c", "zero", 0.0), ("c", "none", 0.0)], "cid string, sent string, score double")
    p = spark.createDataFrame([("c", "both", 0.4), ("c", "p", 0.7), ("c", "none", 0.0)], "cid string, sent string, score double")
    out = {r["sent"]: r["score"] for r in ensemble.combine(s, p, mode, 0.25).collect()}
    assert out == {k: pytest.approx(v) for k, v in want.items()}


def test_records_check_the_range(spark):
    rows = spark.createDataFrame([("c", "a", 1.5)], "cid string, sent string, score double")
    with pytest.raises(Exception, match="outside"):
        ensemble.scorer_records(rows).collect()
    with pytest.raises(ValueError, match="mode"):
        ensemble.combine(rows, rows, "weight_avg")


def test_scores_without_terms(spark):
    sents = spark.createDataFrame([("c", 1, 0, "a b"), ("c", 1, 1, "Dogs dogs run"), ("c", 1, 2, "cats")], "cid string, doc_id long, sent_idx int, sent string")
    queries = spark.createDataFrame([("c", "dogs and DOGS run")], "cid string, query string")
    out = {r["sent_idx"]: r["score"] for r in scoring.tf_relevance(sents, queries).collect()}
    assert out == {0: 0.0, 1: pytest.approx((2 * 2 + 1) / (5**0.5 * 6**0.5)), 2: 0.0}
    count = {r["sent_idx"]: r["score"] for r in scoring.count_relevance(sents, queries).collect()}
    assert count == {0: 0.0, 1: 5.0, 2: 0.0}
    pooled = scoring.pooled(spark.createDataFrame([("c", 1, 0.2), ("c", 1, 0.4)], "cid string, k int, score double"), ["cid", "k"], "avg").first()
    assert pooled["score"] == pytest.approx(0.3)
    with pytest.raises(ValueError, match="pooling"):
        scoring.pooled(sents, ["cid"], "sum")
