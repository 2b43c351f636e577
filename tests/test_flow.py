"""The whole system, the stream, and the registry."""

import duckdb
import pytest

import __spark_entry__
from lectern.operators import corpus, graph
from lectern.plans import flow, registry
from lectern.streaming import retrieval as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["cid", "doc_id", "sent_idx", "score", "rank"] and rows.count() > 0


def plain(value):
    if value is None or value != value:
        return None
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted((tuple(map(plain, r)) for r in t[columns].astype(object).values.tolist()), key=repr) for t in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_oracle(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def tables(spark):
    return corpus.documents(spark, SF), corpus.cluster_queries(spark, SF), corpus.references(spark, SF)


def test_run_and_judge(spark, tables):
    docs, queries, references = tables
    p = flow.Parameters(answering=flow.Answering(passage_scorer="tf", weight=0.3), summary=flow.Summary(budget=100))
    summaries = flow.run(docs, queries, p).cache()
    assert 0 < summaries.count() <= 20
    out = flow.judge(summaries, references, stem=False).toPandas()
    assert set(out["metric"]) == {"rouge1", "rouge2", "rougeSU4"} and out["f1"].between(0, 100).all()


def test_tune(spark, tables):
    p = flow.Parameters(answering=flow.Answering(k=20), summary=flow.Summary(budget=60))
    out = flow.tune_omega(*tables, [0, 4], p).collect()
    assert [r["omega"] for r in out] == [0.0, 4.0] and all(r["f1"] >= 0 for r in out)


def test_penalties_are_each_flow(spark, tables):
    """One graph for all penalties gives what the flow gives for each."""
    from pyspark.sql import functions as F

    from lectern.operators import evaluate

    docs, queries, references = tables
    p = flow.Parameters(answering=flow.Answering(k=20), summary=flow.Summary(budget=60))
    found = {r["omega"]: r for r in flow.tune_omega(docs, queries, references, [0, 3], p).collect()}
    for omega in (0, 3):
        one = flow.run(docs, queries, flow.Parameters(answering=p.answering, summary=flow.Summary(budget=60, omega=omega)))
        want = evaluate.scores(one.select("cid", F.col("summary").alias("text")), references, "rouge2").agg(F.avg("recall"), F.avg("f1")).first()
        assert (found[omega]["recall"], found[omega]["f1"]) == pytest.approx(tuple(want))


def test_stems_of_documents(spark):
    """Stems are those of each word; rows with one id stay rows of their own."""
    from lectern.functions import porter

    rows = spark.createDataFrame([("c", 1, "Running dogs ran. The cats are sleeping!"), ("c", 1, "Another text of it. Hopping"), ("c", 2, None), ("c", 3, "")], "cid string, doc_id long, text string")
    out = corpus.sentences(rows, stem=True, rm_stop=True).collect()
    plain_rows = corpus.sentences(rows, rm_stop=True).collect()
    assert sorted((r["doc_id"], r["sent_idx"], r["orig"], r["sent"]) for r in out) == sorted((r["doc_id"], r["sent_idx"], r["orig"], " ".join(map(porter.stem, r["sent"].split()))) for r in plain_rows)
    assert len(out) == 4 and [r["sent"] for r in corpus.sentences(rows, most=1, stem=True, rm_short=True).collect()] == ["run dog ran.", "anoth text of it."]


def test_topic_tiles_of_documents(spark):
    from lectern.functions import tiling

    rows = corpus.documents(spark, SF).limit(20).cache()
    want = {(r["doc_id"], k): t for r in rows.collect() for k, t in enumerate(tiling.tile(r["text"]))}
    assert {(r["doc_id"], r["para_idx"]): r["para"] for r in corpus.paragraphs(rows, tiled=True).collect()} == want


def test_modes(tables):
    p = flow.Parameters(answering=flow.Answering(k=20), summary=flow.Summary(budget=60))
    assert flow.dispatch("rec", *tables, p).count() > 0
    assert {r["value"] for r in flow.dispatch("tune", *tables, p).collect()} == {10.0, 20.0}
    assert flow.dispatch("ablation", *tables, p).count() > 0
    with pytest.raises(ValueError, match="mode"):
        flow.dispatch("ablaton", *tables, p)


def test_scorers(spark, tables):
    docs, queries, _ = tables
    model = flow.model_scorer(lambda: lambda qs, ss: [float(len(s) > 30) for s in ss])
    flow.register_scorer("long", model)
    try:
        found = flow.retrieve(corpus.sentences(docs), queries, flow.Retrieval("long", "topK", 3))
        assert {r["score"] for r in found.select("score").distinct().collect()} <= {0.0, 1.0}
        with pytest.raises(ValueError, match="there is"):
            flow.register_scorer("long", model)
    finally:
        del flow.SCORERS["long"]


def test_two_classes(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([0.3],)], "x array<double>")
    assert [r[0] for r in rows.select(flow.two_class_probability(rows["x"])).collect()] == [0.5, 0.3]
    bad = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    with pytest.raises(Exception, match="one or two"):
        bad.select(flow.two_class_probability(bad["x"])).collect()


@pytest.mark.parametrize("bad", [{"damp": 0}, {"damp": 1.2}, {"omega": -1}, {"budget": 0}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        flow.Summary(**bad)
    assert graph.DAMP == flow.Summary().damp


def test_stream(spark, tables, tmp_path):
    docs, queries, _ = tables
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    running = stream.start(stream.documents(spark, f"{tmp_path}/in", 1), queries, f"{tmp_path}/scored", f"{tmp_path}/check", once=True)
    running.awaitTermination()
    now = stream.current(spark, f"{tmp_path}/scored").select("cid", "doc_id", "sent_idx", "rank")
    whole = flow.retrieve(corpus.sentences(docs), queries).select("cid", "doc_id", "sent_idx", "rank")
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, whole.collect()))
