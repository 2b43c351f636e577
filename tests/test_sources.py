"""Readers and writers on literal files."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus
from lectern.sources import readers, writers


def test_clusters_and_articles(spark, tmp_path):
    cluster = tmp_path / "2005" / "d301i"
    cluster.mkdir(parents=True)
    (cluster / "A1").write_text("<DOC>\n<TEXT>\n<P>\nFirst one.\n</P>\n<P>\nSecond.\n</P>\n</TEXT>\n</DOC>")
    (cluster / "A2").write_text("<GRAPHIC>\nOnly a picture.\n</GRAPHIC>")
    (cluster / "A3").write_text("nothing")
    (cluster / ".A1.swp").write_text("x")
    found = {r["doc_id"]: r for r in readers.articles(spark, str(tmp_path), "2005").collect()}
    assert {k: r["text"] for k, r in found.items()} == {"2005_d301i_A1": "First one.\n\nSecond.", "2005_d301i_A2": "Only a picture.", "2005_d301i_A3": None}
    assert {r["cid"] for r in found.values()} == {"2005_d301i"}
    paras = {r["doc_id"][-2:]: r["paras"] for r in readers.articles(spark, str(tmp_path), "2005", joined=False).collect()}
    assert paras == {"A1": ["First one.", "Second."], "A2": ["Only a picture."], "A3": None}
    kept = corpus.without_listed(readers.cluster_files(spark, str(tmp_path), "2005"), spark.createDataFrame([("2005_d301i_A3",)], "doc_id string"))
    assert kept.count() == 2


def topic(num, title, narr):
    return (f"<num> {num} </num>\n" if num else "") + f"<title> {title} </title>\n<narr>\n{narr}\n</narr>"


def test_topics(spark):
    raw = "\n\n\n".join([topic("d1", "A title", "One.\nTwo."), topic("d2", "Ends.", "Three?"), topic(None, "T", "N"), topic("d3", "Late", "Four")])
    out = {r["cid"]: r for r in readers.topics(spark.createDataFrame([("2005", raw)], "year string, raw string")).collect()}
    assert set(out) == {"2005_d1", "2005_d2"}
    assert out["2005_d1"]["query"] == "describe A title. One. Two." and out["2005_d1"]["narr_sents"] == ["One.", "Two."]
    assert out["2005_d2"]["query"] == "describe Ends. Three?"
    bad = spark.createDataFrame([("2005", "<num> d1 </num>\n<title> T </title>")], "year string, raw string")
    with pytest.raises(Exception, match="no narr"):
        readers.topics(bad).select("query").collect()


def test_years_and_pairs(spark):
    a = spark.createDataFrame([("x", "first"), ("y", "only a")], "cid string, query string")
    b = spark.createDataFrame([("x", "second"), ("z", "only b")], "cid string, query string")
    merged = readers.merged_years([a, b])
    assert {r["cid"]: r["query"] for r in merged.collect()} == {"x": "first", "y": "only a", "z": "only b"}
    with pytest.raises(Exception, match="no query"):
        readers.paired(spark.createDataFrame([("w",)], "cid string"), merged).collect()


def test_ids(spark):
    row = spark.range(1).select(readers.join_id(F.lit("2005"), F.lit("c"), F.lit(3)).alias("i"))
    assert row.select("i", readers.id_part("i", 2), readers.parent_id("i")).first()[:] == ("2005_c_3", "3", "2005_c")
    with pytest.raises(Exception, match="no part"):
        row.select(readers.id_part("i", 3)).collect()


def test_tables_of_text(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("c1\thealth\tWhat are the Causes?\n")
    assert readers.tsv_queries(spark, f"{tmp_path}/q.tsv").first()[:] == ("c1", "health", "what ar the causes?")
    rows = spark.createDataFrame([("c", "b", "One two\n\nthe\nthree"), ("c", "a", "Zero")], "cid string, name string, raw string")
    nested = {(r["doc_idx"], r["sent_idx"]): r["sent"] for r in readers.sentence_lines(rows, rm_stop=True).collect()}
    assert nested == {(0, 0): "zero", (1, 0): "two", (1, 1): "three"}
    flat = {(r["doc_idx"], r["sent_idx"]): r["orig"] for r in readers.sentence_lines(rows, flat=True).collect()}
    assert flat == {(0, 0): "zero", (0, 1): "one two", (0, 2): "the", (0, 3): "three"}
    lines = spark.createDataFrame([("Said ''no''",), ("Plain Line",)], "line string")
    assert [r[:] for r in readers.filtered_sentences(lines).collect()] == [("Plain Line", "plain line")]
    (tmp_path / "ref").mkdir()
    (tmp_path / "ref" / "c1_1").write_bytes("Un été.\n\nDeux.".encode("latin-1"))
    assert [r["sent"] for r in readers.reference_summaries(spark, f"{tmp_path}/ref").sort("line_no").collect()] == ["Un été.", "Deux."]
    assert [r["sent"] for r in readers.reference_summaries(spark, f"{tmp_path}/ref", resegment=True).sort("line_no").collect()] == ["Un été.", "Deux."]
    assert readers.reference_query(spark.createDataFrame([("c", 1, "b"), ("c", 0, "a")], "cid string, line_no int, sent string")).first()["query"] == "ab"


def test_records(spark, tmp_path):
    records = spark.createDataFrame([("c", 1, "1_0", 0.5, "a b"), ("c", 2, "0_3", 0.25, "the")], readers.RECORD)
    writers.rank_records(records, f"{tmp_path}/r")
    assert sorted(map(tuple, readers.rank_records(spark, f"{tmp_path}/r").select(records.columns).collect())) == sorted(map(tuple, records.collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        writers.rank_records(records, f"{tmp_path}/r")
    lines = writers.record_lines(records).select("cid", (F.col("rank") - 1).alias("line_no"), F.col("value").alias("line"))
    assert sorted(map(tuple, readers.text_records(lines).select(records.columns).collect())) == sorted(map(tuple, records.collect()))
    assert writers.record_lines(records, with_rank=True).first()["value"] == "1\t1_0\t0.5\ta b"
    with pytest.raises(Exception, match="fields"):
        readers.text_records(spark.createDataFrame([("c", 0, "x")], "cid string, line_no int, line string")).collect()
    again = readers.retrieved_sentences(records, rm_stop=True).sort("sent_idx").collect()
    assert [(r["doc_idx"], r["sent_idx"], r["sent"]) for r in again] == [(0, 0, "b"), (0, 1, "")]
    writers.summaries(spark.createDataFrame([("c", "one\ntwo")], "cid string, summary string"), f"{tmp_path}/s")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/s").collect()] == ["one", "two"]
    assert writers.run_name("ir", conf=0.75, k=None, dedupe=False) == "ir-conf_0.75-dedupe_False"


def test_question_corpus(spark, tmp_path):
    context = "The sky is blue. Grass is green. Snow is white."
    qas = [
        {"question": " What is green? ", "is_impossible": False, "answers": [{"text": "Grass", "answer_start": context.index("Grass")}]},
        {"question": "What is red?", "is_impossible": True, "answers": []},
    ]
    (tmp_path / "qa.json").write_text(json.dumps({"data": [{"paragraphs": [{"context": context, "qas": qas}]}]}))
    paragraphs = readers.qa_corpus(spark, f"{tmp_path}/qa.json")
    out = readers.qa_samples(paragraphs).collect()
    assert {(r["qid"], r["sent_idx"], r["yy"]) for r in out} == {("0_0_0", 0, 0), ("0_0_0", 1, 1), ("0_0_0", 2, 0), ("0_0_1", 0, 0), ("0_0_1", 1, 0), ("0_0_1", 2, 0)}
    assert {r["question"] for r in out} == {"What is green?", "What is red?"}
    (tmp_path / "t.json").write_text(json.dumps([{"question": " q --T-- x", "answer": "A one. Two.", "document": "d one. d two. <P> <P> e."}]))
    triples = readers.qa_triples(spark, f"{tmp_path}/t.json").withColumn("idx", F.lit(0))
    parts = writers.converted_corpus(triples)
    assert parts["questions"].first()["question"] == "q"
    assert sorted((r["sid"], r["sent"]) for r in parts["documents"].collect()) == [("0_0_0", "d one."), ("0_0_1", "d two."), ("0_1_0", "e.")]
    assert [r["sent"] for r in parts["summaries"].sort("line_no").collect()] == ["A one.", "Two."]


@pytest.mark.parametrize(("start", "want"), [(0, 0), (9, 0), (10, 1), (11, 1), (20, 1), (21, None)])
def test_answer_sentence(spark, start, want):
    """Sentences of 10 characters with one between: the first ends at 10, the second at 21."""
    sents = spark.createDataFrame([("p", 0, "a" * 10), ("p", 1, "b" * 10)], "pid string, sent_idx int, sent string")
    out = corpus.first_match(sents, spark.createDataFrame([("p", start)], "pid string, start int"), ("pid",)).collect()
    assert [r["sent_idx"] for r in out] == ([] if want is None else [want])


def test_contexts(spark):
    sents = spark.createDataFrame([("c", 1, k, f"s{k}") for k in range(3)], "cid string, doc_id int, sent_idx int, sent string")
    one = {r["sent_idx"]: r["context"] for r in corpus.with_context(sents, 1).collect()}
    assert one == {0: "s0 [unused1]  [unused2] s1", 1: "s1 [unused1] s0 [unused2] s2", 2: "s2 [unused1] s1 [unused2] "}
    two = {r["sent_idx"]: r["context"] for r in corpus.with_context(sents, 2).collect()}
    assert two[0] == "s0 [unused1]  [unused2] s1 [unused3]  [unused4] s2"
    assert {r["context"] for r in corpus.with_context(sents, 0).collect()} == {"s0", "s1", "s2"}
    with pytest.raises(ValueError, match="negative"):
        corpus.with_context(sents, -1)


def test_prefixes(spark):
    names = spark.createDataFrame([("d301i",), ("d3010",), ("d4",)], "cid string")
    out = readers.match_prefix(spark.createDataFrame([("d301",), ("d4",)], "prefix string"), names, "prefix", "cid").collect()
    assert {(r["prefix"], r["cid"]) for r in out} == {("d301", "d301i"), ("d301", "d3010"), ("d4", "d4")}


def test_markup(spark):
    page = "<html><P class=x>One <b>two</b><p>three</p>tail<p> </p><article>A</article>"
    row = spark.createDataFrame([(page,)], "html string").select(readers.tagged_paragraphs(F.col("html")), readers.first_block(F.col("html"), "main", "article")).first()
    assert row[:] == (["One two", "three"], "A")


def test_targets_graphs_and_logs(spark, tmp_path):
    files = spark.createDataFrame([("D301", "D301.M.A"), ("D301", "D301.M.B"), ("D9", "D9.M.A")], "prefix string, name string")
    clusters = spark.createDataFrame([("d301i",), ("d400",)], "cid string")
    assert {tuple(r) for r in readers.reference_targets(files, clusters, lower=True).collect()} == {("d301i", 1, "D301.M.A"), ("d301i", 2, "D301.M.B")}
    nodes = spark.createDataFrame([("c", 0, 1.0)], "cid string, i int, rel double")
    edges = spark.createDataFrame([("c", 0, 1, 0.5)], "cid string, i int, j int, w double")
    writers.graph(nodes, edges, f"{tmp_path}/g")
    assert [t.count() for t in readers.graph(spark, f"{tmp_path}/g")] == [1, 1]
    writers.passages(spark.createDataFrame([("c", 1, 0), ("c", 1, 1)], "cid string, doc_id int, p_idx int"), f"{tmp_path}/p")
    assert readers.passages(spark, f"{tmp_path}/p", spark.createDataFrame([("c", 1, 1)], "cid string, doc_id int, p_idx int")).count() == 1
    assert readers.passages(spark, f"{tmp_path}/p").count() == 2
    writers.tuning_log(spark.createDataFrame([(0.5, 1.0)], "conf double, f1 double"), f"{tmp_path}/log")
    assert spark.read.csv(f"{tmp_path}/log", sep="\t", header=True).first()[:] == ("0.5", "1.0")
    records = spark.createDataFrame([("c", 1, "0", 0.5, "The cat. Of the. A dog!")], readers.RECORD)
    assert readers.retrieved_paragraphs(records, rm_stop=True).first()["sent"] == "cat. the. dog!"
    writers.samples(spark.createDataFrame([(1, "q", "s", "a?", "b")], "yy int, qid string, sid string, question string, sent string").coalesce(1), f"{tmp_path}/qa")
    lines = spark.read.text(f"{tmp_path}/qa")
    assert len(writers.check_samples(lines).collect()) == 2
    with pytest.raises(Exception, match="five"):
        writers.check_samples(spark.createDataFrame([("a\tb",)], "value string")).collect()
