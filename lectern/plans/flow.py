"""The whole system: retrieval, answering, summarisation and evaluation, with typed parameters.

The three stages go from coarse to fine, so that the graph, whose cost grows with the square of its nodes, only
sees a bounded number of sentences a cluster.  Scorers are columns: a model is a function that adds ``score`` to
rows of (cid, doc_id, sent_idx, sent) joined with their query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.operators import corpus, ensemble, evaluate, graph, passages, rank, scoring, summarize
from lectern.operators.store import once
from lectern.shipping import ship

Scorer = Callable[[DataFrame, DataFrame], DataFrame]

#: Scorers by name: (sentences, queries) to sentences with ``score``.
SCORERS: dict[str, Scorer] = {"tf": scoring.tf_relevance, "count": scoring.count_relevance}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Makes a scorer known by name; a model is a scorer whose column is a pandas UDF over batches."""
    if name in SCORERS:
        raise ValueError(f"there is a scorer {name}")
    SCORERS[name] = scorer


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]], most: int | None = None) -> Scorer:
    """A scorer of a pair model: ``load`` runs once a worker and gives (queries, sentences) to scores in [0, 1]."""
    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for query, sent in batches:
            yield pd.Series(model(query.str[:most].tolist() if most else query.tolist(), sent.tolist()), dtype="float64")

    ship()
    return lambda sents, queries: sents.join(queries, "cid").withColumn("score", score("query", "sent")).drop("query")


def two_class_probability(logits) -> F.Column:
    """Of an array of two logits the probability of class 1; of one output, itself; another size is an error."""
    first, second = F.get(logits, F.lit(0)), F.get(logits, F.lit(1))
    soft = 1 / (1 + F.exp(first - second))
    return F.when(F.size(logits) == 2, soft).when(F.size(logits) == 1, first).otherwise(F.raise_error(F.lit("a model gives one or two outputs")))


@dataclass(frozen=True)
class Retrieval:
    scorer: str = "tf"
    how: str = "conf"
    value: float = 0.75
    dedupe: bool = False
    min_rows: int | None = None


@dataclass(frozen=True)
class Answering:
    scorer: str = "tf"
    k: int = 90
    passage_scorer: str | None = None
    mode: str = "weight_avg_sent_only"
    weight: float = 0.0


@dataclass(frozen=True)
class Summary:
    damp: float = graph.DAMP
    steps: int = graph.STEPS
    omega: float = 4.0
    cosine: float = summarize.COSINE
    budget: int = summarize.BUDGET
    other_document: bool = False
    document_idf: bool = False

    def __post_init__(self):
        if not 0 < self.damp <= 1 or self.omega < 0 or self.budget < 1:
            raise ValueError("damp is a share, omega and the budget are not negative")


@dataclass(frozen=True)
class Parameters:
    retrieval: Retrieval = field(default_factory=Retrieval)
    answering: Answering = field(default_factory=Answering)
    summary: Summary = field(default_factory=Summary)


def retrieve(sents: DataFrame, queries: DataFrame, p: Retrieval = Retrieval()) -> DataFrame:
    """(cid, doc_id, sent_idx, sent, score, rank) kept of each cluster."""
    scored = SCORERS[p.scorer](sents, queries)
    return rank.retrieve(scored, p.how, p.value, dedupe=p.dedupe, min_rows=p.min_rows)


def answer(found: DataFrame, queries: DataFrame, p: Answering = Answering()) -> DataFrame:
    """The k best of the retrieved sentences by the answering scorer, combined with passages' scores where asked."""
    rows = SCORERS[p.scorer](found.drop("score", "rank"), queries)
    if p.passage_scorer is None:
        return rank.top_k(rows, p.k)
    own = passages.joined(passages.sliding(rows.withColumn("orig", F.col("sent"))))
    of_passages = SCORERS[p.passage_scorer](own, queries).select("cid", F.explode("sents.sent").alias("sent"), "score")
    both = ensemble.combine(ensemble.scorer_records(rows), ensemble.scorer_records(of_passages, passages=True), p.mode, p.weight)
    first = rows.groupBy("cid", "sent").agg(F.min(F.struct("doc_id", "sent_idx")).alias("m")).select("cid", "sent", "m.doc_id", "m.sent_idx")
    return rank.top_k(both.join(first, ["cid", "sent"]), p.k)


def summarise(answers: DataFrame, queries: DataFrame, p: Summary = Summary()) -> DataFrame:
    """(cid, summary)."""
    key = ["cid", "doc_id", "sent_idx"]
    weights = scoring.tfidf_weights(answers, None, key, unit=["doc_id"]) if p.document_idf else scoring.tfidf_weights(answers, queries.join(answers.select("cid").distinct(), "cid", "left_semi"), key)
    nodes = graph.nodes(answers.select(*key, "sent", "score"))
    edges = graph.edges(scoring.similarity_edges(weights.where("doc_id IS NOT NULL"), key, p.other_document), nodes)
    order = graph.diversity_rank(graph.markov(nodes, edges, p.damp, p.steps), edges, p.omega)
    rows = order.join(nodes.select("cid", "i", F.col("sent").alias("orig"), "sent"), ["cid", "i"])
    return summarize.text_of(summarize.select(rows, p.budget, p.cosine))


def run(docs: DataFrame, queries: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(cid, summary) of every cluster with a query, from its documents (cid, doc_id, text)."""
    found = retrieve(corpus.sentences(docs), queries, p.retrieval)
    return summarise(answer(found, queries, p.answering), queries, p.summary)


def judge(summaries: DataFrame, references: DataFrame, length: int = evaluate.LENGTH, stem: bool = True) -> DataFrame:
    """(cid, metric, recall, precision, f1) in percent."""
    text = summaries.select("cid", F.col("summary").alias("text"))
    out = None
    for metric in evaluate.METRICS:
        rows = evaluate.scores(text, references, metric, length, stem)
        rows = rows.select("cid", F.lit(metric).alias("metric"), *[evaluate.percent(F.col(c)).alias(c) for c in ("recall", "precision", "f1")])
        out = rows if out is None else out.unionByName(rows)
    return out


def tune_retrieval(scored: DataFrame, references: DataFrame, how: str, values: list, length: int = evaluate.LENGTH, stem: bool = False) -> DataFrame:
    """(value, recall, f1): mean ROUGE-2 of the retrieved text for each confidence or k, from one ranking."""
    rows = rank.sweep(rank.prune(scored), how, values, "value").withColumn("value", F.col("value").cast("double"))
    rows = rows.where(F.col("rank") <= length)  # what scores holds a word at least: no more lines can count
    lines = F.array_sort(F.collect_list(F.struct("rank", "sent")))
    text = rows.groupBy("value", "cid").agg(F.array_join(F.transform(lines, lambda x: x["sent"]), "\n").alias("text"))
    each = evaluate.pairwise(text.withColumnRenamed("value", "cand"), references, "rouge2", length, stem)
    one = each.groupBy("cid", "cand").agg(F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return one.groupBy(F.col("cand").alias("value")).agg(F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def dispatch(mode: str, docs: DataFrame, queries: DataFrame, references: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Runs a part by name: ``rec`` gives the answers, ``tune`` the sweep over k, ``ablation`` the evaluation without the graph."""
    if mode not in ("rec", "tune", "ablation"):
        raise ValueError(f"no such mode: {mode}")
    found = retrieve(corpus.sentences(docs), queries, p.retrieval)
    if mode == "tune":
        return tune_retrieval(SCORERS[p.answering.scorer](found.drop("score", "rank"), queries), references, "topK", list(range(10, p.answering.k + 1, 10)))
    answers = answer(found, queries, p.answering)
    if mode == "rec":
        return answers
    picked = summarize.select(answers.select("cid", "rank", F.col("sent").alias("orig"), "sent"), p.summary.budget, p.summary.cosine)
    return judge(summarize.text_of(picked), references)


def tune_omega(docs: DataFrame, queries: DataFrame, references: DataFrame, values: list[float], p: Parameters = Parameters()) -> DataFrame:
    """(omega, recall, f1): mean ROUGE-2 for each penalty, from one graph; only the greedy part is done anew."""
    key = ["cid", "doc_id", "sent_idx"]
    answers = once(answer(retrieve(corpus.sentences(docs), queries, p.retrieval), queries, p.answering))
    weights = scoring.tfidf_weights(answers, queries.join(answers.select("cid").distinct(), "cid", "left_semi"), key)
    nodes = graph.nodes(answers.select(*key, "sent", "score"))
    edges = once(graph.edges(scoring.similarity_edges(weights.where("doc_id IS NOT NULL"), key), nodes))
    order = graph.diversity_ranks(graph.markov(nodes, edges, p.summary.damp, p.summary.steps), edges, values)
    rows = order.join(nodes.select("cid", "i", F.col("sent").alias("orig"), "sent"), ["cid", "i"])
    rows = rows.withColumn("cid", F.concat_ws("\x1f", F.col("omega").cast("string"), "cid"))  # each penalty makes a summary of each cluster
    text = summarize.text_of(summarize.select(rows, p.summary.budget, p.summary.cosine))
    text = text.select(F.substring_index("cid", "\x1f", -1).alias("cid"), F.substring_index("cid", "\x1f", 1).cast("double").alias("cand"), F.col("summary").alias("text"))
    each = evaluate.pairwise(text, references, "rouge2").groupBy("cid", "cand").agg(F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return each.groupBy(F.col("cand").alias("omega")).agg(F.avg("recall").alias("recall"), F.avg("f1").alias("f1")).orderBy("omega")
