"""Lexical scores of sentences against their cluster's query, and TF-IDF weights and similarities.

A score needs a sentence and its query only, so it is computed in the row that holds both, and no term table is shuffled.
Counting a row's tokens takes a hash table, which array expressions do not have: they compare all tokens with all, interpreted, at
several times the cost of an Arrow batch handed to a counter.  Inverse document frequencies need a term table: it is counted per
(cluster, term) with a partial count before the shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.functions import text as T
from lectern.shipping import ship

#: The tokens of ``text.terms``: letters, numbers and underscores, two or more.
_TERM = re.compile(r"\w{2,}")


def term_counts(rows: DataFrame, key: list[str], tokens) -> DataFrame:
    """(key, term, tf)."""
    return rows.select(*key, F.explode(tokens).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def tf_weights(counts: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, tf, w): counts scaled to length 1 in each row."""
    w = Window.partitionBy(*key)
    return counts.withColumn("w", F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(w)))


@lru_cache(maxsize=4096)
def _query_counts(query: str | None) -> tuple[dict[str, int], float]:
    """A query's terms with their counts, and the length of that vector; a worker counts each query once."""
    counts = Counter(_TERM.findall(query or ""))
    return counts, math.sqrt(sum(n * n for n in counts.values()))


def _dot(tokens: list[str], query: dict[str, int]) -> int:
    return sum([query[t] for t in tokens if t in query])


@F.pandas_udf(DoubleType())
def _cosine(text: pd.Series, query: pd.Series) -> pd.Series:
    out = []
    for t, q in zip(text, query, strict=True):
        counts, length = _query_counts(q)
        tokens = _TERM.findall(t or "")
        dot = _dot(tokens, counts)
        out.append(dot / (math.sqrt(sum([n * n for n in Counter(tokens).values()])) * length) if dot else 0.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def _overlap(text: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([_dot(_TERM.findall(t or ""), _query_counts(q)[0]) for t, q in zip(text, query, strict=True)], dtype="float64")


def _scored(sents: DataFrame, queries: DataFrame, text: str, score) -> DataFrame:
    """Sentences of clusters with a query, and their score. A query is a row a cluster, and travels with the sentences of its cluster."""
    ship(sents.sparkSession)
    rows = sents.join(queries.select("cid", F.lower("query").alias("_query")), "cid")
    return rows.withColumn("score", score(F.lower(text), F.col("_query"))).drop("_query")


def tf_relevance(sents: DataFrame, queries: DataFrame, text: str = "sent") -> DataFrame:
    """Adds ``score``: the cosine of term counts with the cluster's query; 0 where either has no term."""
    return _scored(sents, queries, text, _cosine)


def count_relevance(sents: DataFrame, queries: DataFrame, text: str = "sent") -> DataFrame:
    """Adds ``score``: how often the query's terms, each as often as it occurs there, occur in the sentence."""
    return _scored(sents, queries, text, _overlap)


def tf_dot_relevance(sents: DataFrame, queries: DataFrame, key: list[str], text: str = "sent") -> DataFrame:
    """Adds ``score`` as the dot product of unit term vectors: the same number as ``tf_relevance``, from term tables."""
    s = tf_weights(term_counts(sents, key, T.terms(F.col(text))), key)
    q = tf_weights(term_counts(queries, ["cid"], T.terms(F.col("query"))), ["cid"]).select("cid", "term", F.col("w").alias("qw"))
    found = s.join(q, ["cid", "term"]).groupBy(*key).agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    return sents.join(found, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def tfidf_weights(nodes: DataFrame, queries: DataFrame | None, key: list[str], text: str = "sent", unit: list[str] | None = None) -> DataFrame:
    """(key, term, w): counts times ln((1 + n) / (1 + df)) + 1, scaled to length 1.

    n and df count the cluster's sentences and, if given, its query, which is a row of its own with null keys
    besides the cluster.  unit: columns (besides the cluster) that are counted instead of sentences, for
    frequencies of whole documents.
    """
    counts = term_counts(nodes, key, T.terms(F.col(text)))
    per = unit if unit is not None else [c for c in key if c != "cid"]
    ids = nodes.select("cid", *per).distinct().groupBy("cid").agg(F.count("*").alias("n"))
    df = counts.select("cid", "term", *per).distinct().groupBy("cid", "term").agg(F.count("*").alias("df"))
    if queries is not None:
        q = term_counts(queries, ["cid"], T.terms(F.col("query")))
        df = df.unionByName(q.select("cid", "term", F.lit(1).cast("long").alias("df"))).groupBy("cid", "term").agg(F.sum("df").alias("df"))
        ids = ids.join(queries.select("cid", F.lit(1).alias("one")), "cid", "left").select("cid", (F.col("n") + F.coalesce("one", F.lit(0))).alias("n"))
        counts = counts.unionByName(q.select(*[F.col(c) if c == "cid" else F.lit(None).alias(c) for c in key], "term", "tf"))
    idf = df.join(ids, "cid").select("cid", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, ["cid", "term"]).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*key)))
    return raw.select(*key, "term", (F.col("raw") / norm).alias("w"))


def document_idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """(cid, term, idf): ln((1 + n) / (1 + df)) + 1 over the cluster's documents that have any text.

    A document is one row, so its terms are told apart in the row.
    """
    n = docs.where(T.collapse(F.col(text)) != "").groupBy("cid").agg(F.count("*").alias("n"))
    df = docs.select("cid", F.explode(F.array_distinct(T.terms(F.col(text)))).alias("term")).groupBy("cid", "term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), "cid").select("cid", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def similarity_edges(weights: DataFrame, key: list[str], other_document: bool = False) -> DataFrame:
    """(cid, i keys, j keys, w): cosine of every ordered pair of different sentences that share a term.

    key: cluster, document and sentence columns.  other_document: only pairs of different documents.
    """
    cid, doc, sent = key
    left = weights.select(cid, F.col(doc).alias("i_doc"), F.col(sent).alias("i_sent"), "term", F.col("w").alias("wi"))
    right = weights.select(cid, F.col(doc).alias("j_doc"), F.col(sent).alias("j_sent"), "term", F.col("w").alias("wj"))
    differ = F.col("i_doc") != F.col("j_doc")
    if not other_document:
        differ = differ | (F.col("i_sent") != F.col("j_sent"))
    pairs = left.join(right, [cid, "term"]).where(differ)
    return pairs.groupBy(cid, "i_doc", "i_sent", "j_doc", "j_sent").agg(F.sum(F.col("wi") * F.col("wj")).alias("w"))


def query_similarity(weights: DataFrame, key: list[str]) -> DataFrame:
    """(key, score): the weights' dot product with the query's row, for sentences that share a term with it."""
    cid, doc, _ = key
    q = weights.where(F.col(doc).isNull()).select(cid, "term", F.col("w").alias("qw"))
    return weights.where(F.col(doc).isNotNull()).join(q, [cid, "term"]).groupBy(*key).agg(F.sum(F.col("w") * F.col("qw")).alias("score"))


def row_l1(edges: DataFrame) -> DataFrame:
    """Edges with ``p``: each weight as a share of its row's sum."""
    w = Window.partitionBy("cid", "i_doc", "i_sent")
    return edges.withColumn("p", F.col("w") / F.sum("w").over(w))


@lru_cache(maxsize=65_536)
def _bag(text: str) -> tuple[Counter, float]:
    """Counts of a text's tokens between spaces, and their length."""
    counts = Counter(text.split(" ")) if text else Counter()
    return counts, math.sqrt(sum(n * n for n in counts.values()))


@F.pandas_udf(DoubleType())
def _bag_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        (p, n), (q, m) = _bag((x or "").strip(" ")), _bag((y or "").strip(" "))
        out.append(_dot(list(p.elements()), q) / (n * m) if n and m else 0.0)
    return pd.Series(out, dtype="float64")


def bow_cosine(a, b):
    """Cosine of the token counts of two texts; 0 where either has no token."""
    ship()
    return _bag_cosine(a, b)


def pooled(pairs: DataFrame, by: list[str], how: str, score: str = "score") -> DataFrame:
    """Scores against several triggers as one: ``avg`` over the valid ones, or ``max``."""
    if how == "avg":
        return pairs.groupBy(*by).agg((F.sum(score) / F.count(score)).alias("score"))
    if how == "max":
        return pairs.groupBy(*by).agg(F.max(score).alias("score"))
    raise ValueError(f"no such pooling: {how}")


def masked_scores(rows: DataFrame, valid: str, score: str = "score") -> DataFrame:
    """Rows that are no sentences rank last."""
    return rows.withColumn(score, F.when(F.col(valid), F.col(score)).otherwise(F.lit(float("-inf"))))
