"""Retrieval: scores of sentences against their cluster's query, rankings and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import corpus, rank, scoring
from lectern.operators.store import once

from . import sql as S

CONF, TOP_K, MIN_ROWS = 0.75, 90, 30
CONF_GRID = [round(0.05 * k, 2) for k in range(1, 21)]
K_GRID = list(range(10, 510, 10))
KEY = ["cid", "doc_id", "sent_idx"]


def sentences(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    return corpus.sentences(corpus.documents(spark, sf_dir, lang)).drop("orig")


def english_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For rules of English: stop words and stems."""
    return sentences(spark, sf_dir, "en")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tf_relevance(sentences(spark, sf_dir), corpus.cluster_queries(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored`` without the text, computed once: rankings read it twice."""
    return once(scored(spark, sf_dir).select(*KEY, "score"))


def _out(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*KEY, F.round("score", 6).alias("score"), *more)


def tf_relevance(spark, sf_dir):
    return _out(scored(spark, sf_dir))


def tf_dot_relevance(spark, sf_dir):
    queries = corpus.cluster_queries(spark, sf_dir)
    sents = sentences(spark, sf_dir).join(queries.select("cid"), "cid", "left_semi")
    return _out(scoring.tf_dot_relevance(sents, queries, KEY))


def count_relevance(spark, sf_dir):
    return _out(scoring.count_relevance(sentences(spark, sf_dir), corpus.cluster_queries(spark, sf_dir)))


def rank_sentences(spark, sf_dir):
    return _out(rank.ranked(scores(spark, sf_dir)), "rank")


def reverse_argsort_rank(spark, sf_dir):
    return _out(rank.reverse_ranked(scores(spark, sf_dir)), "rank")


def prune_tail(spark, sf_dir):
    return _out(rank.prune(scored(spark, sf_dir)))


def conf_filter_075(spark, sf_dir):
    return _out(rank.by_confidence(rank.prune(scores(spark, sf_dir)), CONF), "rank")


def conf_filter_min_ns(spark, sf_dir):
    return _out(rank.by_confidence(rank.prune(scores(spark, sf_dir)), 0.1, min_rows=MIN_ROWS), "rank")


def conf_filter_minmax(spark, sf_dir):
    return _out(rank.by_confidence(rank.prune(scores(spark, sf_dir)), CONF, norm=True), "rank")


def retrieve_conf(spark, sf_dir):
    """The flagship: a cluster's best sentences up to 75 % of its score, or all where none scores."""
    return _out(rank.retrieve(scored(spark, sf_dir).drop("sent"), "conf", CONF), "rank")


def retrieve_topk(spark, sf_dir):
    return _out(rank.retrieve(scored(spark, sf_dir).drop("sent"), "topK", TOP_K), "rank")


def retrieve_conf_dedupe(spark, sf_dir):
    return _out(rank.retrieve(scored(spark, sf_dir), "conf", CONF, dedupe=True), "rank")


def zero_top_passthrough(spark, sf_dir):
    rows = scores(spark, sf_dir)
    best = rows.groupBy("cid").agg(F.max("score").alias("best")).where("best = 0")
    return _out(rank.ranked(rows.join(best, "cid", "left_semi")), "rank")


def topk_90(spark, sf_dir):
    return _out(rank.top_k(rank.prune(scored(spark, sf_dir)), TOP_K), "rank")


def dedupe_then_topk(spark, sf_dir):
    return _out(rank.top_k(rank.deduplicate(rank.prune(scored(spark, sf_dir))), TOP_K), "rank")


def rank_records(spark, sf_dir):
    """Records with composite ids, as they are handed on."""
    rows = rank.top_k(rank.prune(scored(spark, sf_dir)), TOP_K)
    return rows.select("cid", "rank", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("sent_idx").cast("string")).alias("sid"), F.round("score", 6).alias("score"), "sent")


def stopword_projection(spark, sf_dir):
    sents = english_sentences(spark, sf_dir)
    return sents.select(*KEY, T.normalise(F.col("sent"), rm_stop=True).alias("proc"))


def stemmed_sentences(spark, sf_dir):
    sents = english_sentences(spark, sf_dir)
    return sents.select(*KEY, T.normalise(F.col("sent"), rm_stop=True, stem=True).alias("proc"))


def stemmed_retrieval(spark, sf_dir):
    """Stop words off and stems on the sentences' side, stems on the query's."""
    sents = corpus.sentences(corpus.documents(spark, sf_dir, "en"), rm_dialog=True, rm_stop=True, stem=True)
    queries = corpus.cluster_queries(spark, sf_dir).withColumn("query", T.normalise(F.col("query"), stem=True))
    return _out(rank.retrieve(scoring.tf_relevance(sents, queries), "conf", CONF), "rank")


def short_sentence_filter(spark, sf_dir):
    return sentences(spark, sf_dir).where(~T.is_short(F.col("sent"))).select(*KEY, T.n_words(F.col("sent")).alias("n_words"))


def dialogue_filter(spark, sf_dir):
    return sentences(spark, sf_dir).where(~T.is_dialogue(F.col("sent"), quoted_reports=True)).select(*KEY)


def doc_head_100(spark, sf_dir):
    return corpus.sentences(corpus.documents(spark, sf_dir), most=100).select(*KEY, "sent")


def doc_denylist_antijoin(spark, sf_dir):
    listed = corpus.table(spark, sf_dir, "labels").where("toxic = 1")
    return corpus.without_listed(corpus.documents(spark, sf_dir, None), listed).select("cid", "doc_id")


def doc_semi_join(spark, sf_dir):
    listed = corpus.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return corpus.documents(spark, sf_dir, None).join(listed, "doc_id", "left_semi").select("cid", "doc_id")


def cluster_query_pairs(spark, sf_dir):
    clusters = corpus.documents(spark, sf_dir, None).select("cid").distinct()
    return clusters.join(corpus.cluster_queries(spark, sf_dir), "cid").select("cid", "query")


def term_count_vectors(spark, sf_dir):
    return scoring.term_counts(sentences(spark, sf_dir), KEY, T.terms(F.col("sent")))


def tf_weights(spark, sf_dir):
    rows = scoring.tf_weights(term_count_vectors(spark, sf_dir), KEY)
    return rows.select(*KEY, "term", F.round("w", 6).alias("w"))


def sweep_conf_20(spark, sf_dir):
    rows = rank.sweep(scored(spark, sf_dir).drop("sent"), "conf", CONF_GRID, "conf")
    return rows.groupBy("conf", "cid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("mass"))


def sweep_topk(spark, sf_dir):
    rows = rank.sweep(rank.prune(scored(spark, sf_dir)), "topK", K_GRID, "k")
    return rows.groupBy("k", "cid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("mass"))


def oracle_retrieval(spark, sf_dir):
    """Retrieval with the last reference as the query: what a perfect query would find."""
    best = corpus.references(spark, sf_dir).where("ref_idx = 2").select("cid", F.col("text").alias("query"))
    return _out(rank.retrieve(scoring.tf_relevance(sentences(spark, sf_dir), best).drop("sent"), "conf", CONF), "rank")


QUERIES = {
    f.__name__: f
    for f in (
        tf_relevance, tf_dot_relevance, count_relevance, rank_sentences, reverse_argsort_rank, prune_tail, conf_filter_075, conf_filter_min_ns,
        conf_filter_minmax, retrieve_conf, retrieve_topk, retrieve_conf_dedupe, zero_top_passthrough, topk_90, dedupe_then_topk, rank_records,
        stopword_projection, stemmed_sentences, stemmed_retrieval, short_sentence_filter, dialogue_filter, doc_head_100, doc_denylist_antijoin, doc_semi_join,
        cluster_query_pairs, term_count_vectors, tf_weights, sweep_conf_20, sweep_topk, oracle_retrieval,
    )
}

_OUT = "cid, doc_id, sent_idx, round(score, 6) AS score"
_LIVE = "lv AS (SELECT * FROM sc WHERE score > 1e-10)"
_DEDUPED = "dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid, sent ORDER BY round(score, 9) DESC, doc_id, sent_idx) AS k FROM lv) WHERE k = 1)"
_ZERO = f"SELECT {_OUT}, rank FROM (SELECT *, {S.RANK}, max(score) OVER (PARTITION BY cid) AS best FROM sc) WHERE best = 0"


def _retrieve(query: str = S.QUERY, source: str = "lv", *more: str) -> str:
    base = [S.DOCS, S.SENTENCES, query, S.COUNTS, S.SCORES, _LIVE, *more, S.shares(source)]
    return S.select(*base, f"SELECT {_OUT}, rank FROM cu WHERE before < {CONF} UNION ALL {_ZERO}")


ORACLE = {
    "tf_relevance": S.select(S.BASE, f"SELECT {_OUT} FROM sc"),
    "tf_dot_relevance": S.select(S.BASE, f"SELECT {_OUT} FROM sc"),
    "count_relevance": S.select(S.BASE, "SELECT s.cid, s.doc_id, s.sent_idx, coalesce(dot, 0.0) AS score FROM s JOIN q USING (cid) LEFT JOIN dots USING (cid, doc_id, sent_idx)"),
    "rank_sentences": S.select(S.BASE, f"SELECT {_OUT}, {S.RANK} FROM sc"),
    "reverse_argsort_rank": S.select(S.BASE, f"SELECT {_OUT}, {S.RANK.replace('doc_id, sent_idx)', 'doc_id DESC, sent_idx DESC)')} FROM sc"),
    "prune_tail": S.select(S.BASE, f"SELECT {_OUT} FROM sc WHERE score > 1e-10"),
    "conf_filter_075": S.select(S.BASE, _LIVE, S.shares("lv"), f"SELECT {_OUT}, rank FROM cu WHERE before < {CONF}"),
    "conf_filter_min_ns": S.select(S.BASE, _LIVE, S.shares("lv"), f"SELECT {_OUT}, rank FROM cu WHERE before < 0.1 OR rank <= {MIN_ROWS}"),
    "conf_filter_minmax": S.select(
        S.BASE, _LIVE,
        """mm AS (SELECT cid, doc_id, sent_idx, coalesce((score - lo) / nullif(hi - lo, 0), 0.0) AS score FROM
        (SELECT *, min(score) OVER (PARTITION BY cid) AS lo, max(score) OVER (PARTITION BY cid) AS hi FROM lv))""",
        S.shares("mm"), f"SELECT {_OUT}, rank FROM cu WHERE before < {CONF}",
    ),
    "retrieve_conf": _retrieve(),
    "retrieve_topk": S.select(S.BASE, S.top(TOP_K), f"SELECT {_OUT}, rank FROM tk UNION ALL {_ZERO}"),
    "retrieve_conf_dedupe": _retrieve(S.QUERY, "dd", _DEDUPED),
    "zero_top_passthrough": S.select(S.BASE, _ZERO),
    "topk_90": S.select(S.BASE, S.top(TOP_K), f"SELECT {_OUT}, rank FROM tk"),
    "dedupe_then_topk": S.select(S.BASE, _LIVE, _DEDUPED, S.top(TOP_K, "dd"), f"SELECT {_OUT}, rank FROM tk"),
    "rank_records": S.select(S.BASE, S.top(TOP_K), "SELECT cid, rank, doc_id || '_' || sent_idx AS sid, round(score, 6) AS score, sent FROM tk"),
    "stopword_projection": S.select(S.ENGLISH_DOCS, S.SENTENCES, f"SELECT cid, doc_id, sent_idx, {S.without_stopwords('sent')} AS proc FROM s"),
    "short_sentence_filter": S.select(S.DOCS, S.SENTENCES, f"SELECT cid, doc_id, sent_idx, CAST(len(regexp_extract_all(sent, {S.WORD})) AS INTEGER) AS n_words FROM s WHERE len(regexp_extract_all(sent, {S.WORD})) >= 3"),
    "dialogue_filter": S.select(
        S.DOCS, S.SENTENCES,
        "SELECT cid, doc_id, sent_idx FROM s WHERE NOT (contains(sent, '''''') OR contains(sent, '``') OR (starts_with(sent, '''') AND (contains(sent, 'says') OR contains(sent, 'said'))))",
    ),
    "doc_head_100": S.select(S.DOCS, S.SENTENCES, "SELECT cid, doc_id, sent_idx, sent FROM s WHERE sent_idx < 100"),
    "doc_denylist_antijoin": "SELECT source AS cid, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "doc_semi_join": "SELECT source AS cid, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "cluster_query_pairs": S.select(S.QUERY, "SELECT DISTINCT cid, query FROM q JOIN documents ON source = cid"),
    "term_count_vectors": S.select(S.DOCS, S.SENTENCES, S.QUERY, S.COUNTS, "SELECT cid, doc_id, sent_idx, term, tf FROM st"),
    "tf_weights": S.select(S.DOCS, S.SENTENCES, S.QUERY, S.COUNTS, "SELECT cid, doc_id, sent_idx, term, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY cid, doc_id, sent_idx)), 6) AS w FROM st"),
    "sweep_conf_20": S.select(
        S.BASE, _LIVE, S.shares("lv"), "g AS (SELECT round(0.05 * k, 2) AS conf FROM (SELECT unnest(generate_series(1, 20)) AS k))",
        "SELECT CAST(conf AS DOUBLE) AS conf, cid, count(*) AS n, round(sum(score), 6) AS mass FROM cu JOIN g ON before < conf GROUP BY ALL",
    ),
    "sweep_topk": S.select(
        S.BASE, S.top(max(K_GRID)), f"g AS (SELECT CAST(unnest({K_GRID}) AS INTEGER) AS k)",
        "SELECT k, cid, count(*) AS n, round(sum(score), 6) AS mass FROM tk JOIN g ON rank <= k GROUP BY ALL",
    ),
    "oracle_retrieval": _retrieve("q AS (SELECT 'src' || (item_id - 20) AS cid, text AS query FROM benchmark WHERE item_id BETWEEN 20 AND 39)"),
}
