"""Passages, context windows, span scores and ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import corpus, ensemble, passages, rank, scoring

from . import sql as S
from .retrieval import CONF, KEY, scored

PASSAGE = ["cid", "doc_id", "p_idx"]
SENTENCE_K, PASSAGE_K = 60, 30


def passages_of(spark, sf_dir) -> DataFrame:
    return passages.joined(passages.of_documents(corpus.documents(spark, sf_dir)))


def sliding_passages(spark, sf_dir):
    return passages_of(spark, sf_dir).select(*PASSAGE, "start", F.size("sents").alias("n_sents"), F.length("sent").alias("n_chars"))


def scored_passages(spark, sf_dir) -> DataFrame:
    return scoring.tf_relevance(passages_of(spark, sf_dir), corpus.cluster_queries(spark, sf_dir))


def passage_retrieval(spark, sf_dir):
    out = rank.retrieve(scored_passages(spark, sf_dir).select(*PASSAGE, "score"), "conf", CONF, ties=("doc_id", "p_idx"))
    return out.select(*PASSAGE, "rank", F.round("score", 6).alias("score"))


def _best_passages(spark, sf_dir) -> DataFrame:
    return rank.top_k(rank.prune(scored_passages(spark, sf_dir)), PASSAGE_K, ties=("doc_id", "p_idx"))


def passages_semi_join(spark, sf_dir):
    found = passages.retrieved(passages_of(spark, sf_dir), _best_passages(spark, sf_dir))
    return found.select(*PASSAGE, F.size("sents").alias("n_sents"))


def passage_sentences(spark, sf_dir) -> DataFrame:
    """Sentences of the best passages, each with its passage's score."""
    rows = _best_passages(spark, sf_dir).select(*PASSAGE, "score", F.explode("sents").alias("e"))
    return rows.select("cid", F.col("doc_id").alias("doc_id"), F.col("p_idx").alias("pid"), "e.sent_idx", "e.sent", "score")


def passage_max_merge(spark, sf_dir):
    out = ensemble.best_of_passages(passage_sentences(spark, sf_dir), tuple(KEY))
    return out.select(*KEY, F.round("score", 6).alias("score"), "sent")


def _context(window: int):
    def query(spark, sf_dir):
        sents = corpus.sentences(corpus.documents(spark, sf_dir)).drop("orig")
        return corpus.with_context(sents, window).select(*KEY, "context")

    return query


SPANS = [(0, 8), (8, 20), (20, 32), (0, -1)]


def span_score(spark, sf_dir):
    """Scores of three spans a vector, whose halves serve as the logits of starts and ends."""
    rows = corpus.table(spark, sf_dir, "embeddings")
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in SPANS])
    rows = rows.select(F.col("label").alias("cid"), F.col("vec_id").alias("pid"), F.slice("embedding", 1, 32).alias("start_logits"), F.slice("embedding", 33, 32).alias("end_logits"), spans.alias("spans"))
    return ensemble.span_scores(rows).select("cid", "pid", "span_idx", F.round("score", 6).alias("score"))


def both_records(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    best = rank.top_k(rank.prune(scored(spark, sf_dir)), SENTENCE_K)
    return ensemble.scorer_records(best), ensemble.scorer_records(passage_sentences(spark, sf_dir), passages=True)


def _ensemble(mode: str, weight: float = 0.0):
    def query(spark, sf_dir):
        out = ensemble.combine(*both_records(spark, sf_dir), mode, weight)
        return out.select("cid", "sent", F.round("score", 6).alias("score"))

    return query


def ensemble_rank_topk(spark, sf_dir):
    """The combined records, ranked, renumbered by rank, the best 90."""
    out = ensemble.combine(*both_records(spark, sf_dir), "weight_avg_sent_only", 0.3)
    out = rank.top_k(out, 90, ties=("sent",))
    return out.select("cid", "rank", F.concat(F.lit("0_"), (F.col("rank") - 1).cast("string")).alias("sid"), F.round("score", 6).alias("score"), "sent")


QUERIES = {f.__name__: f for f in (sliding_passages, passage_retrieval, passages_semi_join, passage_max_merge, span_score, ensemble_rank_topk)}
QUERIES |= {f"context_window_w{w}": _context(w) for w in (1, 2)}
QUERIES |= {f"ensemble_{m}": _ensemble(m) for m in ("sqrt", "avg", "sqrt_global", "avg_global")} | {"ensemble_weighted_sent_only": _ensemble("weight_avg_sent_only", 0.3)}

_PASSAGES = """pa AS (SELECT cid, doc_id, CAST(start // 4 AS INTEGER) AS p_idx, CAST(start AS INTEGER) AS start, arr[start + 1:start + 8] AS sents, array_to_string(arr[start + 1:start + 8], ' ') AS sent
    FROM sa, unnest(CASE WHEN len(arr) > 4 THEN generate_series(0, len(arr) - 5, 4) ELSE [] END) AS g(start))"""
_PASSAGE_SCORES = rf"""pt AS (SELECT cid, doc_id, p_idx, term, count(*) AS tf FROM (SELECT cid, doc_id, p_idx, unnest(regexp_extract_all(lower(sent), {S.TERM})) AS term FROM pa) GROUP BY ALL),
pn AS (SELECT cid, doc_id, p_idx, sqrt(sum(tf * tf)) AS norm FROM pt GROUP BY ALL),
pd AS (SELECT cid, doc_id, p_idx, CAST(sum(pt.tf * qt.tf) AS DOUBLE) AS dot FROM pt JOIN qt USING (cid, term) GROUP BY ALL),
ps AS (SELECT pa.*, coalesce(dot / (pn.norm * qn.norm), 0.0) AS score FROM pa JOIN q USING (cid) LEFT JOIN pd USING (cid, doc_id, p_idx)
    LEFT JOIN pn USING (cid, doc_id, p_idx) LEFT JOIN qn USING (cid))"""
_RANK = "CAST(row_number() OVER (PARTITION BY cid ORDER BY round(score, 9) DESC, doc_id, p_idx) AS INTEGER) AS rank"
_PBASE = [S.BASE, _PASSAGES, _PASSAGE_SCORES]
_PSHARES = f"""pc AS (SELECT *, coalesce(round((cum - score) / nullif(total, 0), 9), 0) AS before FROM
    (SELECT *, {_RANK}, sum(score) OVER (PARTITION BY cid ORDER BY round(score, 9) DESC, doc_id, p_idx ROWS UNBOUNDED PRECEDING) AS cum,
     sum(score) OVER (PARTITION BY cid) AS total, max(score) OVER (PARTITION BY cid) AS best FROM ps))"""
_PTOP = f"pk AS (SELECT * FROM (SELECT *, {_RANK} FROM ps WHERE score > 1e-10) WHERE rank <= {PASSAGE_K})"
_PSENTS = """pe AS (SELECT cid, doc_id, p_idx, CAST(start + generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx, unnest(sents) AS sent, score FROM pk)"""
_BOTH = [
    *_PBASE, _PTOP, _PSENTS, S.top(SENTENCE_K),
    "es AS (SELECT cid, sent, max(score) AS s FROM tk GROUP BY ALL)", "ep AS (SELECT cid, sent, max(tanh(sqrt(score))) AS p FROM pe GROUP BY ALL)",
]


def _context_sql(window: int) -> str:
    parts, number = ["sent"], 0
    for k in range(1, window + 1):
        for f in ("lag", "lead"):
            number += 1
            parts.append(f"'[unused{number}] ' || coalesce({f}(sent, {k}) OVER w, '')")
    return S.select(S.DOCS, S.SENTENCES, f"SELECT cid, doc_id, sent_idx, concat_ws(' ', {', '.join(parts)}) AS context FROM s WINDOW w AS (PARTITION BY cid, doc_id ORDER BY sent_idx)")


def _ensemble_sql(both: str, alone: str, join: str = "FULL OUTER") -> str:
    score = f"CASE WHEN s IS NOT NULL AND p IS NOT NULL THEN {both} WHEN {alone} <> 0 THEN {alone} END"
    return f"en AS (SELECT * FROM (SELECT cid, sent, {score} AS score FROM es {join} JOIN ep USING (cid, sent)) WHERE score IS NOT NULL)"


_ENSEMBLES = {
    "ensemble_sqrt": ("sqrt(s * p)", "coalesce(s, p)"),
    "ensemble_avg": ("(s + p) / 2", "coalesce(s, p)"),
    "ensemble_sqrt_global": ("sqrt(s * p)", "0.001 * coalesce(s, p)"),
    "ensemble_avg_global": ("(s + p) / 2", "coalesce(s, p) / 2"),
    "ensemble_weighted_sent_only": ("0.7 * s + 0.3 * p", "0.7 * s", "LEFT"),
}

ORACLE = {
    "sliding_passages": S.select(S.DOCS, S.SENTENCES, _PASSAGES, "SELECT cid, doc_id, p_idx, start, CAST(len(sents) AS INTEGER) AS n_sents, CAST(length(sent) AS INTEGER) AS n_chars FROM pa"),
    "passage_retrieval": S.select(*_PBASE, _PSHARES, f"SELECT cid, doc_id, p_idx, rank, round(score, 6) AS score FROM pc WHERE best = 0 OR (score > 1e-10 AND before < {CONF})"),
    "passages_semi_join": S.select(*_PBASE, _PTOP, "SELECT cid, doc_id, p_idx, CAST(len(sents) AS INTEGER) AS n_sents FROM pk"),
    "passage_max_merge": S.select(*_PBASE, _PTOP, _PSENTS, "SELECT cid, doc_id, sent_idx, round(max(score), 6) AS score, any_value(sent) AS sent FROM pe GROUP BY cid, doc_id, sent_idx"),
    "context_window_w1": _context_sql(1),
    "context_window_w2": _context_sql(2),
    "span_score": """WITH sp AS (SELECT label AS cid, vec_id AS pid, CAST(k AS INTEGER) AS span_idx, [0, 8, 20][k + 1] AS s, [8, 20, 32][k + 1] AS e, CAST(embedding AS DOUBLE[]) AS v
    FROM embeddings, unnest([0, 1, 2]) AS g(k)),
x AS (SELECT cid, pid, span_idx, i, e, v FROM sp, unnest(generate_series(s + 1, e)) AS g(i)),
y AS (SELECT cid, pid, span_idx, exp(v[i]) * exp(v[32 + j]) AS score FROM x, unnest(generate_series(i, e)) AS g(j))
SELECT cid, pid, span_idx, round(max(score), 6) AS score FROM y GROUP BY ALL""",
    "ensemble_rank_topk": S.select(
        *_BOTH, _ensemble_sql("0.7 * s + 0.3 * p", "0.7 * s", "LEFT"),
        "rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY cid ORDER BY round(score, 9) DESC, sent) AS INTEGER) AS rank FROM en)",
        "SELECT cid, rank, '0_' || (rank - 1) AS sid, round(score, 6) AS score, sent FROM rk WHERE rank <= 90",
    ),
} | {name: S.select(*_BOTH, _ensemble_sql(*x), "SELECT cid, sent, round(score, 6) AS score FROM en") for name, x in _ENSEMBLES.items()}
