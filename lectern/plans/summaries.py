"""Summaries from rankings, lead baselines, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import corpus, evaluate, graph, rank, summarize
from lectern.operators.store import once

from . import flow, similarity
from . import sql as S
from .retrieval import CONF_GRID, KEY, scored
from .similarity import markov_scores

BUDGET = 250


def _ranking(spark, sf_dir) -> DataFrame:
    """(cid, rank, orig, sent): the best 90 of each cluster."""
    rows = rank.top_k(rank.prune(scored(spark, sf_dir)), 90)
    return rows.select("cid", "rank", F.col("sent").alias("orig"), "sent")


def selected(spark, sf_dir, cosine: float = 1.0, budget: int = BUDGET) -> DataFrame:
    return summarize.select(_ranking(spark, sf_dir), budget, cosine)


def select_budget_cos1(spark, sf_dir):
    return selected(spark, sf_dir)


def select_budget_cos06(spark, sf_dir):
    return selected(spark, sf_dir, summarize.COSINE)


def summary_text(spark, sf_dir):
    return summarize.text_of(selected(spark, sf_dir))


def centrality_summary(spark, sf_dir, omega: float = 4.0):
    """The whole last stage: graph, biased walk, diverse ranking, selection."""
    nodes, edges, walked = markov_scores(spark, sf_dir)
    order = graph.diversity_rank(once(walked), edges, omega)
    rows = order.join(nodes.select("cid", "i", F.col("sent").alias("orig"), "sent"), ["cid", "i"])
    return summarize.text_of(summarize.select(rows, BUDGET, summarize.COSINE))


def lead_docs_50(spark, sf_dir):
    return summarize.lead(corpus.sentences(corpus.documents(spark, sf_dir))).select(*KEY, "orig")


def _candidates(spark, sf_dir) -> DataFrame:
    return summary_text(spark, sf_dir).select("cid", F.col("summary").alias("text"))


def _percent(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("cid", *[evaluate.percent(F.col(c)).alias(c) for c in columns])


def _rouge(metric: str, length: int | None):
    def query(spark, sf_dir):
        out = evaluate.scores(_candidates(spark, sf_dir), corpus.references(spark, sf_dir), metric, length)
        return _percent(out, "recall", "precision", "f1")

    return query


def rouge1_stemmed(spark, sf_dir):
    out = evaluate.scores(_candidates(spark, sf_dir), corpus.references(spark, sf_dir), "rouge1", stem=True)
    return _percent(out, "recall", "precision", "f1")


TUNED = CONF_GRID


def sweep_conf_rouge2(spark, sf_dir):
    """Mean ROUGE-2 of the retrieved text for each confidence."""
    out = flow.tune_retrieval(scored(spark, sf_dir), corpus.references(spark, sf_dir), "conf", TUNED)
    return out.select("value", evaluate.percent(F.col("recall")).alias("recall"), evaluate.percent(F.col("f1")).alias("f1"))


OMEGAS = list(range(21))


def sweep_omega(spark, sf_dir):
    """Mean ROUGE-2 of the whole flow for each penalty."""
    out = flow.tune_omega(corpus.documents(spark, sf_dir), corpus.cluster_queries(spark, sf_dir), corpus.references(spark, sf_dir), OMEGAS)
    return out.select("omega", evaluate.percent(F.col("recall")).alias("recall"), evaluate.percent(F.col("f1")).alias("f1"))


def human_leave_one_out(spark, sf_dir):
    return _percent(evaluate.leave_one_out(corpus.references(spark, sf_dir), "rouge2"), "recall", "f1")


def reference_counts(spark, sf_dir):
    return evaluate.reference_counts(corpus.references(spark, sf_dir))


QUERIES = {f.__name__: f for f in (select_budget_cos1, select_budget_cos06, summary_text, centrality_summary, lead_docs_50, rouge1_stemmed, sweep_conf_rouge2, sweep_omega, human_leave_one_out, reference_counts)}
QUERIES |= {"rouge1": _rouge("rouge1", None), "rouge2": _rouge("rouge2", None), "rouge_su4": _rouge("rougeSU4", None), "rouge_truncated_250": _rouge("rouge2", 250)}

_SELECT = [
    S.BASE, S.top(90), f"nw AS (SELECT *, len(regexp_extract_all(sent, {S.WORD})) AS n FROM tk)",
    "bw AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM nw)",
    f"sel AS (SELECT cid, CAST(row_number() OVER (PARTITION BY cid ORDER BY rank) AS INTEGER) AS pos, rank, sent AS orig FROM bw WHERE used < {BUDGET})",
    "summ AS (SELECT cid, string_agg(orig, chr(10) ORDER BY pos) AS text FROM sel GROUP BY cid)",
]
#: The selection that skips what is like a chosen sentence, over ranked sentences ``rr`` (cid, rank, sent): one rank a step.
_ALIKE = [
    f"nw AS (SELECT cid, rank, sent, len(regexp_extract_all(sent, {S.WORD})) AS n FROM rr)",
    r"bg AS (SELECT cid, rank, t, count(*) AS c FROM (SELECT cid, rank, unnest(string_split(sent, ' ')) AS t FROM rr) GROUP BY ALL)",
    "bn AS (SELECT cid, rank, sqrt(sum(c * c)) AS norm FROM bg GROUP BY ALL)",
    "dt AS (SELECT a.cid, a.rank AS i, b.rank AS j, sum(a.c * b.c) AS dot FROM bg a JOIN bg b ON a.cid = b.cid AND a.t = b.t AND b.rank < a.rank GROUP BY ALL)",
    f"""lk AS (SELECT dt.cid, i AS rank, list(j) AS alike FROM dt JOIN bn x ON x.cid = dt.cid AND x.rank = i JOIN bn y ON y.cid = dt.cid AND y.rank = j
    WHERE dot / (x.norm * y.norm) >= {summarize.COSINE} GROUP BY ALL)""",
    "cand AS (SELECT nw.cid, nw.rank, nw.n, coalesce(alike, []) AS alike FROM nw LEFT JOIN lk USING (cid, rank))",
    f"""taken AS (SELECT DISTINCT cid, 0 AS rank, CAST([] AS INTEGER[]) AS chosen, CAST(0 AS BIGINT) AS used FROM nw UNION ALL
    SELECT c.cid, c.rank, CASE WHEN ok THEN list_append(chosen, c.rank) ELSE chosen END, CASE WHEN ok THEN used + c.n ELSE used END
    FROM (SELECT c.*, w.chosen, w.used, w.used < {BUDGET} AND NOT list_has_any(c.alike, w.chosen) AS ok FROM taken w JOIN cand c ON c.cid = w.cid AND c.rank = w.rank + 1) c)""",
    "last AS (SELECT cid, max_by(chosen, rank) AS chosen FROM taken GROUP BY cid)",
    "kept AS (SELECT nw.cid, CAST(list_position(chosen, nw.rank) AS INTEGER) AS pos, nw.rank, sent AS orig FROM nw JOIN last USING (cid) WHERE list_contains(chosen, nw.rank))",
]
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_GRAMS = {
    "rouge1": "SELECT {k}, ws[i] AS g FROM {t}, unnest(generate_series(1, len(ws))) AS x(i)",
    "rouge2": "SELECT {k}, ws[i] || ' ' || ws[i + 1] AS g FROM {t}, unnest(generate_series(1, len(ws) - 1)) AS x(i)",
    "rougeSU4": """SELECT {k}, ws[i] AS g FROM {t}, unnest(generate_series(1, len(ws))) AS x(i) UNION ALL
    SELECT {k}, ws[i] || ' ' || ws[i + e] AS g FROM {t}, unnest(generate_series(1, len(ws))) AS x(i), unnest([1, 2, 3, 4, 5]) AS y(e) WHERE i + e <= len(ws)""",
}


def _overlap(metric: str, length: int | None, candidates: str, other: bool = False) -> list[str]:
    cut = f"{_TOKENS}[1:{length}]" if length else _TOKENS
    return [
        f"ct AS (SELECT cid, cand, {cut} AS ws FROM {candidates})", f"rt AS (SELECT cid, ref_idx, {cut} AS ws FROM ref)",
        f"cg AS ({_GRAMS[metric].format(k='cid, cand', t='ct')})", f"rg AS ({_GRAMS[metric].format(k='cid, ref_idx', t='rt')})",
        "cc AS (SELECT cid, cand, g, count(*) AS c FROM cg GROUP BY ALL)", "rc AS (SELECT cid, ref_idx, g, count(*) AS r FROM rg GROUP BY ALL)",
        "cn AS (SELECT ct.cid, ct.cand, count(g) AS nc FROM ct LEFT JOIN cg ON cg.cid = ct.cid AND cg.cand = ct.cand GROUP BY ALL)",
        "rn AS (SELECT rt.cid, rt.ref_idx, count(g) AS nr FROM rt LEFT JOIN rg ON rg.cid = rt.cid AND rg.ref_idx = rt.ref_idx GROUP BY ALL)",
        "hit AS (SELECT cid, cand, ref_idx, sum(least(c, r)) AS hit FROM cc JOIN rc USING (cid, g) GROUP BY ALL)",
        f"""pr AS (SELECT cn.cid, cn.cand, rn.ref_idx, coalesce(hit / nullif(nr, 0), 0.0) AS recall, coalesce(hit / nullif(nc, 0), 0.0) AS precision
        FROM cn JOIN rn ON cn.cid = rn.cid {'AND cn.cand <> rn.ref_idx' if other else ''} LEFT JOIN hit ON hit.cid = cn.cid AND hit.cand = cn.cand AND hit.ref_idx = rn.ref_idx)""",
        "pf AS (SELECT *, coalesce(2 * recall * precision / nullif(recall + precision, 0), 0.0) AS f1 FROM pr)",
    ]


def _rouge_sql(metric: str, length: int | None) -> str:
    return S.select(
        *_SELECT, S.REFERENCES, "cand AS (SELECT cid, 0 AS cand, text FROM summ)", *_overlap(metric, length, "cand"),
        "SELECT cid, round(avg(recall) * 100, 2) AS recall, round(avg(precision) * 100, 2) AS precision, round(avg(f1) * 100, 2) AS f1 FROM pf GROUP BY cid",
    )


ORACLE = {
    "select_budget_cos1": S.select(*_SELECT, "SELECT cid, pos, rank, orig FROM sel"),
    "select_budget_cos06": S.select(S.BASE, S.top(90), "rr AS (SELECT cid, rank, sent FROM tk)", *_ALIKE, "SELECT * FROM kept", recursive=True),
    "centrality_summary": S.select(
        *similarity.GRAPH, similarity.walk_sql("rel"), similarity.greedy_sql(4),
        "rr AS (SELECT rec.cid, rec.step AS rank, tk.sent FROM rec JOIN nd ON nd.cid = rec.cid AND nd.i = rec.k - 1 JOIN tk ON tk.cid = nd.cid AND tk.doc_id = nd.doc_id AND tk.sent_idx = nd.sent_idx WHERE step > 0)",
        *_ALIKE, "SELECT cid, string_agg(orig, chr(10) ORDER BY pos) AS summary FROM kept GROUP BY cid", recursive=True,
    ),
    "summary_text": S.select(*_SELECT, "SELECT cid, text AS summary FROM summ"),
    "lead_docs_50": S.select(
        S.DOCS, S.SENTENCES, "n AS (SELECT cid, doc_id, count(*) AS n FROM s GROUP BY ALL)",
        "k AS (SELECT *, row_number() OVER w AS k, coalesce(sum(n) OVER (PARTITION BY cid ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n WINDOW w AS (PARTITION BY cid ORDER BY doc_id))",
        "SELECT cid, doc_id, sent_idx, sent AS orig FROM s JOIN k USING (cid, doc_id) WHERE k <= 10 AND used < 50",
    ),
    "rouge1": _rouge_sql("rouge1", None),
    "rouge2": _rouge_sql("rouge2", None),
    "rouge_su4": _rouge_sql("rougeSU4", None),
    "rouge_truncated_250": _rouge_sql("rouge2", 250),
    "sweep_conf_rouge2": S.select(
        S.BASE, "lv AS (SELECT * FROM sc WHERE score > 1e-10)", S.shares("lv"), f"tv AS (SELECT unnest({TUNED}) AS cand)",
        "rows_of AS (SELECT cid, CAST(cand AS DOUBLE) AS cand, rank, sent FROM cu JOIN tv ON before < cand)",
        "cand AS (SELECT cid, cand, string_agg(sent, chr(10) ORDER BY rank) AS text FROM rows_of WHERE rank <= 250 GROUP BY ALL)",
        S.REFERENCES, *_overlap("rouge2", 250, "cand"), "one AS (SELECT cid, cand, avg(recall) AS recall, avg(f1) AS f1 FROM pf GROUP BY ALL)",
        "SELECT cand AS value, round(avg(recall) * 100, 2) AS recall, round(avg(f1) * 100, 2) AS f1 FROM one GROUP BY cand",
    ),
    "human_leave_one_out": S.select(
        S.REFERENCES, "cand AS (SELECT cid, ref_idx AS cand, text FROM ref)", *_overlap("rouge2", 250, "cand", True),
        "one AS (SELECT cid, cand, avg(recall) AS recall, avg(f1) AS f1 FROM pf GROUP BY ALL)",
        "SELECT cid, round(avg(recall) * 100, 2) AS recall, round(avg(f1) * 100, 2) AS f1 FROM one GROUP BY cid",
    ),
    "reference_counts": S.select(S.REFERENCES, "SELECT cid, count(DISTINCT ref_idx) AS n_refs FROM ref GROUP BY cid"),
}
