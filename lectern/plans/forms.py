"""Paragraphs, stored forms of records and sentences, layouts of model inputs, masks and scaled graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import layouts
from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import corpus, graph, summarize
from lectern.sources import readers, writers

from . import retrieval, similarity
from . import sql as S

PARAGRAPHS, LAYOUT = 20, 64


def normalised_paragraphs(spark, sf_dir):
    """The first paragraphs of each English document, their sentences without stop words and joined again."""
    rows = corpus.paragraphs(corpus.documents(spark, sf_dir, "en"), PARAGRAPHS, rm_stop=True)
    return rows.select("cid", "doc_id", "para_idx", "orig", "proc")


def topic_tiles(spark, sf_dir):
    """Each document cut where its words change."""
    rows = corpus.paragraphs(corpus.documents(spark, sf_dir), tiled=True)
    return rows.select("cid", "doc_id", "para_idx", F.length("para").alias("n_chars"))


def record_lines(spark, sf_dir):
    """Ranked records as lines of text, and read from them."""
    lines = writers.record_lines(retrieval.rank_records(spark, sf_dir))
    return readers.text_records(lines.select("cid", (F.col("rank") - 1).alias("line_no"), F.col("value").alias("line")))


def retrieved_sentences(spark, sf_dir):
    """Ranked records as the sentences of one document a cluster, without dialogue."""
    rows = readers.retrieved_sentences(retrieval.rank_records(spark, sf_dir), rm_dialog=True)
    return rows.select("cid", "doc_idx", "sent_idx", "orig", "sent")


def sentence_lines(spark, sf_dir):
    """Documents as files with a sentence a line: numbered in the order of their names, lines that are short left out."""
    files = corpus.documents(spark, sf_dir).select("cid", F.col("doc_id").cast("string").alias("name"), F.col("text").alias("raw"))
    return readers.sentence_lines(files, rm_short=True).select("cid", "doc_idx", "sent_idx", "orig", "sent")


def merged_queries(spark, sf_dir):
    """Queries of two years, the first year's where both have a cluster; every cluster with its query."""
    own = corpus.cluster_queries(spark, sf_dir)
    late = corpus.references(spark, sf_dir).select("cid", F.col("text").alias("query")).where("ref_idx = 2")
    early = own.where(F.substring("cid", -1, 1) != "3")
    return readers.paired(own.select("cid"), readers.merged_years([early, late])).select("cid", "query")


def reference_targets(spark, sf_dir):
    """Reference files of each cluster, numbered by their names."""
    files = corpus.references(spark, sf_dir).select(F.upper("cid").alias("prefix"), F.concat(F.upper("cid"), F.lit(".M."), F.col("ref_idx").cast("string")).alias("name"))
    return readers.reference_targets(files, corpus.cluster_queries(spark, sf_dir).select("cid"), lower=True).select("cid", "ref_idx", "name")


def peer_leads(spark, sf_dir):
    """Files of the peer whose names match."""
    files = corpus.references(spark, sf_dir).select("cid", F.concat("cid", F.lit(".M."), F.col("ref_idx").cast("string")).alias("name"), "text")
    return summarize.lead_files(files, r"\.M\.1$").select("cid", "name", "text")


def model_inputs(spark, sf_dir):
    """The layout of query and sentence in front of a model, for the ranked sentences."""
    rows = similarity.top_sentences(spark, sf_dir).join(corpus.cluster_queries(spark, sf_dir), "cid")
    x = layouts.pair(T.words(F.lower("query")), T.words(F.col("sent")), LAYOUT, 20, 30)
    rows = rows.select("cid", "rank", x.alias("x"))
    return rows.select("cid", "rank", F.array_join("x.tokens", " ").alias("tokens"), F.array_join(F.col("x.segments").cast("array<string>"), "").alias("segments"), F.aggregate("x.mask", F.lit(0.0), lambda a, m: a + m).cast("int").alias("n"))


def masked_similarity(spark, sf_dir):
    """Cosines of vectors with the first of their label, where padding (here ids divisible by 3) is like nothing."""
    rows = similarity.to_triggers(spark, sf_dir, 1)
    valid = V.masked(V.cosine(F.col("a"), F.col("b")), F.col("vec_id") % 3 != 0, F.col("t") % 3 != 0)
    return rows.select("label", "vec_id", F.round(valid, 6).alias("score"))


def scaled_edges(spark, sf_dir):
    """The sentence graph with weights scaled to the largest of its cluster."""
    top = similarity.top_sentences(spark, sf_dir)
    rows = graph.scaled_edges(graph.edges(similarity.edges_of(spark, sf_dir, nodes=top), graph.nodes(top.select(*retrieval.KEY, "sent", "score"))))
    return rows.select("cid", "i", "j", F.round("w", 6).alias("w"))


QUERIES = {
    f.__name__: f
    for f in (
        normalised_paragraphs, topic_tiles, record_lines, retrieved_sentences, sentence_lines, merged_queries, reference_targets, peer_leads, model_inputs,
        masked_similarity, scaled_edges,
    )
}

_STOPPED = S.without_stopwords("e.s")
_RANKED = [S.BASE, S.top(retrieval.TOP_K)]
_WORDS = S.WORD

ORACLE = {
    "normalised_paragraphs": S.select(
        S.ENGLISH_DOCS,
        rf"""pl AS (SELECT cid, doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n([ \t\r]*\n)+'), lambda x: trim(x)), lambda x: x <> '')[1:{PARAGRAPHS}] AS ps FROM d),
pp AS (SELECT cid, doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS para_idx, unnest(ps) AS para FROM pl),
pa AS (SELECT cid, doc_id, para_idx, list_filter(list_transform(regexp_split_to_array(regexp_replace(para, '([.!?])[ \t\n\r]+', '\1' || chr(10), 'g'), '\n+'),
    lambda x: trim(regexp_replace(lower(x), '[ \t\n\r]+', ' ', 'g'))), lambda x: x <> '') AS arr FROM pp),
pe AS (SELECT cid, doc_id, para_idx, generate_subscripts(arr, 1) AS k, unnest(arr) AS s FROM pa),
pf AS (SELECT cid, doc_id, para_idx, k, e.s AS orig, {_STOPPED} AS proc FROM pe e)""",
        """SELECT pp.cid, pp.doc_id, pp.para_idx, coalesce(string_agg(orig, ' ' ORDER BY k) FILTER (proc <> ''), '') AS orig, coalesce(string_agg(proc, ' ' ORDER BY k) FILTER (proc <> ''), '') AS proc
FROM pp LEFT JOIN pf ON pf.cid = pp.cid AND pf.doc_id = pp.doc_id AND pf.para_idx = pp.para_idx GROUP BY ALL""",
    ),
    "record_lines": S.select(*_RANKED, "SELECT cid, rank, doc_id || '_' || sent_idx AS sid, round(score, 6) AS score, sent FROM tk"),
    "retrieved_sentences": S.select(
        *_RANKED, "SELECT cid, 0 AS doc_idx, rank - 1 AS sent_idx, sent AS orig, CASE WHEN NOT (contains(sent, '''''') OR contains(sent, '``')) THEN sent END AS sent FROM tk",
    ),
    "sentence_lines": S.select(
        S.DOCS, r"sl AS (SELECT cid, doc_id, string_split(text, chr(10)) AS ls FROM d)",
        "sn AS (SELECT cid, doc_id, CAST(dense_rank() OVER (PARTITION BY cid ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS INTEGER) AS doc_idx, ls FROM sl)",
        r"se AS (SELECT cid, doc_idx, k, trim(regexp_replace(lower(l), '[ \t\n\r]+', ' ', 'g')) AS orig FROM (SELECT cid, doc_idx, generate_subscripts(ls, 1) AS k, unnest(ls) AS l FROM sn))",
        f"SELECT cid, doc_idx, CAST(row_number() OVER (PARTITION BY cid, doc_idx ORDER BY k) - 1 AS INTEGER) AS sent_idx, orig, orig AS sent FROM se WHERE orig <> '' AND len(regexp_extract_all(orig, {_WORDS})) >= {T.MIN_WORDS}",
    ),
    "merged_queries": S.select(S.QUERY, S.REFERENCES, "SELECT q.cid, CASE WHEN q.cid LIKE '%3' THEN ref.text ELSE q.query END AS query FROM q JOIN ref ON ref.cid = q.cid AND ref.ref_idx = 2"),
    "reference_targets": S.select(
        S.QUERY, S.REFERENCES, "fs AS (SELECT cid AS prefix, upper(cid) || '.M.' || ref_idx AS name FROM ref)",
        "SELECT q.cid, CAST(row_number() OVER (PARTITION BY q.cid ORDER BY name) AS INTEGER) AS ref_idx, name FROM q JOIN fs ON starts_with(q.cid, prefix)",
    ),
    "peer_leads": S.select(S.REFERENCES, "SELECT cid, cid || '.M.1' AS name, text FROM ref WHERE ref_idx = 1"),
    "model_inputs": S.select(
        *_RANKED, f"x AS (SELECT tk.cid, rank, regexp_extract_all(lower(query), {_WORDS})[1:20] AS q, regexp_extract_all(sent, {_WORDS})[1:30] AS s FROM tk JOIN q USING (cid))",
        "y AS (SELECT cid, rank, list_concat(['[CLS]'], q, ['[SEP]'], s, ['[SEP]']) AS t, len(q) + 2 AS a, len(s) + 1 AS b FROM x)",
        f"""SELECT cid, rank, rtrim(array_to_string(t, ' ') || repeat(' [PAD]', CAST({LAYOUT} - a - b AS INTEGER))) AS tokens,
    rpad(repeat('0', CAST(a AS INTEGER)) || repeat('1', CAST(b AS INTEGER)), {LAYOUT}, '0') AS segments, CAST(a + b AS INTEGER) AS n FROM y""",
    ),
    "masked_similarity": S.select(
        similarity._TRIGGERS.format(k=1), f"SELECT label, vec_id, round(CASE WHEN vec_id % 3 <> 0 AND t % 3 <> 0 THEN {similarity._COSINE} ELSE 0 END, 6) AS score FROM tr",
    ),
    "scaled_edges": S.select(*similarity.GRAPH, "SELECT cid, i, j, round(w / max(w) OVER (PARTITION BY cid), 6) AS w FROM ge"),
}
