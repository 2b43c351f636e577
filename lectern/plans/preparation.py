"""Corpus preparation: identifiers, paragraphs, answer sentences, samples and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import corpus
from lectern.sources import readers

from . import sql as S
from .retrieval import KEY

TOPICS = (
    "<num> d301i </num>\n<title> International Organized Crime </title>\n<narr>\nIdentify and describe crime.\nName the groups.\n</narr>\n\n\n"
    "<num> d302j </num>\n<title> Steel strikes. </title>\n<narr>\nWhat did the strikes change?\n</narr>"
)


def cluster_listing(spark, sf_dir):
    return corpus.documents(spark, sf_dir, None).groupBy("cid").agg(F.count("*").alias("n_docs"))


def composite_ids(spark, sf_dir):
    """Sentence ids built from their parts and taken apart again."""
    sents = corpus.sentences(corpus.documents(spark, sf_dir))
    sid = readers.join_id("doc_id", "sent_idx")
    back = sents.withColumn("sid", sid)
    return back.select("cid", "sid", readers.id_part("sid", 0).cast("long").alias("doc_id"), readers.id_part("sid", 1).cast("int").alias("sent_idx"))


def topic_fields(spark, sf_dir):
    """A literal topic file through the topic reader."""
    rows = spark.createDataFrame([("2005", TOPICS)], "year string, raw string")
    return readers.topics(rows).select("cid", "title", "query")


def page_paragraphs(spark, sf_dir):
    """Paragraphs of pages by their P tags, of which some are not closed."""
    rows = corpus.table(spark, sf_dir, "pages")
    return rows.select("page_id", F.posexplode(readers.tagged_paragraphs(F.col("html"))).alias("para_idx", "para"))


def article_bodies(spark, sf_dir):
    """The first article block of each page, or else its footer."""
    rows = corpus.table(spark, sf_dir, "pages")
    return rows.select("page_id", F.length(readers.first_block(F.col("html"), "article", "footer")).alias("n_chars"))


def _doc_sentences(spark, sf_dir) -> DataFrame:
    return corpus.sentences(corpus.documents(spark, sf_dir)).drop("orig")


def _starts(spark, sf_dir) -> DataFrame:
    rows = corpus.documents(spark, sf_dir)
    return rows.select("cid", "doc_id", (F.col("doc_id") * 37 % 1000).cast("int").alias("start"))


def answer_sentence_locator(spark, sf_dir):
    out = corpus.first_match(_doc_sentences(spark, sf_dir), _starts(spark, sf_dir), ("cid", "doc_id"))
    return out.select("cid", "doc_id", "start", "sent_idx")


def pos_neg_samples(spark, sf_dir):
    """One question a document; its answer is the sentence at an offset, if the document has a good label."""
    answer = answer_sentence_locator(spark, sf_dir).select("cid", "doc_id", F.col("sent_idx").alias("found"))
    good = corpus.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    asked = corpus.documents(spark, sf_dir).select("cid", "doc_id").join(corpus.cluster_queries(spark, sf_dir), "cid")
    asked = asked.join(answer, ["cid", "doc_id"], "left").join(good, "doc_id", "left")
    questions = asked.select("cid", "doc_id", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qid"), F.col("query").alias("question"), F.when(F.col("good"), F.col("found")).alias("ans_idx"))
    return corpus.samples(questions, _doc_sentences(spark, sf_dir), ("cid", "doc_id")).select("cid", "doc_id", "qid", "yy", "sent_idx")


def sample_ratio(spark, sf_dir):
    return pos_neg_samples(spark, sf_dir).groupBy("yy").agg(F.count("*").alias("n"))


def digit_mask(spark, sf_dir):
    tokens = corpus.documents(spark, sf_dir, None).select(F.explode(F.split(F.lower("text"), T.SPACE)).alias("word")).where(F.col("word").rlike("[0-9]")).distinct()
    return tokens.select("word", T.digit_mask(F.col("word")).alias("masked"))


def punct_split(spark, sf_dir):
    return _doc_sentences(spark, sf_dir).select(*KEY, F.array_join(T.punct_split(F.col("sent")), " ").alias("tokens"))


def _sizes(spark, sf_dir):
    return corpus.size_distribution(_doc_sentences(spark, sf_dir), ("cid", "doc_id"))


def sentences_per_doc_histogram(spark, sf_dir):
    return _sizes(spark, sf_dir).select("n_sents", "n")


def sentences_per_doc_cdf(spark, sf_dir):
    return _sizes(spark, sf_dir).select("n_sents", F.round("share", 6).alias("share"), F.round("cum_share", 6).alias("cum_share"))


def question_simplify(spark, sf_dir):
    """Text before a marker; here the part of a URL before its query."""
    rows = corpus.table(spark, sf_dir, "pages")
    return rows.select("page_id", T.before_marker(F.col("url"), "?").alias("head"))


def marked_passages(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "pages")
    return rows.select("page_id", F.posexplode(T.split_marked(F.col("html"), "<p>")).alias("k", "part")).select("page_id", "k", F.length("part").alias("n_chars"))


def reference_queries(spark, sf_dir):
    """A reference's lines, joined without a separator, as the query."""
    rows = corpus.references(spark, sf_dir).where("ref_idx = 1").select("cid", F.posexplode(F.split("text", "\n")).alias("line_no", "sent"))
    return readers.reference_query(rows)


def prefix_matches(spark, sf_dir):
    """References matched to clusters whose name begins with their prefix."""
    prefixes = corpus.references(spark, sf_dir).select(F.col("cid").alias("prefix"), "ref_idx").where("ref_idx = 1")
    clusters = corpus.documents(spark, sf_dir, None).select("cid").distinct()
    return readers.match_prefix(prefixes, clusters, "prefix", "cid").select("prefix", "cid")


def context_turns(spark, sf_dir):
    """Turns of conversations with the one before and the one after."""
    rows = corpus.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("sent_idx"), "text")
    return corpus.with_context(rows, 1, ("conv_id",), "text").select("conv_id", F.col("sent_idx").alias("turn"), "context")


def length_masks(spark, sf_dir):
    """The clip of every document's sentences with its mask."""
    docs = corpus.sentences(corpus.documents(spark, sf_dir)).groupBy("cid", "doc_id").agg(F.count("*").cast("int").alias("n"))
    return docs.select("cid", "doc_id", F.array_join(T.length_mask(F.col("n"), 20).cast("array<string>"), "").alias("mask"))


QUERIES = {
    f.__name__: f
    for f in (
        cluster_listing, composite_ids, topic_fields, page_paragraphs, article_bodies, answer_sentence_locator, pos_neg_samples, sample_ratio,
        digit_mask, punct_split, sentences_per_doc_histogram, sentences_per_doc_cdf, question_simplify, marked_passages, reference_queries,
        prefix_matches, context_turns, length_masks,
    )
}

_REACH = "rc AS (SELECT *, sum(length(sent) + 1) OVER (PARTITION BY cid, doc_id ORDER BY sent_idx) - 1 AS reach FROM s)"
_FOUND = "fd AS (SELECT cid, doc_id, start, min(sent_idx) AS sent_idx FROM rc JOIN (SELECT cid, doc_id, CAST(doc_id * 37 % 1000 AS INTEGER) AS start FROM d) USING (cid, doc_id) WHERE reach > start GROUP BY ALL)"
_SAMPLES = """sm AS (SELECT s.cid, s.doc_id, 'q' || s.doc_id AS qid, CAST(s.sent_idx IS NOT DISTINCT FROM (CASE WHEN s.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN fd.sent_idx END) AS INTEGER) AS yy, s.sent_idx
    FROM s JOIN q USING (cid) LEFT JOIN fd ON fd.cid = s.cid AND fd.doc_id = s.doc_id)"""
_SIZES = "sz AS (SELECT n_sents, count(*) AS n FROM (SELECT count(*) AS n_sents FROM s GROUP BY cid, doc_id) GROUP BY n_sents)"
_MASK = r"CASE WHEN regexp_full_match({w}, '([0-9]+[.,])*[0-9]+') THEN repeat('N', least(length(regexp_extract(replace({w}, ',', ''), '^([0-9]+)', 1)), 5)) ELSE {w} END"

ORACLE = {
    "cluster_listing": "SELECT source AS cid, count(*) AS n_docs FROM documents GROUP BY ALL",
    "composite_ids": S.select(S.DOCS, S.SENTENCES, "SELECT cid, doc_id || '_' || sent_idx AS sid, doc_id, sent_idx FROM s"),
    "topic_fields": """SELECT * FROM (VALUES ('2005_d301i', 'International Organized Crime', 'describe International Organized Crime. Identify and describe crime. Name the groups.'),
    ('2005_d302j', 'Steel strikes.', 'describe Steel strikes. What did the strikes change?')) AS t(cid, title, query)""",
    "page_paragraphs": r"""WITH a AS (SELECT page_id, list_filter(list_transform(string_split_regex(html, '<[pP]( [^>]*)?>')[2:],
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '</[pP]>.*$', '', 's'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))), lambda x: x <> '') AS arr FROM pages)
SELECT page_id, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS para_idx, unnest(arr) AS para FROM a""",
    "article_bodies": r"""SELECT page_id, CAST(length(coalesce(nullif(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), nullif(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), ''))) AS INTEGER) AS n_chars FROM pages""",
    "answer_sentence_locator": S.select(S.DOCS, S.SENTENCES, _REACH, _FOUND, "SELECT cid, doc_id, start, sent_idx FROM fd"),
    "pos_neg_samples": S.select(S.DOCS, S.SENTENCES, S.QUERY, _REACH, _FOUND, _SAMPLES, "SELECT * FROM sm"),
    "sample_ratio": S.select(S.DOCS, S.SENTENCES, S.QUERY, _REACH, _FOUND, _SAMPLES, "SELECT yy, count(*) AS n FROM sm GROUP BY yy"),
    "digit_mask": rf"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\r]+')) AS word FROM documents) WHERE regexp_matches(word, '[0-9]'))
SELECT word, {_MASK.format(w='word')} AS masked FROM w""",
    "punct_split": S.select(
        S.DOCS, S.SENTENCES,
        r"x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(sent, '[-—–_]', ' - ', 'g'), ':', ' : ', 'g'), '\\', ' \\ ', 'g'), '/', ' / ', 'g') AS y FROM s)",
        rf"SELECT cid, doc_id, sent_idx, array_to_string(list_transform(list_filter(regexp_split_to_array(y, '[ \t\n\r]+'), lambda t: t <> ''), lambda t: {_MASK.format(w='t')}), ' ') AS tokens FROM x",
    ),
    "sentences_per_doc_histogram": S.select(S.DOCS, S.SENTENCES, _SIZES, "SELECT n_sents, n FROM sz"),
    "sentences_per_doc_cdf": S.select(S.DOCS, S.SENTENCES, _SIZES, "SELECT n_sents, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY n_sents) / sum(n) OVER (), 6) AS cum_share FROM sz"),
    "question_simplify": "SELECT page_id, trim(string_split(url, '?')[1]) AS head FROM pages",
    "marked_passages": r"""WITH a AS (SELECT page_id, list_filter(list_transform(string_split(html, '<p>'), lambda x: trim(regexp_replace(x, '[ \t\n\r]+', ' ', 'g'))), lambda x: x <> '') AS arr FROM pages)
SELECT page_id, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS k, CAST(length(unnest(arr)) AS INTEGER) AS n_chars FROM a""",
    "reference_queries": S.select(S.REFERENCES, "SELECT cid, replace(text, chr(10), '') AS query FROM ref WHERE ref_idx = 1"),
    "prefix_matches": S.select(S.REFERENCES, "SELECT r.cid AS prefix, c.cid FROM (SELECT cid FROM ref WHERE ref_idx = 1) r JOIN (SELECT DISTINCT source AS cid FROM documents) c ON starts_with(c.cid, r.cid)"),
    "context_turns": """SELECT conv_id, turn, concat_ws(' ', text, '[unused1] ' || coalesce(lag(text) OVER w, ''), '[unused2] ' || coalesce(lead(text) OVER w, '')) AS context
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "length_masks": S.select(
        S.DOCS, S.SENTENCES, "n AS (SELECT cid, doc_id, count(*) AS n FROM s GROUP BY ALL)",
        "SELECT cid, doc_id, rpad(repeat('1', CAST(least(n, 20) AS INTEGER)), 20, '0') AS mask FROM n",
    ),
}
