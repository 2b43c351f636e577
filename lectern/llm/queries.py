"""The registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, embedding, exact, html, langid, packing, quality, records, simhash, substring


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op4_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = bpe.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(lengths)


def op7_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.new_folder(spark)
    shards = records.write_records(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    out = common.durable(records.read_records(shards, folder))
    common.remove(spark, folder)
    return out


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(common.table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip, op2_substring_dedup, op3_embedding_near_dedup, op4_quality_co_training, op5_simhash_near_dedup,
        op6_length_bucket_packing, op7_binary_records, op8_html_main_text, op9_language_id, op10_exact_dedup,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(generate_series(1, len(ws) - 49)) AS g(i)),
again AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS lo FROM win GROUP BY h) USING (h) WHERE doc_id > lo),
word AS (SELECT doc_id, i, ws[i] AS s FROM w, unnest(generate_series(1, len(ws))) AS g(i)),
gone AS (SELECT DISTINCT doc_id, p AS i FROM again, unnest(generate_series(i, i + 49)) AS g(p)),
kept AS (SELECT word.doc_id, string_agg(word.s, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS t, count(gone.i) AS n_removed
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op3_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN link l ON l.u = r.w),
n AS (SELECT u, count(*) AS n FROM link GROUP BY u),
c AS (SELECT u, min(w) AS c FROM reach GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN c ON c.u = e.vec_id""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)""",
}
