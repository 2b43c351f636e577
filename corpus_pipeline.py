"""A corpus pipeline: language filter, exact and near deduplication, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and what is read back
are the next stage's documents.  All but the last return the columns of ``documents``, whatever columns there are.

A row is a document of its own, whatever its doc_id: rows without one, and several rows with one, are each kept or dropped
by their texts.  Null and empty texts have no language and go with the first stage; very long texts are taken whole; an empty table
gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, common, exact, langid, packing, simhash, substring

#: Languages that stay (None: all that the corpus has labelled documents of), and the least score of a document's language.
LANGUAGES: tuple[str, ...] | None = None
LEAST_SCORE = langid.LEAST_SCORE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages, surely enough; others, and those without a letter, go."""
    return langid.accepted(docs, LANGUAGES, LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the smallest doc_id, one without doc_id only where no copy has one."""
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, chosen alike."""
    return simhash.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that a document with a smaller id has too; rows without doc_id lose nothing."""
    return substring.strip_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in batches of like lengths."""
    lengths = bpe.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(lengths)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_batches),
]

#: SQL cannot express fingerprints and tokenization; the tests hold the pipeline against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of a data folder. Tables between stages lie in the shared folder, and are removed.

    Packing rests on tables of its own in that folder (checkpoints, which the session's cleaner removes where it is told to),
    so the documents of the stage before can go.
    """
    folder = f"{common.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                common.remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        common.remove(spark, folder)
