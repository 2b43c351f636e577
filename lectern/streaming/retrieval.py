"""Scores documents as they arrive and keeps each cluster's ranking in a table.

Scoring needs a sentence and its query only, so it runs on every micro-batch by itself.  Rankings and confidence
filters need the whole cluster: they are taken from the table of scored sentences when they are read.  A batch that
is run again after a failure replaces its own part of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import corpus, rank, scoring

DOCUMENT = "cid string, doc_id long, text string"


def documents(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of (cid, doc_id, text) from Parquet files that arrive in a folder."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(stream: DataFrame, queries: DataFrame, table: str, checkpoint: str, once: bool = False):
    """Appends the scored sentences of every batch under ``table``; returns the running query."""

    def write(batch: DataFrame, epoch: int) -> None:
        scored = scoring.tf_relevance(corpus.sentences(batch), queries)
        rows = scored.select("cid", "doc_id", "sent_idx", "sent", "score")
        rows.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, table: str, how: str = "conf", value: float = 0.75) -> DataFrame:
    """The retrieval over all that has arrived; a document that came twice counts with its last version."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("cid", "doc_id").agg(F.max("epoch").alias("epoch"))
    return rank.retrieve(rows.join(last, ["cid", "doc_id", "epoch"], "left_semi").drop("epoch"), how, value)
