"""Exact deduplication by content sort (operator 10).

Sampled splitters range-partition the normalised texts, each partition sorts its texts on disk, and a pass over
the sorted rows compares neighbours in full.

A splitter is a separator key of bounded size, the first characters of a text.  A small sample of rows shows which
beginnings are frequent; only under those the digest of the whole text stands behind them in the key, so that texts
with a common beginning spread, and only under frequent texts also the id, so that copies of one text, however many,
fall into neighbouring partitions.  Inside a partition rows of one key are in the order of their texts.  A run of
equal texts that touches an end of its partition may go on in the next; such runs, two a partition at most, are put
together by their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of a text's beginning in a splitter, and of a text that are looked at to find them.
HEAD, LOOK = 32, 256
#: Rows of the sample for each partition, and rows of one kind in it that make a beginning or a text frequent.
SAMPLE, FREQUENT = 64, 8
_RUNS = "doc_id long, text_sha256 string, run_keep long, run_size long, is_first boolean, edge int, edge_text string, part int"
_KEYS = ["head", "digest", "no_id", "id", "place"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _head(text: Column) -> Column:
    """The first characters of the normalised text; the whole text is only normalised where its beginning is mostly white space."""
    start = normalised(F.substring(text, 1, LOOK))
    return F.when((F.length(start) >= HEAD) | (F.length(F.coalesce(text, F.lit(""))) <= LOOK), F.substring(start, 1, HEAD)).otherwise(F.substring(normalised(text), 1, HEAD))


def _frequent(docs: DataFrame, n: int) -> tuple[list[str], list[tuple[str, str]]]:
    """Beginnings, and texts (by beginning and digest), with a share in a sample of rows that would fill much of a partition.

    At most SAMPLE * n / FREQUENT of each.
    """
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, SAMPLE * n / max(total, 1)), seed=10)
    texts = sample.select(_head(F.col("text")).alias("head"), F.sha2(normalised(F.col("text")), 256).alias("digest")).groupBy("head", "digest").agg(F.count("*").alias("n"))
    heads = texts.groupBy("head").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") >= FREQUENT, F.col("digest"))).alias("digests")).where(F.col("n") >= FREQUENT)
    found = heads.select("head", "digests").collect()
    return sorted(r["head"] for r in found), sorted((r["head"], d) for r in found for d in r["digests"])


def _sorted_texts(docs: DataFrame, with_rows: bool) -> DataFrame:
    """(doc_id, norm, row where asked) over range partitions, in the order of texts, then of ids with null last."""
    spark = docs.sparkSession
    n = common.partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *([F.struct("*").alias("row")] if with_rows else []))
    heads, texts = _frequent(rows, n)
    rows = rows.withColumn("head", _head(F.col("text")))
    if heads:
        few = spark.createDataFrame([(h,) for h in heads], "head string").withColumn("spreads", F.lit(True))
        rows = rows.join(F.broadcast(few), "head", "left")
        rows = rows.withColumn("digest", F.when(F.col("spreads"), F.sha2(normalised(F.col("text")), 256)))
    if texts:
        few = spark.createDataFrame(texts, "head string, digest string").withColumn("copied", F.lit(True))
        rows = rows.join(F.broadcast(few), ["head", "digest"], "left").withColumn("at", F.monotonically_increasing_id())
        rows = rows.withColumn("no_id", F.when(F.col("copied"), F.col("doc_id").isNull())).withColumn("id", F.when(F.col("copied"), F.col("doc_id"))).withColumn("place", F.when(F.col("copied"), F.col("at")))
    keys = [k for k in _KEYS if k in rows.columns]
    dealt = rows.repartitionByRange(n, *keys).withColumn("norm", normalised(F.col("text")))
    return dealt.sortWithinPartitions(*keys[:2], "norm", F.col("doc_id").isNull(), "doc_id", "text")


def _starts(norm: pa.Array, last: str | None, any_before: bool) -> np.ndarray:
    """Whether each text differs from the one before it."""
    new = np.ones(len(norm), bool)
    new[1:] = ~pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
    new[0] = not any_before or norm[0].as_py() != last
    return new


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row, what its run of equal texts in this partition shows. Holds the ids of one run, and one text.

    edge: 0 for the first run of the partition, 1 for the last, else null; edge_text: the text, in the first row of such runs.
    """
    part = TaskContext.get().partitionId()
    ids: list[pa.Array] = []
    text = digest = None
    edge: int | None = 0

    def run(last: bool) -> pa.RecordBatch:
        doc = pa.chunked_array(ids, pa.int64()).combine_chunks()
        n = len(doc)
        where = edge if edge is not None else 1 if last else None
        first = np.zeros(n, bool)
        first[0] = True
        words = pa.nulls(n, pa.string()) if where is None else pa.concat_arrays([pa.array([text], pa.string()), pa.nulls(n - 1, pa.string())])
        return common.batch_of(
            doc_id=doc, text_sha256=pa.repeat(pa.scalar(digest, pa.string()), n), run_keep=pa.repeat(pa.scalar(pc.min(doc).as_py(), pa.int64()), n),
            run_size=np.full(n, n, np.int64), is_first=first, edge=pa.repeat(pa.scalar(where, pa.int32()), n), edge_text=words, part=np.full(n, part, np.int32),
        )

    for batch in common.pieces(batches, "norm"):
        norm, sha, doc = (batch.column(c) for c in ("norm", "text_sha256", "doc_id"))
        bounds = np.flatnonzero(_starts(norm, text, bool(ids))).tolist()
        head = doc.slice(0, bounds[0] if bounds else len(doc))
        if len(head):
            ids.append(head)
        inner = []
        for k, at in enumerate(bounds):
            if ids:
                inner.append(run(False))
                edge = None
            ids = [doc.slice(at, (bounds[k + 1] if k + 1 < len(bounds) else len(doc)) - at)]
            digest, text = sha[at].as_py(), norm[at].as_py() if k in (0, len(bounds) - 1) else None  # inner runs need no text
        if inner:
            yield pa.Table.from_batches(inner).combine_chunks().to_batches()[0]
    if ids:
        yield run(True)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run, with edge and edge_text as above. Holds one row."""
    part = TaskContext.get().partitionId()
    held: pa.RecordBatch | None = None
    text, edge = None, 0

    def out(rows: pa.RecordBatch, where: int | None) -> pa.RecordBatch:
        n = rows.num_rows
        words = pa.nulls(n, pa.string()) if where is None else common.plain(rows.column("norm"), pa.string())
        return common.batch_of(row=rows.column("row"), edge=pa.repeat(pa.scalar(where, pa.int32()), n), edge_text=words, part=np.full(n, part, np.int32))

    for batch in common.pieces(batches, "norm"):
        norm = batch.column("norm")
        new = _starts(norm, text, held is not None)
        text = norm[len(norm) - 1].as_py()
        rows = batch.filter(pa.array(new))
        if not rows.num_rows:
            continue
        if held is not None:
            yield out(held, edge)
            edge = None
        elif rows.num_rows > 1:
            yield out(rows.slice(0, 1), edge)
            edge, rows = None, rows.slice(1)
        if rows.num_rows > 1:
            yield out(rows.slice(0, rows.num_rows - 1), None)
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield out(held, 1 if edge is None else edge)


def _edges(runs: DataFrame, *sums: Column) -> DataFrame:
    """(part, edge, first_part, sums): the runs at ends of partitions, equal texts together. At most two rows a partition."""
    ends = runs.where("edge_text IS NOT NULL").groupBy("edge_text").agg(F.min("part").alias("first_part"), *sums, F.collect_list(F.struct("part", "edge")).alias("places"))
    return ends.withColumn("e", F.explode("places")).select("e.part", "e.edge", *[c for c in ends.columns if c not in ("edge_text", "places")])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): every row, with the row that stays for its text.

    Texts are equal when identical after each run of space and 0x09-0x0D became one space; null counts as
    empty.  The smallest doc_id of a group stays; of repeated rows with that id exactly one does.  Rows without
    doc_id belong to groups, but one stays only where no row of the group has an id.  Very long texts are compared
    whole.  Other columns, whatever their names, play no part; an empty table gives no rows.
    """
    dealt = _sorted_texts(docs, False).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "norm")
    runs = common.durable(common.arrow_map(dealt, _run_rows, _RUNS))
    edges = _edges(runs, F.min("run_keep").alias("keep"), F.sum("run_size").alias("size"))
    out = runs.drop("edge_text").join(F.broadcast(edges), ["part", "edge"], "left")
    stays = F.col("is_first") & (F.coalesce(F.col("first_part"), F.col("part")) == F.col("part"))
    at_edge = F.col("edge").isNotNull()
    return out.select(
        "doc_id", F.when(at_edge, F.col("keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.when(at_edge, F.col("size")).otherwise(F.col("run_size")).alias("group_size"), stays.alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which ``exact_duplicates`` says that they stay: one for each text.

    A row is itself, whatever its id: of rows with one doc_id and different texts each can stay, of repeated rows one does,
    and a copy without doc_id goes like any other.
    """
    schema = docs.select(F.struct("*").alias("row"), F.lit(None).cast("int").alias("edge"), F.lit(None).cast("string").alias("edge_text"), F.lit(None).cast("int").alias("part")).schema
    dealt = _sorted_texts(docs, True).select("row", "norm")
    firsts = common.durable(common.arrow_map(dealt, _first_rows, schema))
    out = firsts.drop("edge_text").join(F.broadcast(_edges(firsts)), ["part", "edge"], "left")
    return out.where("first_part IS NULL OR first_part = part").select("row.*")
