"""Packing sequences by optimal length buckets (operator 6)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 16
CONTEXT = 4096
BUDGET = 65536


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding in all.

    counts[i]: sequences of length i.  A bucket pads its sequences to its upper length.  Dynamic programming:
    the least cost of the lengths up to j with k buckets is, over the last bucket's lower end i, the cost with
    k - 1 buckets up to i plus that of padding the lengths in (i, j] to j.  Among equal costs fewer buckets win.
    """
    used = np.flatnonzero(counts)
    if not len(used):
        return []
    n = np.concatenate(([0], np.cumsum(counts[used], dtype=np.float64)))
    total = np.concatenate(([0], np.cumsum(counts[used] * used, dtype=np.float64)))
    m = len(used)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0
    back, best = [], []
    for _ in range(min(buckets, m)):
        nxt, frm = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        for j in range(1, m + 1):
            each = cost[:j] + used[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])
            frm[j] = int(np.argmin(each))
            nxt[j] = each[frm[j]]
        back.append(frm)
        best.append(nxt[m])
        cost = nxt
    k, j, ends = int(np.argmin(best)), m, []
    while k >= 0:
        ends.append(int(used[j - 1]))
        j = int(back[k][j])
        k -= 1
    return ends[::-1]


def pack(lengths: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, piece, n_tokens, bucket, bucket_len, batch, slot): every token of every document in a batch.

    lengths: (doc_id, n_tokens).  A document of more than ``context`` tokens becomes pieces of that many and a
    rest; one of no (or null) tokens is one piece of length 0 in the shortest bucket.  Bucket boundaries minimise
    the padding over the histogram of all pieces, which has at most ``context`` + 1 entries.  Inside a bucket the
    pieces are shuffled by a hash of their identity and cut into batches of ``budget`` // bucket_len pieces (at
    least one): only the last batch of a bucket is not full.  bucket and batch count from 0 over the buckets in
    order of length, slot inside a batch.  Repeated rows are pieces like others; an empty table gives no rows.
    """
    if context < 1 or buckets < 1 or budget < context:
        raise ValueError("a batch must hold a sequence of the context's length")
    spark = lengths.sparkSession
    spread = common.partitions(spark)
    size = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long"))
    docs = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(size, F.lit(0).cast("long")).alias("size"))
    last = F.greatest(F.ceil(F.col("size") / context) - 1, F.lit(0)).cast("long")
    pieces = docs.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.col("size") - F.col("piece") * context, F.lit(context)).alias("n_tokens"))
    pieces = common.durable(pieces)
    counts = np.zeros(context + 1, np.int64)
    for row in pieces.groupBy("n_tokens").count().collect():  # at most context + 1 rows
        counts[row["n_tokens"]] = row["count"]
    ends = boundaries(counts, buckets) or [0]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
    dealt = pieces.withColumn("bucket", bucket.cast("int")).withColumn("mix", F.xxhash64("doc_id", "piece"))
    dealt = dealt.repartitionByRange(spread, "bucket", "mix", "doc_id").sortWithinPartitions("bucket", "mix", "doc_id", "piece")
    # after the sort, rows of a partition are numbered in order: its number in the upper, the row's in the lower 33 bits
    numbered = common.durable(dealt.withColumn("at", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("part", F.shiftright("at", 33).cast("int"))
    runs = numbered.groupBy("part", "bucket").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()  # partitions + buckets
    table, before = [], dict.fromkeys(range(len(ends)), 0)
    for r in sorted(runs, key=lambda r: (r["bucket"], r["part"])):
        table.append((r["part"], r["bucket"], r["first"] - before[r["bucket"]]))
        before[r["bucket"]] += r["n"]
    sizes = [max(1, budget // max(1, e)) for e in ends]
    opened = np.concatenate(([0], np.cumsum([-(-before[k] // sizes[k]) for k in range(len(ends))]))).tolist()
    shape = spark.createDataFrame([(k, ends[k], sizes[k], int(opened[k])) for k in range(len(ends))], "bucket int, bucket_len int, batch_size long, opened long")
    shift = spark.createDataFrame(table, "part int, bucket int, shift long")
    out = numbered.join(F.broadcast(shift), ["part", "bucket"]).join(F.broadcast(shape), "bucket")
    rank = F.col("at") - F.col("shift")
    return out.select(
        "doc_id", "piece", "n_tokens", "bucket", "bucket_len",
        (F.floor(rank / F.col("batch_size")) + F.col("opened")).alias("batch"), (rank % F.col("batch_size")).alias("slot"),
    )
