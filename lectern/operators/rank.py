"""Ranking and filtering of scored rows inside clusters.

A rank or a running sum over a whole cluster would put the cluster into one task, however large.  ``ranked`` cuts
each cluster into slices of the score's range: counts and sums of slices are combined before they are shuffled,
and only rows of one slice meet to be ordered.  Rows without a score, all equal, are sliced by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import once

#: Slices of the score range, and documents in a slice of rows with score 0.
SLICES, DOCUMENTS = 4096, 1024
PRUNE = 1e-10
PLACES = 9


def _key(score: str) -> Column:
    """What rows are ordered by: scores equal to nine places are ties."""
    return F.round(F.col(score), PLACES)


def ranked(rows: DataFrame, by: tuple[str, ...] = ("cid",), score: str = "score", ties: tuple[str, ...] = ("doc_id", "sent_idx"), above: float | None = None, last_first: bool = False) -> DataFrame:
    """Adds rank (from 1, best first, ties in the order of ``ties``), cum (running sum of scores), total and best.

    above: only scores over it count in the total.  last_first: ties in descending order.
    """
    key = _key(score)
    endless = F.abs(key) == float("inf")
    # zero and the infinities have slices of their own: only rows that are all tied may be parted by document
    finite = F.floor(SLICES * (key / (1 + F.abs(key)))) + (key > 0).cast("long")
    rows = rows.withColumn("_slice", F.when(endless, (SLICES + 2) * F.signum(key).cast("long")).otherwise(finite)).withColumn(
        "_part", F.when((key == 0) | endless, F.floor(F.col(ties[0]) / DOCUMENTS)).otherwise(F.lit(0).cast("long"))
    )
    cell = [*by, "_slice", "_part"]
    counted = F.col(score) if above is None else F.when(F.col(score) > above, F.col(score))
    every = Window.partitionBy(*by)
    sums = rows.groupBy(*cell).agg(F.count("*").alias("_n"), F.sum(score).alias("_s"), F.max(score).alias("_b"), F.sum(counted).alias("_c"))
    w = Window.partitionBy(*by).orderBy(F.desc("_slice"), F.desc("_part") if last_first else F.asc("_part"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
        F.sum("_c").over(every).alias("total"), F.max("_b").over(every).alias("best"),
    )
    inner = Window.partitionBy(*cell).orderBy(key.desc(), *[F.desc(t) if last_first else F.asc(t) for t in ties])
    out = rows.join(sums, cell)
    out = out.withColumn("rank", (F.row_number().over(inner) + F.col("_n0")).cast("int"))
    out = out.withColumn("cum", F.sum(score).over(inner.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s0"))
    return out.drop("_slice", "_part", "_n0", "_s0")


def top_k(rows: DataFrame, k: int, by: tuple[str, ...] = ("cid",), score: str = "score", ties: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """The k best rows of each cluster, with their rank. Each task keeps k rows a cluster before the shuffle."""
    w = Window.partitionBy(*by).orderBy(_key(score).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reverse_ranked(rows: DataFrame, by: tuple[str, ...] = ("cid",), score: str = "score", ties: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """Adds rank with ties in descending order: the reverse of an ascending sort."""
    return ranked(rows, by, score, ties, last_first=True).drop("cum", "total", "best")


def deduplicate(rows: DataFrame, text: str = "sent", by: tuple[str, ...] = ("cid",), score: str = "score", ties: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """Of rows of a cluster with the same text the best-ranked one.

    An aggregate instead of a window: equal texts are combined before the shuffle.
    """
    first = F.min(F.struct((-_key(score)).alias("k"), *ties, F.struct(*[c for c in rows.columns if c not in by and c != text]).alias("row"))).alias("m")
    return rows.groupBy(*by, text).agg(first).select(*by, text, "m.row.*").select(*rows.columns)


def prune(rows: DataFrame, least: float = PRUNE, score: str = "score") -> DataFrame:
    return rows.where(F.col(score) > least)


def scaled(rows: DataFrame, by: tuple[str, ...] = ("cid",), score: str = "score") -> DataFrame:
    """Scores min-max scaled inside their cluster; all 0 where they are equal."""
    bounds = rows.groupBy(*by).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    out = rows.join(bounds, list(by)).withColumn(score, F.coalesce(F.try_divide(F.col(score) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)))
    return out.drop("_low", "_high")


def by_confidence(rows: DataFrame, conf: float | str, by: tuple[str, ...] = ("cid",), min_rows: int | None = None, dedupe: bool = False, norm: bool = False, text: str = "sent", score: str = "score", ties: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """The shortest head of each ranking whose share of the scores reaches ``conf``, with the row that crosses it.

    min_rows: at least so many, if there are.  conf may name a column.  Rows of a cluster whose scores sum to 0 all stay.
    """
    rows = deduplicate(rows, text, by, score, ties) if dedupe else rows
    rows = scaled(rows, by, score) if norm else rows
    out = ranked(rows, by, score, ties)
    share = F.coalesce(F.round(F.try_divide(F.col("cum") - F.col(score), F.col("total")), PLACES), F.lit(0.0))
    keep = share < (F.col(conf) if isinstance(conf, str) else F.lit(conf))
    return out.where(keep if min_rows is None else keep | (F.col("rank") <= min_rows)).drop("cum", "total", "best")


def retrieve(rows: DataFrame, how: str, value: float | int, by: tuple[str, ...] = ("cid",), min_rows: int | None = None, dedupe: bool = False, norm: bool = False, pruned: bool = True, text: str = "sent", score: str = "score", ties: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """Filters each ranking by ``conf`` or ``topK``; a cluster whose best score is exactly 0 passes whole.

    min_rows: also the first so many.  pruned: first drops scores that are nothing.  The rows are computed when this is called,
    once; those who need no text afterwards leave it out before.
    """
    if how not in ("conf", "topK"):
        raise ValueError(f"no such filter: {how}")
    rows = once(rows)
    if how == "conf" and not dedupe and not norm:
        out = ranked(rows, by, score, ties, PRUNE if pruned else None)
        share = F.coalesce(F.round(F.try_divide(F.col("cum") - F.col(score), F.col("total")), PLACES), F.lit(0.0))
        keep = share < float(value) if min_rows is None else (share < float(value)) | (F.col("rank") <= min_rows)
        keep = keep & (F.col(score) > PRUNE) if pruned else keep
        return out.where(keep | (F.col("best") == 0)).drop("cum", "total", "best")
    best = rows.groupBy(*by).agg(F.max(score).alias("_best"))
    rows = rows.join(best, list(by))
    empty = ranked(rows.where("_best = 0").drop("_best"), by, score, ties).drop("cum", "total", "best")
    live = rows.where("_best <> 0").drop("_best")
    live = prune(live, score=score) if pruned else live
    if how == "conf":
        kept = by_confidence(live, float(value), by, min_rows, dedupe, norm, text, score, ties)
    else:
        kept = top_k(deduplicate(live, text, by, score, ties) if dedupe else live, int(value), by, score, ties)
    return kept.unionByName(empty)


def sweep(rows: DataFrame, how: str, values: list, column: str, by: tuple[str, ...] = ("cid",), score: str = "score", ties: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """The retrieved rows for every parameter value, from one ranking: a row appears once for each value that keeps it."""
    if how == "conf":
        out = ranked(once(prune(rows, score=score)), by, score, ties)
        share = F.coalesce(F.round(F.try_divide(F.col("cum") - F.col(score), F.col("total")), PLACES), F.lit(0.0))
        kept = F.filter(F.array(*[F.lit(float(v)) for v in values]), lambda v: share < v)
    else:
        out = top_k(rows, int(max(values)), by, score, ties)
        kept = F.filter(F.array(*[F.lit(int(v)) for v in values]), lambda v: F.col("rank") <= v)
    return out.withColumn(column, F.explode(kept)).drop("cum", "total", "best")
