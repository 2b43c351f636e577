"""N-gram overlap of summaries with references: ROUGE-1, ROUGE-2 and ROUGE-SU4.

Recall, precision and F1 (equal weight) of clipped n-gram matches, averaged over a cluster's references.
Texts are lower-cased, cut to a number of words, and stemmed where asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.shipping import ship

LENGTH, GAP = 250, 4
METRICS = ("rouge1", "rouge2", "rougeSU4")
_TOKEN = "[\\p{L}\\p{N}]+"


def tokens(text: Column, length: int | None = LENGTH, stem: bool = False) -> Column:
    out = F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))
    out = out if length is None else F.slice(out, 1, length)
    if stem:
        ship()
        return T.stemmed_terms(out)
    return out


def _grams(words: Column, metric: str) -> Column:
    """The units that a metric counts, as one array with repeats."""
    if metric == "rouge1":
        return words
    if metric == "rouge2":
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    if metric == "rougeSU4":
        skips = [
            F.slice(
                F.zip_with(words, F.slice(words, F.lit(d + 1), F.greatest(F.size(words) - d, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)),
                F.lit(1), F.greatest(F.size(words) - d, F.lit(0)),
            )
            for d in range(1, GAP + 2)
        ]
        return F.concat(words, *skips)
    raise ValueError(f"no such metric: {metric}")


def scores(candidates: DataFrame, references: DataFrame, metric: str, length: int | None = LENGTH, stem: bool = False) -> DataFrame:
    """(cid, recall, precision, f1), each the mean over the references.

    candidates: (cid, text); references: (cid, ref_idx, text).  A text without units has recall and precision 0.
    """
    each = pairwise(candidates.withColumn("cand", F.lit(0)), references, metric, length, stem)
    return each.groupBy("cid").agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("f1").alias("f1"))


def pairwise(candidates: DataFrame, references: DataFrame, metric: str, length: int | None = LENGTH, stem: bool = False, other_only: bool = False) -> DataFrame:
    """(cid, cand, ref_idx, recall, precision, f1) of every candidate with every reference of its cluster.

    candidates: (cid, cand, text).  other_only: not with the reference of the same number.
    """
    c = candidates.select("cid", "cand", _grams(tokens(F.col("text"), length, stem), metric).alias("g"))
    r = references.select("cid", "ref_idx", _grams(tokens(F.col("text"), length, stem), metric).alias("g"))
    pairs = c.select("cid", "cand", F.size("g").alias("nc")).join(r.select("cid", "ref_idx", F.size("g").alias("nr")), "cid")
    if other_only:
        pairs = pairs.where("cand <> ref_idx")
    cc = c.select("cid", "cand", F.explode("g").alias("g")).groupBy("cid", "cand", "g").agg(F.count("*").alias("c"))
    rc = r.select("cid", "ref_idx", F.explode("g").alias("g")).groupBy("cid", "ref_idx", "g").agg(F.count("*").alias("r"))
    hits = cc.join(rc, ["cid", "g"]).groupBy("cid", "cand", "ref_idx").agg(F.sum(F.least("c", "r")).alias("hit"))
    out = pairs.join(hits, ["cid", "cand", "ref_idx"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("nr")), F.lit(0.0))
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("nc")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))
    return out.select("cid", "cand", "ref_idx", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))


def leave_one_out(references: DataFrame, metric: str, length: int | None = LENGTH, stem: bool = False) -> DataFrame:
    """(cid, recall, f1): each reference against the others, then the mean over references."""
    each = pairwise(references.withColumnRenamed("ref_idx", "cand"), references, metric, length, stem, other_only=True)
    one = each.groupBy("cid", "cand").agg(F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return one.groupBy("cid").agg(F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def percent(score: Column) -> Column:
    """As reported: a percentage with two decimals."""
    return F.round(score * 100, 2)


def reference_counts(references: DataFrame) -> DataFrame:
    return references.groupBy("cid").agg(F.countDistinct("ref_idx").alias("n_refs"))
