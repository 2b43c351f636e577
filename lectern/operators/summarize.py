"""Summaries of a length from rankings, and lead baselines."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.shipping import ship

BUDGET, COSINE = 500, 0.6
LEAD_DOCUMENTS, LEAD_SENTENCES = 10, 50


def bow_cosine(a: Counter, b: Counter) -> float:
    """Cosine of token counts; 0 where either is empty."""
    norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return sum(v * b[k] for k, v in a.items() if k in b) / norm if norm else 0.0


def select(ranked: DataFrame, budget: int = BUDGET, cosine: float = COSINE) -> DataFrame:
    """(cid, pos, rank, orig): sentences in rank order until their words reach the budget, the crossing one included.

    ranked: (cid, rank, orig, sent).  A sentence goes where its cosine (of processed words) with one chosen before is
    at least ``cosine``; 1.0 turns that off and leaves a running sum.
    """
    rows = ranked.select("cid", "rank", "orig", "sent", T.n_words(F.col("orig")).alias("n_words"))
    if cosine >= 1.0:
        w = Window.partitionBy("cid").orderBy("rank")
        before = F.coalesce(F.sum("n_words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = rows.withColumn("_before", before).where(F.col("_before") < budget)
        return kept.select("cid", F.row_number().over(w).alias("pos"), "rank", "orig")

    def walk(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rank")
        chosen, taken, used = [], [], 0
        for k, (sent, n) in enumerate(zip(own["sent"], own["n_words"], strict=True)):
            if used >= budget:
                break
            bag = Counter((sent or "").split())
            if any(bow_cosine(bag, other) >= cosine for other in chosen):
                continue
            chosen.append(bag)
            taken.append(k)
            used += int(n)
        own = own.iloc[taken]
        return pd.DataFrame({"cid": key[0], "pos": range(1, len(taken) + 1), "rank": own["rank"].to_numpy(), "orig": own["orig"].to_numpy()})

    ship(rows.sparkSession)
    return rows.groupBy("cid").applyInPandas(walk, "cid string, pos int, rank int, orig string")


def text_of(selected: DataFrame) -> DataFrame:
    """(cid, summary): the selected sentences, one a line."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "orig")))
    return selected.groupBy("cid").agg(F.array_join(F.transform(lines, lambda x: x["orig"]), "\n").alias("summary"))


def lead(sents: DataFrame, documents: int = LEAD_DOCUMENTS, least: int = LEAD_SENTENCES) -> DataFrame:
    """(cid, doc_id, sent_idx, orig): whole documents from a cluster's first on, until enough sentences are in.

    At most ``documents`` of them; the test stands before each document, so the last may go beyond.
    """
    sizes = sents.groupBy("cid", "doc_id").agg(F.count("*").alias("n"))
    first = Window.partitionBy("cid").orderBy("doc_id")
    sizes = sizes.withColumn("k", F.row_number().over(first)).where(F.col("k") <= documents)
    before = F.coalesce(F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sizes.withColumn("before", before).where(F.col("before") < least).select("cid", "doc_id")
    return sents.join(kept, ["cid", "doc_id"], "left_semi").select("cid", "doc_id", "sent_idx", "orig")


def lead_files(files: DataFrame, pattern: str) -> DataFrame:
    """Files (cid, name, text) of the peer whose names match: a lead baseline that others made."""
    return files.where(F.col("name").rlike(pattern))
