"""Scores of spans and of overlapping passages, and the combination of two scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.vectors import passage_transform

MODES = ("sqrt", "avg", "sqrt_global", "avg_global", "weight_avg_sent_only")


def span_score(start: Column, end: Column) -> Column:
    """Largest exp(start[i]) * exp(end[j]) with i <= j, from one pass that carries the best start so far."""
    state = F.struct(F.lit(float("-inf")).alias("start"), F.lit(0.0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        best_start = F.greatest(a["start"], F.exp(x["s"].cast("double")))
        return F.struct(best_start.alias("start"), F.greatest(a["best"], best_start * F.exp(x["e"].cast("double"))).alias("best"))

    return F.aggregate(F.zip_with(start, end, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), state, step, lambda a: a["best"])


def span_scores(passages: DataFrame) -> DataFrame:
    """(cid, pid, span_idx, score): one row a sentence of a passage.

    passages: (cid, pid, start_logits, end_logits, spans array of (s, e), e exclusive).  Spans end at the first with
    e = -1.  A span beyond the logits fails.
    """
    pad = F.array_position(F.transform("spans", lambda x: x["e"]), -1)
    rows = passages.select("*", F.when(pad > 0, F.slice("spans", F.lit(1), (pad - 1).cast("int"))).otherwise(F.col("spans")).alias("_own"))
    rows = rows.select("*", F.posexplode("_own").alias("span_idx", "x"))
    fits = F.col("x.e") <= F.size("start_logits")
    length = F.when(fits, F.col("x.e") - F.col("x.s")).otherwise(F.raise_error(F.lit("a span ends beyond its logits")).cast("int"))
    part = [F.slice(c, F.col("x.s") + 1, length) for c in ("start_logits", "end_logits")]
    return rows.select("cid", "pid", "span_idx", span_score(*part).alias("score"))


def best_of_passages(scores: DataFrame, by: tuple[str, ...] = ("cid", "sid")) -> DataFrame:
    """A sentence in several passages keeps its best score; its text comes from the first passage."""
    return scores.groupBy(*by).agg(F.max("score").alias("score"), F.min_by("sent", "pid").alias("sent"))


def scorer_records(rows: DataFrame, passages: bool = False) -> DataFrame:
    """(cid, sent, score): the best score of each text. Passage scores are transformed; scores outside [0, 1] fail."""
    score = passage_transform(F.col("score")) if passages else F.col("score")
    checked = F.when((score >= 0) & (score <= 1), score).otherwise(F.raise_error(F.concat(F.lit("a score is outside [0, 1]: "), score.cast("string"))).cast("double"))
    return rows.select("cid", "sent", checked.alias("score")).groupBy("cid", "sent").agg(F.max("score").alias("score"))


def combine(sentence_records: DataFrame, passage_records: DataFrame, mode: str, weight: float = 0.0) -> DataFrame:
    """(cid, sent, score) of both scorers.

    sqrt and avg combine scores of texts that both have and keep those of one; the global modes weaken those of
    one; weight_avg_sent_only gives (1 - weight) s + weight p for texts of the sentence scorer only.  Texts that one
    side has with score 0 go.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    s = sentence_records.select("cid", "sent", F.col("score").alias("s"))
    p = passage_records.select("cid", "sent", F.col("score").alias("p"))
    rows = s.join(p, ["cid", "sent"], "left" if mode == "weight_avg_sent_only" else "full_outer")
    one = F.coalesce("s", "p")
    alone = {"sqrt": one, "avg": one, "sqrt_global": 0.001 * one, "avg_global": one / 2, "weight_avg_sent_only": (1 - weight) * one}[mode]
    if mode.startswith("sqrt"):
        both = F.sqrt(F.col("s") * F.col("p"))
    elif mode.startswith("avg"):
        both = (F.col("s") + F.col("p")) / 2
    else:
        both = (1 - weight) * F.col("s") + weight * F.col("p")
    two_sided = F.col("s").isNotNull() & F.col("p").isNotNull()
    return rows.select("cid", "sent", F.when(two_sided, both).when(alone != 0, alone).alias("score")).where("score IS NOT NULL")
