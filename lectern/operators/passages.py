"""Sliding passages of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, STRIDE = 8, 4


def sliding(sents: DataFrame, size: int = SIZE, stride: int = STRIDE, by: tuple[str, ...] = ("cid", "doc_id")) -> DataFrame:
    """(by, p_idx, start, sents): windows of ``size`` sentences every ``stride``, while some follow the next start.

    A document of at most ``stride`` sentences has none.  p_idx numbers the passages of a document; the pair of
    document and p_idx is the passage's id.  sents holds (sent_idx, orig, sent) in order.
    """
    docs = sents.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sent_idx", "orig", "sent"))).alias("all"))
    return docs_passages(docs, size, stride, by)


def docs_passages(docs: DataFrame, size: int = SIZE, stride: int = STRIDE, by: tuple[str, ...] = ("cid", "doc_id")) -> DataFrame:
    """As ``sliding``, of documents that hold their sentences in an array ``all``: no shuffle."""
    starts = F.when(F.size("all") > stride, F.sequence(F.lit(0), F.size("all") - stride - 1, F.lit(stride)))
    rows = docs.select(*by, "all", F.posexplode(starts).alias("p_idx", "start"))
    return rows.select(*by, "p_idx", "start", F.slice("all", F.col("start") + 1, F.lit(size)).alias("sents"))


def of_documents(docs: DataFrame, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """Sliding passages straight from (cid, doc_id, text), without normalisation beyond collapsing."""
    from lectern.functions import text as T

    kept = F.filter(F.transform(T.split_sentences(F.col("text")), lambda s: T.collapse(s)), lambda s: s != "")
    numbered = F.transform(kept, lambda s, k: F.struct(k.alias("sent_idx"), s.alias("orig"), s.alias("sent")))
    return docs_passages(docs.select("cid", "doc_id", numbered.alias("all")), size, stride)


def joined(passages: DataFrame, field: str = "sent") -> DataFrame:
    """Adds ``sent``: the passage's sentences in one text."""
    return passages.withColumn("sent", F.array_join(F.transform("sents", lambda s: s[field]), " "))


def retrieved(passages: DataFrame, records: DataFrame, keys: tuple[str, ...] = ("cid", "doc_id", "p_idx")) -> DataFrame:
    """The passages that a retrieval names."""
    return passages.join(records.select(*keys), list(keys), "left_semi")
