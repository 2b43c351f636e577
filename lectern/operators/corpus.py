"""Documents, queries, references and sentences of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.shipping import ship

#: Clusters with a query of their own in the benchmark table.
CLUSTERS = 20
MARKER = "[unused{}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """(cid, doc_id, text); the cluster of a document is its source. lang: only documents of that language, for rules that know one."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if lang is None else docs.where(F.col("lang") == lang)
    return spread(docs.select(F.col("source").alias("cid"), "doc_id", "text"))


def spread(rows: DataFrame) -> DataFrame:
    """The rows over as many tasks as the cluster runs at once, where the files alone give fewer; large tables stay as they are."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(least) if rows.rdd.getNumPartitions() < least else rows


def cluster_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, query): benchmark item k asks about cluster src{k}."""
    rows = table(spark, sf_dir, "benchmark").where(F.col("item_id") < CLUSTERS)
    return rows.select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("cid"), F.col("text").alias("query"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, ref_idx, text): items k and k + 20 are the two references of src{k}."""
    rows = table(spark, sf_dir, "benchmark").where(F.col("item_id") < 2 * CLUSTERS)
    return rows.select(
        F.concat(F.lit("src"), (F.col("item_id") % CLUSTERS).cast("string")).alias("cid"),
        (F.floor(F.col("item_id") / CLUSTERS) + 1).cast("int").alias("ref_idx"), "text",
    )


def sentence_texts(text):
    """A text's sentences, lower-cased and collapsed, without empty ones."""
    return F.filter(F.transform(T.split_sentences(text), lambda s: T.collapse(s)), lambda s: s != "")


def sentences(docs: DataFrame, most: int | None = None, **normalise) -> DataFrame:
    """(the documents' other columns, sent_idx, orig, sent): sentences whose processed form is not empty.

    orig is lower-cased and collapsed, sent processed as asked; sent_idx numbers the sentences kept in a document.
    most: only that many from the head of each document.
    """
    pairs = sentence_texts(F.col("text"))
    other = [c for c in docs.columns if c != "text"]
    if not normalise:
        kept = pairs if most is None else F.slice(pairs, 1, most)
        return docs.select(*other, F.posexplode(kept).alias("sent_idx", "sent")).select(*other, "sent_idx", F.col("sent").alias("orig"), "sent")
    if normalise.get("stem"):
        # the stemmer is no expression of an array's elements, so it takes a document's sentences as one array
        ship(docs.sparkSession)
        rest = {k: v for k, v in normalise.items() if k != "stem"}
        docs = docs.select(*other, pairs.alias("_orig")).withColumn("_sent", T.stemmed_each(F.transform("_orig", lambda s: T.normalise(s, **rest))))
        both = F.zip_with("_orig", "_sent", lambda o, s: F.struct(o.alias("orig"), s.alias("sent")))
    else:
        both = F.transform(pairs, lambda s: F.struct(s.alias("orig"), T.normalise(s, **normalise).alias("sent")))
    both = F.filter(both, lambda e: e["sent"].isNotNull() & (e["sent"] != ""))
    both = both if most is None else F.slice(both, 1, most)
    return docs.select(*other, F.posexplode(both).alias("sent_idx", "e")).select(*other, "sent_idx", "e.orig", "e.sent")


def paragraphs(docs: DataFrame, most: int | None = None, tiled: bool = False, **normalise) -> DataFrame:
    """(the documents' other columns, para_idx, para): blank-line parts, or topic tiles; most: only that many from the head.

    normalise: adds orig and proc, the paragraph's sentences, lower-cased and as asked, of those whose processed form is not empty.
    """
    from lectern.functions.tiling import tiles

    other = [c for c in docs.columns if c != "text"]
    if tiled:
        ship(docs.sparkSession)
    parts = tiles(F.col("text")) if tiled else T.split_paragraphs(F.col("text"))
    docs = docs.select(*other, parts.alias("parts"))
    out = docs.select(*other, F.posexplode(F.slice("parts", 1, most) if most else F.col("parts")).alias("para_idx", "para"))
    if not normalise:
        return out
    both = F.transform(T.split_sentences(F.col("para")), lambda s: F.struct(T.collapse(s).alias("orig"), T.normalise(s, **normalise).alias("sent")))
    both = F.filter(both, lambda e: e["sent"].isNotNull() & (e["sent"] != ""))
    out = out.withColumn("_both", both)
    return out.withColumn("orig", F.array_join("_both.orig", " ")).withColumn("proc", F.array_join("_both.sent", " ")).drop("_both")


def without_listed(docs: DataFrame, listed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops the documents of a denylist."""
    return docs.join(listed.select(key).distinct(), key, "left_anti")


def with_context(sents: DataFrame, window: int, by: tuple[str, ...] = ("cid", "doc_id"), text: str = "sent") -> DataFrame:
    """Adds ``context``: the sentence, then for each distance the one before and the one after, each behind a marker.

    A marker stands alone at the ends of a document.  Window 0 gives the sentence.
    """
    from pyspark.sql import Window

    if window < 0:
        raise ValueError("the window is negative")
    w = Window.partitionBy(*by).orderBy("sent_idx")
    parts, number = [F.col(text)], 0
    for k in range(1, window + 1):
        for near in (F.lag(text, k).over(w), F.lead(text, k).over(w)):
            number += 1
            parts.append(F.concat(F.lit(MARKER.format(number) + " "), F.coalesce(near, F.lit(""))))
    return sents.withColumn("context", F.concat_ws(" ", *parts))


def first_match(sents: DataFrame, starts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The sentence that holds a character offset: the first whose running length, one added a sentence, exceeds it.

    sents: (by, sent_idx, sent); starts: (by, start).  Offsets beyond the last sentence give none.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("sent_idx")
    ends = sents.withColumn("reach", F.sum(F.length("sent") + 1).over(w) - 1)
    hit = ends.join(starts, list(by)).where(F.col("reach") > F.col("start"))
    return hit.groupBy(*by, "start").agg(F.min("sent_idx").alias("sent_idx"))


def samples(questions: DataFrame, sents: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, qid, question, yy, sent_idx, sent): every sentence of the question's paragraph, 1 for the answer's.

    questions: (by, qid, question, ans_idx); without an answer (null) all are 0.
    """
    out = questions.join(sents, list(by))
    return out.select(*by, "qid", "question", (F.col("sent_idx").eqNullSafe(F.col("ans_idx"))).cast("int").alias("yy"), "sent_idx", "sent")


def size_distribution(sents: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(n_sents, n, share, cum_share): how many groups have how many sentences."""
    from pyspark.sql import Window

    sizes = sents.groupBy(*by).agg(F.count("*").alias("n_sents")).groupBy("n_sents").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    w = Window.orderBy("n_sents")  # one row for each size that occurs
    out = sizes.crossJoin(F.broadcast(total))  # one row
    return out.select("n_sents", "n", (F.col("n") / F.col("total")).alias("share"), (F.sum("n").over(w) / F.col("total")).alias("cum_share"))
