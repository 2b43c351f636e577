"""Readers of cluster folders, marked-up articles and topics, tables, and question-answer corpora.

Readers of files take a session and a path; parsers take DataFrames or columns, so that the same rules serve text
that is already in a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

SEP = "_"
RECORD = "cid string, rank int, sid string, score double, sent string"
_QA = "data array<struct<paragraphs: array<struct<context: string, qas: array<struct<question: string, is_impossible: boolean, answers: array<struct<text: string, answer_start: int>>>>>>>>"


# Identifiers


def join_id(*columns: str | Column) -> Column:
    return F.concat_ws(SEP, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def id_part(column: str | Column, k: int) -> Column:
    """The k-th part of a joined id; fails where there are fewer."""
    parts = F.split(F.col(column) if isinstance(column, str) else column, SEP)
    return F.when(F.size(parts) > k, F.get(parts, k)).otherwise(F.raise_error(F.concat(F.lit(f"no part {k} in id "), F.array_join(parts, SEP))))


def parent_id(column: str | Column) -> Column:
    """The id without its last part."""
    parts = F.split(F.col(column) if isinstance(column, str) else column, SEP)
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), SEP)


# Cluster folders


def cluster_files(spark: SparkSession, root: str, year: str) -> DataFrame:
    """(cid, doc_id, path): the files of a year's cluster folders; editors' swap files are none. Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{year}")
    parts = F.split("path", "/")
    rows = rows.select("path", F.element_at(parts, -2).alias("cluster"), F.element_at(parts, -1).alias("name")).where(~F.endswith("name", F.lit(".swp")))
    cid = join_id(F.lit(year), "cluster")
    return rows.select(cid.alias("cid"), join_id(cid, "name").alias("doc_id"), "path")


def whole_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, raw): one row a file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.decode("content", encoding).alias("raw"))


def articles(spark: SparkSession, root: str, year: str, joined: bool = True) -> DataFrame:
    """(cid, doc_id, text or paras): article bodies of a year's folders; null where a file has no body."""
    files = cluster_files(spark, root, year).join(whole_files(spark, f"{root.rstrip('/')}/{year}"), "path")
    body = article_body(F.col("raw"))
    return files.select("cid", "doc_id", body.alias("text") if joined else T.split_paragraphs(body).alias("paras"))


# Marked-up text


def first_block(raw: Column, *tags: str) -> Column:
    """The content of the first block of the first tag that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(raw, f"(?s)<{t}>(.*?)</{t}>", 1), F.lit("")) for t in tags])


def article_body(raw: Column) -> Column:
    """The TEXT block, or else the GRAPHIC block; P blocks in it, if any, joined by blank lines. Null without either."""
    block = F.coalesce(*[F.nullif(F.regexp_extract(raw, f"(?s)<{t}>\\n(.*?)\\n</{t}>", 1), F.lit("")) for t in ("TEXT", "GRAPHIC")])
    paras = F.regexp_extract_all(block, F.lit("(?s)<P>\\n(.*?)\\n</P>"), F.lit(1))
    return F.when(F.size(paras) > 0, F.array_join(paras, "\n\n")).otherwise(block)


def tagged_paragraphs(html: Column) -> Column:
    """Texts of the P elements, closed or not, without markup and empty ones."""
    parts = F.split(html, "<[pP]( [^>]*)?>")
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def clean(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "(?s)</[pP]>.*$", ""), "<[^>]*>", " "), T.SPACE, " "))

    return F.filter(F.transform(parts, clean), lambda x: x != "")


# Topics and queries


def topics(rows: DataFrame) -> DataFrame:
    """(cid, title, narr, narr_sents, query) of topic files (year, raw).

    Topics stand three line ends apart.  A segment without a number ends the file; one with a number but without
    title or narrative is an error.  query: "describe", the title with one period, and the narrative.
    """
    segs = F.filter(F.transform(F.split("raw", "\n\n\n"), lambda s: F.regexp_replace(s, "\\n+$", "")), lambda s: s != "")
    rows = rows.select("year", F.posexplode(segs).alias("k", "seg"))
    field = {"num": "(?s)<num> (.*?) </num>", "title": "(?s)<title> (.*?) </title>", "narr": "(?s)<narr>\\n(.*?)\\n</narr>"}
    rows = rows.select("year", "k", *[F.nullif(F.regexp_extract("seg", p, 1), F.lit("")).alias(n) for n, p in field.items()])
    ended = F.max(F.col("num").isNull().cast("int")).over(Window.partitionBy("year").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("ended", ended).where("ended = 0")
    for name in ("title", "narr"):
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), F.trim(F.regexp_replace(name, T.SPACE, " "))).otherwise(F.raise_error(F.concat(F.lit(f"no {name} in topic "), "num"))))
    gap = F.when(F.endswith("title", F.lit(".")), " ").otherwise(". ")
    sents = F.transform(T.split_sentences(F.col("narr")), lambda s: F.trim(s))
    return rows.select(join_id("year", "num").alias("cid"), "title", "narr", sents.alias("narr_sents"), F.concat(F.lit("describe "), "title", gap, "narr").alias("query"))


def merged_years(years: list[DataFrame]) -> DataFrame:
    """Queries of several years; where two have one cid, the earlier in the list wins."""
    rows = None
    for k, one in enumerate(years):
        one = one.withColumn("_year", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    first = Window.partitionBy("cid").orderBy("_year")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_year")


def paired(clusters: DataFrame, queries: DataFrame) -> DataFrame:
    """Every cluster with its query; a cluster without one is an error."""
    out = clusters.join(queries, "cid", "left")
    return out.withColumn("query", F.when(F.col("query").isNotNull(), F.col("query")).otherwise(F.raise_error(F.concat(F.lit("no query for cluster "), "cid"))))


def tsv_queries(spark: SparkSession, path: str, processed: bool = True) -> DataFrame:
    """(cid, domain, query): a tab-separated file; processed: lower case and stems, stop words kept."""
    rows = spark.read.csv(path, sep="\t", schema="cid string, domain string, query string", quote="")
    return rows.withColumn("query", T.normalise(F.col("query"), stem=True)) if processed else rows


def reference_query(rows: DataFrame) -> DataFrame:
    """(cid, query): the lines (line_no, sent) of a cluster's reference, joined without a separator."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "sent")))
    return rows.groupBy("cid").agg(F.array_join(F.transform(lines, lambda x: x["sent"]), "").alias("query"))


# Sentences, references, records


def sentence_lines(rows: DataFrame, flat: bool = False, **normalise) -> DataFrame:
    """(cid, doc_idx, sent_idx, orig, sent) of files (cid, name, raw) with a sentence a line.

    Lines whose processed form is empty go.  flat: all documents of a cluster, in the order of their names, as one
    document 0.
    """
    docs = Window.partitionBy("cid").orderBy("name")
    rows = rows.withColumn("doc_idx", F.row_number().over(docs) - 1)
    rows = rows.select("cid", "doc_idx", F.posexplode(F.split("raw", "\n")).alias("k", "line"))
    rows = rows.select("cid", "doc_idx", "k", T.collapse(F.col("line")).alias("orig"), T.normalise(F.col("line"), **normalise).alias("sent")).where("sent <> ''")
    order = Window.partitionBy("cid").orderBy("doc_idx", "k") if flat else Window.partitionBy("cid", "doc_idx").orderBy("k")
    rows = rows.withColumn("sent_idx", F.row_number().over(order) - 1)
    return rows.select("cid", (F.lit(0) if flat else F.col("doc_idx")).alias("doc_idx"), "sent_idx", "orig", "sent")


def filtered_sentences(rows: DataFrame, **normalise) -> DataFrame:
    """Lines (line) of a pre-filtered file: the line as it is, and its processed form without dialogue."""
    out = rows.select(F.col("line").alias("orig"), T.normalise(F.col("line"), rm_dialog=True, **normalise).alias("sent"))
    return out.where("sent IS NOT NULL")


def reference_summaries(spark: SparkSession, path: str, resegment: bool = False) -> DataFrame:
    """(name, line_no, sent): Latin-1 files with a sentence a line, or whole texts to be split."""
    rows = whole_files(spark, path, "ISO-8859-1")
    lines = T.split_sentences(F.regexp_replace("raw", "\n", " ")) if resegment else F.split("raw", "\n")
    lines = F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s != "")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.posexplode(lines).alias("line_no", "sent"))


def rank_records(spark: SparkSession, path: str) -> DataFrame:
    """Rank records as ``writers.rank_records`` wrote them; rank is a column, files have no order."""
    return spark.read.schema(RECORD).parquet(path)


def text_records(rows: DataFrame) -> DataFrame:
    """Records of tab-separated lines (cid, line_no, line): id, score, and a sentence if there is a third field."""
    parts = F.split("line", "\t")
    arity = F.size(parts)
    score = F.when(arity.isin(2, 3), F.get(parts, 1)).otherwise(F.raise_error(F.concat(F.lit("a record has neither 2 nor 3 fields: "), "line"))).cast("double")
    return rows.select("cid", (F.col("line_no") + 1).cast("int").alias("rank"), F.get(parts, 0).alias("sid"), score.alias("score"), F.get(parts, 2).alias("sent"))


def retrieved_sentences(records: DataFrame, **normalise) -> DataFrame:
    """A retrieval as one pseudo-document 0 of its cluster, in rank order; empty processed forms stay."""
    return records.select("cid", F.lit(0).alias("doc_idx"), (F.col("rank") - 1).alias("sent_idx"), F.col("sent").alias("orig"), T.normalise(F.col("sent"), **normalise).alias("sent"))


def retrieved_paragraphs(records: DataFrame, **normalise) -> DataFrame:
    """As ``retrieved_sentences`` for records of paragraphs: sentences normalised one by one, empty ones dropped, re-joined."""
    rows = records.select("cid", "rank", F.col("sent").alias("orig"), F.posexplode_outer(T.split_sentences(F.col("sent"))).alias("k", "s"))
    rows = rows.withColumn("p", T.normalise(F.col("s"), **normalise))
    parts = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("p") != "", F.lit(False)), F.struct("k", "p"))))
    out = rows.groupBy("cid", "rank", "orig").agg(F.array_join(F.transform(parts, lambda x: x["p"]), " ").alias("sent"))
    return out.select("cid", F.lit(0).alias("doc_idx"), (F.col("rank") - 1).alias("sent_idx"), "orig", "sent")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as ``writers.graph`` wrote them; fails where they are not there."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def passages(spark: SparkSession, path: str, records: DataFrame | None = None, keys: tuple[str, ...] = ("cid", "doc_id", "p_idx")) -> DataFrame:
    """Stored passages: all, or those that a retrieval names."""
    rows = spark.read.parquet(path)
    return rows if records is None else rows.join(records.select(*keys).distinct(), list(keys), "left_semi")


def reference_targets(files: DataFrame, clusters: DataFrame, lower: bool = False) -> DataFrame:
    """(cid, ref_idx, name): the reference files (prefix, name) of each cluster, numbered from 1 in the order of their names.

    A file belongs to the cluster whose id begins with its prefix; lower: prefixes are written in another case.
    """
    rows = files.withColumn("prefix", F.lower("prefix")) if lower else files
    order = Window.partitionBy("cid").orderBy("name")
    return match_prefix(rows, clusters, "prefix", "cid").select("cid", F.row_number().over(order).alias("ref_idx"), "name")


# Question-answer corpora


def qa_corpus(spark: SparkSession, path: str) -> DataFrame:
    return qa_paragraphs(spark.read.schema(_QA).json(path, multiLine=True))


def qa_paragraphs(rows: DataFrame) -> DataFrame:
    """(pid, context, qas) of nested question-answer JSON."""
    rows = rows.select(F.posexplode("data").alias("d", "entry")).select("d", F.posexplode("entry.paragraphs").alias("p", "para"))
    return rows.select(join_id("d", "p").alias("pid"), F.trim("para.context").alias("context"), "para.qas")


def qa_sentences(paragraphs: DataFrame) -> DataFrame:
    """(pid, sent_idx, sent)."""
    return paragraphs.select("pid", F.posexplode(F.filter(T.split_sentences(F.col("context")), lambda s: s != "")).alias("sent_idx", "sent"))


def qa_questions(paragraphs: DataFrame) -> DataFrame:
    """(pid, qid, question, start): start of the first answer; null for questions without one."""
    rows = paragraphs.select("pid", F.posexplode("qas").alias("q", "qa"))
    start = F.when(~F.coalesce("qa.is_impossible", F.lit(False)), F.get("qa.answers", F.lit(0))["answer_start"])
    return rows.select("pid", join_id("pid", "q").alias("qid"), F.trim("qa.question").alias("question"), start.alias("start"))


def qa_samples(paragraphs: DataFrame) -> DataFrame:
    """(pid, qid, question, yy, sent_idx, sent): every sentence of a question's paragraph, labelled."""
    from lectern.operators import corpus

    sents, questions = qa_sentences(paragraphs), qa_questions(paragraphs)
    asked = questions.where("start IS NOT NULL").select("pid", "start").distinct()
    found = corpus.first_match(sents, asked, ("pid",)).withColumnRenamed("sent_idx", "ans_idx")
    return corpus.samples(questions.join(found, ["pid", "start"], "left").drop("start"), sents, ("pid",))


def qa_triples(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer, document), trimmed, of a flat JSON list."""
    rows = spark.read.schema("question string, answer string, document string").json(path, multiLine=True)
    return rows.select(*[F.trim(c).alias(c) for c in rows.columns])


# Matching by prefix


def match_prefix(prefixes: DataFrame, names: DataFrame, prefix: str, name: str) -> DataFrame:
    """Pairs whose name begins with the prefix: an equi-join on the name's own prefixes, not a nested loop."""
    cut = names.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substr(F.col(name), F.lit(1), n))))
    return prefixes.join(cut, prefixes[prefix] == cut["_p"]).drop("_p")
