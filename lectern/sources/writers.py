"""Writers. They create or fail: nothing is appended to what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_records(records: DataFrame, path: str) -> None:
    """Records (cid, rank, sid, score, sent), a folder a cluster."""
    records.write.mode("errorifexists").partitionBy("cid").parquet(path)


def record_lines(records: DataFrame, with_rank: bool = False) -> DataFrame:
    """(cid, value): a tab-separated line a record, for tools that read text."""
    fields = (["rank"] if with_rank else []) + ["sid", "score", "sent"]
    return records.select("cid", "rank", F.concat_ws("\t", *[F.col(f).cast("string") for f in fields]).alias("value"))


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph's nodes and edges as two tables."""
    nodes.write.mode("errorifexists").partitionBy("cid").parquet(f"{path}/nodes")
    edges.write.mode("errorifexists").partitionBy("cid").parquet(f"{path}/edges")


def passages(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").partitionBy("cid").parquet(path)


def summaries(rows: DataFrame, path: str) -> None:
    """Summaries (cid, summary) as text, a folder a cluster."""
    rows.select("cid", F.col("summary").alias("value")).write.mode("errorifexists").partitionBy("cid").text(path)


def samples(rows: DataFrame, path: str) -> None:
    """Question-answer samples with a header, tab-separated."""
    rows.select("yy", "qid", "sid", "question", "sent").write.mode("errorifexists").csv(path, sep="\t", header=True)


def check_samples(rows: DataFrame) -> DataFrame:
    """Raw sample lines (value) as they are; a line without five fields is an error."""
    fields = F.size(F.split("value", "\t"))
    return rows.withColumn("value", F.when(fields == 5, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a sample has not five fields: "), "value"))))


def tuning_log(rows: DataFrame, path: str) -> None:
    """A row a parameter value, with a header."""
    rows.coalesce(1).write.mode("errorifexists").csv(path, sep="\t", header=True)  # a row a value


def converted_corpus(triples: DataFrame, passage_mark: str = "<P>", question_mark: str = "--T--") -> dict[str, DataFrame]:
    """Question, answer, document and summary tables of (idx, question, answer, document) triples.

    questions: the part before the mark, which must be there to be read; documents: sentences of each marked
    passage under ids of triple, passage and sentence; summaries: the answer's sentences.
    """
    from lectern.functions import text as T

    questions = triples.select("idx", T.before_marker(F.col("question"), question_mark).alias("question"))
    questions = questions.withColumn("question", F.when(F.col("question") != "", F.col("question")).otherwise(F.raise_error(F.concat(F.lit("an empty question: "), F.col("idx").cast("string")))))
    parts = triples.select("idx", F.posexplode(T.split_marked(F.col("document"), passage_mark)).alias("p", "part"))
    documents = parts.select("idx", "p", F.posexplode(T.split_sentences(F.col("part"))).alias("s", "sent"))
    documents = documents.select("idx", F.concat_ws("_", F.col("idx").cast("string"), F.col("p").cast("string"), F.col("s").cast("string")).alias("sid"), "sent")
    summaries = triples.select("idx", F.posexplode(T.split_sentences(F.col("answer"))).alias("line_no", "sent"))
    return {"questions": questions, "answers": triples.select("idx", "answer"), "documents": documents, "summaries": summaries}


def run_name(model: str, **parameters) -> str:
    """A name for a run's tables, from its parameters in the order given; null ones are left out."""
    return "-".join([model, *[f"{k}_{v}" for k, v in parameters.items() if v is not None]])
