"""The pipeline against a plain version of each of its stages."""

import re

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lectern.llm import bpe, exact, langid, queries, simhash, substring

from . import plain_language
from .test_dedup import WORD, removed_by_brute_force, smallest


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def in_order(rows):
    """Rows (doc_id, text) by id, those without last."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def first_of_each_text(rows):
    seen, out = set(), []
    for r in in_order(rows):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if norm not in seen:
            out.append(r)
        seen.add(norm)
    return out


def first_of_each_group(rows):
    prints = [fingerprint(r[1]) for r in rows]
    n = range(len(rows))
    comp = smallest([(a, b) for a in n for b in n if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], n)
    groups = {}
    for k in n:
        groups.setdefault(comp[k], []).append(rows[k])
    return [in_order(g)[0] for g in groups.values()]


def without_repeats(rows, width=50):
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    first = {}
    for (d, _), ws in zip(rows, words, strict=True):
        for k in range(len(ws) - width + 1 if d is not None else 0):
            w = tuple(ws[k : k + width])
            first[w] = min(first.get(w, d), d)
    out = []
    for (d, t), ws in zip(rows, words, strict=True):
        gone = {p for k in range(len(ws) - width + 1 if d is not None else 0) if first[tuple(ws[k : k + width])] < d for p in range(k, k + width)}
        out.append((d, b" ".join(w for k, w in enumerate(ws) if k not in gone).decode() if gone else t))
    return out


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


SIX = [(1, "a"), (2, "a"), (2, "other"), (5, "x"), (5, "x"), (None, "a")]
LONG = " ".join(f"w{k}" for k in range(60))
AWKWARD = [
    *SIX, (3, LONG), (4, f"k k k {LONG}"), (4, "short one"), (4, "z " * 70), (7, f"{LONG} end"), (7, f"other start {LONG}"), (None, f"{LONG} no id"), (None, None), (9, None), (9, ""),
    (None, "lone"), (None, "lone"), (-3, "lone  too"), (11, "b " * 20_000 + LONG), (12, "B " * 20_000 + LONG), (13, " \t"), (14, "lone too"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, repeated and negative ids, null and long texts, and columns named as the operators name their own."""
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string").repartition(3)
    clash = ["row", "marks", "sub", "fp", "at", "edge", "part", "norm", "head", "digest", "id", "first", "c", "kept", "begin", "n", "Fp_", "place", "edge_text", "k"]
    return rows.select(F.lit("x").alias("lang"), "*", *[F.lit("x").alias(c) for c in clash]).cache()


@pytest.mark.parametrize(("stage", "plainly"), [(exact.keep_first, first_of_each_text), (simhash.keep_first, first_of_each_group), (substring.strip_documents, without_repeats)])
def test_stages_by_rows(awkward, stage, plainly):
    out = stage(awkward)
    assert out.columns == awkward.columns and out.dtypes == awkward.dtypes
    assert pairs(out) == sorted(plainly(AWKWARD), key=str)
    assert stage(awkward.limit(0)).collect() == []


def test_six_rows(spark):
    rows = spark.createDataFrame(SIX, "doc_id long, text string")
    for stage in (exact.keep_first, simhash.keep_first):
        assert pairs(stage(rows)) == [(1, "a"), (2, "other"), (5, "x")]


def test_a_frequent_text_and_a_frequent_beginning(spark):
    """A third of all rows is one text, a third begins alike; ids repeat and are missing."""
    kind = F.col("id") % 3
    text = F.when(kind == 0, F.lit("the  same")).when(kind == 1, F.concat(F.lit("l" * 40), (F.col("id") % 500).cast("string"))).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    rows = spark.range(6000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 1000).alias("doc_id"), text.alias("text")).repartition(6).cache()
    want = first_of_each_text([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert pairs(exact.keep_first(rows)) == sorted(want, key=str)
    out = exact.exact_duplicates(rows).toPandas()
    assert len(out) == 6000 and int(out["kept"].sum()) == len(want) and out["group_size"].max() == 2000


def test_languages_that_go(spark, documents):
    by_language = {r["doc_id"]: r["lang_pred"] for r in langid.identify(documents).collect()}
    score = {r["doc_id"]: r["score"] for r in langid.identify(documents).collect()}
    out = langid.accepted(documents, ("de",), 0.9)
    assert {r["doc_id"] for r in out.collect()} == {d for d, p in by_language.items() if p == "de" and score[d] >= 0.9}
    assert 0 < out.count() < documents.count()
    strange = spark.createDataFrame([(1000 + k, "это другой язык, совсем не такой как те, что были " * 3, None, "s", 1) for k in range(3)], documents.schema)
    assert langid.accepted(documents.union(strange)).where("doc_id >= 1000").count() == 0


@pytest.fixture(scope="module")
def folder(documents, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    documents.coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_pipeline(spark, documents, folder):
    kept = plain_language.accepted([(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()])
    docs = [(r["doc_id"], r["text"]) for r in documents.collect() if r["doc_id"] in kept]
    docs = dict(without_repeats(first_of_each_group(first_of_each_text(docs))))
    for d, (_, gone, text) in removed_by_brute_force(docs, 50).items():
        assert not gone or docs[d] == text
    encoder = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {d: len(encoder.encode_ordinary(t)) for d, t in docs.items()}
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == want
    assert (out["n_tokens"] <= out["bucket_len"]).all() and (out.groupby("batch")["bucket_len"].sum() <= 65536).all()


def test_pipeline_of_awkward_rows(spark, awkward, tmp_path):
    awkward.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    letters = [r for r in AWKWARD if any(c.isalpha() for c in r[1] or "")]
    docs = without_repeats(first_of_each_group(first_of_each_text(letters)))
    encoder = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted(((r["doc_id"], r["n"]) for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()), key=str)
    want = {}
    for d, t in docs:
        want[d] = want.get(d, 0) + len(encoder.encode_ordinary(t))
    assert got == sorted(want.items(), key=str)


def test_pipeline_leaves_no_tables(spark, folder, tmp_path):
    import os

    shared = corpus_pipeline.common.shared_folder(spark).removeprefix("file:")
    corpus_pipeline.run(spark, folder).count()
    assert not [x for x in os.listdir(shared) if x.startswith("pipeline-")]


def test_stages_keep_the_columns(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes, name


def test_pipeline_of_nothing(spark, no_documents, tmp_path):
    no_documents.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
