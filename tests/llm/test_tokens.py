"""BPE, binary records and packing."""

import base64
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, packing, records

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "é", "B", "'", "s", "t", "1", "²", " ", "  ", "\n", "\t", "!", "-", "'s", "'ll", "β", "你", "_", "́", "ʼ", "×", "\x1c", "\x85", " ", "᠎", "﻿", "😀", "<|endoftext|>"]
texts = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_spans_are_safe(plain, text):
    parts = list(bpe.spans(text, 5))
    assert "".join(parts) == text
    assert [i for p in parts for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)


def test_long_texts(plain):
    encoder = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in ("word, 12 " * 40_000, "a" * 200_000, " " * 200_000 + "x", "ab1" * 60_000, "é\n" * 50_000):
        ids = bpe.encode(text, encoder)
        assert ids == plain.encode_ordinary(text) and bpe.decode(ids, encoder) == text.encode()


def test_round_trip(documents, plain):
    want = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in bpe.round_trip(documents, RANKS, public_tokenizers.PATTERN).collect():
        ids = plain.encode_ordinary(want[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_encode_then_decode(documents):
    encoded = bpe.encode_documents(documents, RANKS, public_tokenizers.PATTERN)
    out = bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN)
    want = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    assert {r["doc_id"]: bytes(r["data"]) for r in out.collect()} == want
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(documents, RANKS, public_tokenizers.PATTERN).collect()}
    assert counts == {r["doc_id"]: r["n_tokens"] for r in out.collect()}


def test_no_documents(no_documents):
    assert bpe.round_trip(no_documents, RANKS, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(texts, max_size=8), st.sampled_from([0, 3, 1000]))
def test_encoder_gives_the_tokenizers_ids(tokenizer, rows, remember):
    encoder = records.Encoder(JSON, 0, remember)
    for _ in range(2):
        for text, payload in zip(rows, encoder.payloads(rows), strict=True):
            assert np.frombuffer(payload, encoder.dtype).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_records(spark, documents, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/rec"
    shards = records.write_records(documents, JSON, folder)
    start = 0
    want = {}
    for r in sorted(documents.collect(), key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    out = records.read_records(shards, folder).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in out} == want and len(out) == len(want)
    name = shards.first()["shard"]
    forward = list(records.read_shard(folder, name))
    shuffled = list(records.read_shard(folder, name, reversed(range(len(forward)))))
    assert [d for d, _ in shuffled] == [d for d, _ in forward][::-1]
    assert all((a == b).all() for (_, a), (_, b) in zip(forward, shuffled[::-1], strict=True))
    assert [d for d, _ in forward] == sorted(d for d, _ in forward)


@pytest.mark.parametrize("at", [8, 15, 17, 25, -1])
def test_damaged_records_are_found(tmp_path, at):
    records.write_shard(str(tmp_path), "s", [(1, b"\1\0\2\0"), (2, b"\3\0")], 2)
    data = bytearray((tmp_path / "s.rec").read_bytes())
    data[at] ^= 1
    (tmp_path / "s.rec").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_shard(str(tmp_path), "s"))


def test_records_of_nothing(spark, no_documents, tmp_path):
    shards = records.write_records(no_documents, JSON, str(tmp_path))
    assert records.read_records(shards, str(tmp_path)).collect() == []


def test_records_without_ids_come_first(spark, tmp_path):
    rows = spark.createDataFrame([(5, "a"), (None, "b c"), (5, None), (-3, "d")], "doc_id long, text string")
    out = records.read_records(records.write_records(rows, JSON, str(tmp_path)), str(tmp_path)).sort("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in out] == [(None, 0, 3), (-3, 3, 2), (5, 5, 1), (5, 6, 2)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 12), st.integers(1, 9), min_size=1), st.integers(1, 4))
def test_boundaries_are_optimal(counts, buckets):
    table = np.zeros(13, int)
    for k, n in counts.items():
        table[k] = n

    def padding(ends):
        return sum(n * (min(e for e in ends if e >= k) - k) for k, n in counts.items())

    best = min(padding((*c, max(counts))) for r in range(min(buckets, len(counts))) for c in itertools.combinations(sorted(counts)[:-1], r))
    ends = packing.boundaries(table, buckets)
    assert padding(ends) == best and len(ends) <= buckets and ends == sorted(set(ends))


def test_packing_loses_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(n)) for k, n in enumerate(rng.integers(0, 300, 500))] + [(500, None), (501, 1000), (501, 1000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), context=128, buckets=4, budget=512).toPandas()
    assert out["n_tokens"].sum() == sum(n or 0 for _, n in rows)
    assert set(out["doc_id"]) == {k for k, _ in rows}
    assert (out["n_tokens"] <= out["bucket_len"]).all() and out["bucket_len"].nunique() <= 4
    per = out.groupby("batch")
    assert (per["bucket_len"].sum() <= 512).all() and (per["bucket"].nunique() == 1).all()
    assert (per["slot"].max() + 1 == per.size()).all() and per["slot"].nunique().equals(per.size())
    assert sorted(out["batch"].unique()) == list(range(out["batch"].nunique()))
    full = out.groupby("bucket").agg(n=("slot", "size"), batches=("batch", "nunique"), length=("bucket_len", "first"))
    assert (full["batches"] == np.ceil(full["n"] / (512 // full["length"].clip(lower=1)))).all()


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []
    with pytest.raises(ValueError, match="batch"):
        packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), context=10, budget=5)


def test_strings_of_special_tokens(spark, tokenizer, tmp_path):
    texts = ["hello <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "<|endoftext |>"]
    encoder = records.Encoder(JSON, 0)
    for text, payload in zip(texts, encoder.payloads(texts), strict=True):
        assert np.frombuffer(payload, encoder.dtype).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert 50256 in np.frombuffer(encoder.payloads(texts)[0], encoder.dtype)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = records.read_records(records.write_records(rows, JSON, str(tmp_path)), str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}


def test_clashing_columns(spark, documents, tmp_path):
    from pyspark.sql import functions as F

    few = documents.where("doc_id < 40")
    wide = few.select("*", *[F.lit("x").alias(c) for c in ("ids", "n_tokens", "shard", "start", "piece", "bucket", "batch", "slot", "size", "at", "mix")])
    both = [sorted(map(str, bpe.round_trip(d, RANKS, public_tokenizers.PATTERN).collect())) for d in (few, wide)]
    assert both[0] == both[1]
    both = [sorted(map(str, records.read_records(records.write_records(d, JSON, f"{tmp_path}/{k}"), f"{tmp_path}/{k}").collect())) for k, d in enumerate((few, wide))]
    assert both[0] == both[1]
    lengths = [bpe.count_tokens(few, RANKS, public_tokenizers.PATTERN), bpe.count_tokens(few, RANKS, public_tokenizers.PATTERN).selectExpr("*", "'x' AS piece", "'y' AS bucket", "1 AS at", "2 AS mix", "3 AS size")]
    both = [sorted(map(str, packing.pack(d).collect())) for d in lengths]
    assert both[0] == both[1]


def packed_plainly(rows, context, ends, budget):
    """The packing by loops: given the boundaries and the order of pieces in a bucket, which batch and slot each has."""
    per = {k: max(1, budget // max(1, e)) for k, e in enumerate(ends)}
    buckets = {k: [] for k in per}
    for doc, n in rows:
        n = n or 0
        for piece in range(max(1, -(-n // context))):
            size = min(context, n - piece * context)
            buckets[next(k for k, e in enumerate(ends) if size <= e)].append((doc, piece, size))
    batches = sum(-(-len(x) // per[k]) for k, x in buckets.items())
    return {k: sorted(x) for k, x in buckets.items()}, batches, per


def test_packing_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(n)) for k, n in enumerate(rng.integers(0, 400, 700))] + [(700, None), (701, 5000), (702, 128), (702, 128)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), context=128, buckets=5, budget=600).toPandas()
    counts = np.zeros(129, int)
    for _, n in rows:
        n = n or 0
        for piece in range(max(1, -(-n // 128))):
            counts[min(128, n - piece * 128)] += 1
    ends = packing.boundaries(counts, 5)
    want, batches, per = packed_plainly(rows, 128, ends, 600)
    assert sorted(out["bucket_len"].unique()) == ends and out["batch"].nunique() == batches
    for k, pieces in want.items():
        own = out[out["bucket"] == k]
        assert sorted(zip(own["doc_id"], own["piece"], own["n_tokens"], strict=True)) == pieces
        assert (own["bucket_len"] == ends[k]).all()
        first = own["batch"].min()
        places = sorted(((own["batch"] - first) * per[k] + own["slot"]).tolist())
        assert places == list(range(len(pieces)))
    assert out.sort_values("bucket")["batch"].is_monotonic_increasing or out.groupby("batch")["bucket"].nunique().max() == 1


def test_records_of_a_long_text(spark, tokenizer, tmp_path):
    text = "some words, 12 of them; " * 60_000
    out = records.read_records(records.write_records(spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string"), JSON, str(tmp_path)), str(tmp_path)).sort("doc_id").collect()
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert (out[0]["n_tokens"], out[0]["ids_crc32"], out[1]["start"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids))
