"""Byte-level BPE encoding and decoding with a local rank file (operator 1)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of a text that go to the encoder at once.
SPAN = 1 << 16
#: No match of the splitting pattern spans such a place: a match holds white space only at its start or
#: nothing else, and none holds a letter and a digit.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file: base64 token and rank in each line. One for each worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def spans(text: str, span: int = SPAN) -> Iterator[str]:
    """The text cut at safe places into parts of about ``span`` characters; a part without one stays whole."""
    at = 0
    while len(text) - at > span:
        cut = _SAFE.search(text, at + span)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(text: str | None, encoder: tiktoken.Encoding) -> list[int]:
    """Token ids of the whole text; strings of special tokens are ordinary text."""
    if not text:
        return []
    if len(text) <= SPAN:
        return encoder.encode_ordinary(text)
    return [i for part in spans(text) for i in encoder.encode_ordinary(part)]


def decode(ids: list[int], encoder: tiktoken.Encoding) -> bytes:
    """The raw bytes; a token may end inside a character, so text is only made of the whole."""
    return encoder.decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of every text; an empty array for null and empty texts."""

    def step(batches):
        encoder = encoding(path, pattern)
        for batch in common.pieces(batches, "text"):
            yield common.batch_of(doc_id=batch.column("doc_id"), ids=pa.array([encode(t, encoder) for t in batch.column("text").to_pylist()], pa.list_(pa.int32())))

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, data): the raw bytes of every id list. A null list counts as empty; an unknown id fails."""

    def step(batches):
        encoder = encoding(path, pattern)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield common.batch_of(
                doc_id=batch.column("doc_id"), n_tokens=pa.array([len(x or ()) for x in ids], pa.int64()),
                ids=batch.column("ids"), data=pa.array([decode(x or [], encoder) for x in ids], pa.binary()),
            )

    return common.arrow_map(encoded.select("doc_id", "ids"), step, "doc_id long, n_tokens long, ids array<int>, data binary")


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens): lengths only, so that ids do not leave the worker.

    Null and empty texts have 0 tokens; very long ones are encoded whole, in parts; repeated rows each give a row; other columns
    play no part; an empty table gives no rows.
    """

    def step(batches):
        encoder = encoding(path, pattern)
        for batch in common.pieces(batches, "text"):
            yield common.batch_of(doc_id=batch.column("doc_id"), n_tokens=pa.array([len(encode(t, encoder)) for t in batch.column("text").to_pylist()], pa.int64()))

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, n_tokens long")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them.

    Encodes and decodes in one pass over the texts, so that neither ids nor bytes are copied between processes.  Null counts
    as empty, which gives 0 tokens and the digests of nothing; very long texts are encoded whole, in parts cut where no
    match of the pattern spans; equal texts have equal digests; repeated rows and rows without doc_id each give a row; other
    columns play no part; an empty table gives no rows.
    """

    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def step(batches):
        encoder = encoding(path, pattern)
        for batch in common.pieces(batches, "text"):
            count, of_ids, of_bytes = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text, encoder)
                count.append(len(ids))
                of_ids.append(digest(",".join(map(str, ids)).encode()))
                of_bytes.append(digest(decode(ids, encoder)))
            yield common.batch_of(doc_id=batch.column("doc_id"), n_tokens=pa.array(count, pa.int64()), ids_sha256=of_ids, decoded_sha256=of_bytes)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, schema)
