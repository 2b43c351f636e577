"""Token ids as length-delimited binary records with an offset index (operator 7).

A shard is a pair of files.  ``x.rec`` begins with 8 bytes: the magic ``LREC`` and the bytes of an id (2 or 4)
as a 32-bit number.  Each record follows as

    uint64  length of the payload in bytes
    uint32  masked checksum of these eight bytes
    bytes   payload: the ids, little-endian
    uint32  masked checksum of the payload

where a checksum is CRC-32 rotated right by 15 bits plus a constant, so that data that hold checksums do not
check themselves.  ``x.idx`` has for each record, as three 64-bit numbers, the offset of its frame, its doc_id
and its number of ids (the smallest number stands for no doc_id): a reader can take the records in any order without scanning the shard.

All numbers are little-endian.  A file is written under a name of its attempt and renamed when whole, so a
task that is run again or twice leaves one good shard.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"LREC"
MASK_ADD = 0xA282EAD8
#: Distinct word-sized parts of texts whose ids a worker remembers.
REMEMBER = 800_000
#: Last of the places where parts leave a mark when they are first met.
_PLACES = (1 << 23) - 1
#: Bytes of text that are split and encoded at a time.
SLICE_BYTES = 1 << 20
NO_ID = -(1 << 63)
_INDEX = np.dtype([("offset", "<i8"), ("doc_id", "<i8"), ("n", "<i8")])
#: White space outside ASCII and the four separators that some regular expressions count as white space.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: Letters for sure, and punctuation for sure other than the apostrophe, which may begin a contraction.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: Parts of a text that no match of a byte-level splitter spans: letters, marks, or else anything up to white space.
_PART = re.compile(rf"\s*[{_LETTER}]++(?![^{_LETTER}{_MARK}\s])|\s*[{_MARK}]++(?![^{_LETTER}{_MARK}\s])|\s*\S+|\s+")
#: Characters of parts that go to the tokenizer in one text.
_JOINED = 2000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


class _Known(dict):
    """Ids of parts; notes the parts that are not in it."""

    def __init__(self):
        super().__init__()
        self.missed: list[str] = []

    def __missing__(self, part: str) -> None:
        self.missed.append(part)


class Encoder:
    """A byte-level tokenizer that remembers the ids of frequent parts of texts.

    Such a tokenizer first splits a text, and no split part spans a change between letters and punctuation, or
    from other characters to white space, so the ids of a text are those of its parts.  Only parts not met before
    go to the tokenizer, many in one text, whose ids are dealt back by the bytes each token stands for.  Parts met
    in a second slice are remembered, up to a bound; others are encoded each time.  Texts with unusual white space or with the
    string of a token that the tokenizer has of its own (such strings are that token, as the library has it), and all texts of a
    tokenizer with a normaliser, go to it whole.
    """

    def __init__(self, path: str, end_id: int, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.end = np.array([end_id], self.dtype).tobytes()
        self.known = _Known()
        self.met = bytearray(_PLACES + 1)
        self.remember = remember
        self.splits = self.tokenizer.normalizer is None and self._plain(self.tokenizer.pre_tokenizer)
        if self.splits:  # a byte-level token has one character for each of its bytes
            self.spelled = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(size)], np.int64)

    @staticmethod
    def _plain(splitter) -> bool:
        return type(splitter).__name__ == "ByteLevel" and not splitter.add_prefix_space and splitter.use_regex

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of distinct parts. Those that begin with white space and end otherwise can follow each other in a text."""
        follow = [p for p in parts if p[0].isspace() and not p[-1].isspace()]
        alone = [p for p in parts if not p[0].isspace() or p[-1].isspace()]
        out = dict(zip(alone, self._encode(alone), strict=True)) if alone else {}
        if follow:
            size = np.array([len(p.encode()) for p in follow], np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(size) // _JOINED)) + 1
            bounds = [0, *cut.tolist(), len(follow)]
            texts = ["".join(follow[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            ids = np.concatenate([np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.searchsorted(np.cumsum(self.spelled[ids]), np.cumsum(size)) + 1
            raw, at = ids.tobytes(), 0
            for part, to in zip(follow, (ends * self.width).tolist(), strict=True):
                out[part] = raw[at:to]
                at = to
        return out

    def payloads(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, with the end id."""
        known, found, missing = self.known, [], set()
        for text in texts:
            if not text or not self.splits or _UNUSUAL.search(text) or any(t in text for t in self.special):
                found.append((text or "", None, False))
                continue
            parts = _PART.findall(text)
            ids = list(map(known.__getitem__, parts))
            found.append((parts, ids, bool(known.missed)))
            if known.missed:
                missing.update(known.missed)
                known.missed = []
        fresh = self._encode_parts(list(missing)) if missing else {}
        out = []
        for parts, ids, gaps in found:
            if ids is None:
                out.append((self._encode([parts])[0] if parts else b"") + self.end)
            elif gaps:
                out.append(b"".join([fresh[p] if x is None else x for p, x in zip(parts, ids, strict=True)]) + self.end)
            else:
                out.append(b"".join(ids) + self.end)
        if len(known) < self.remember:
            for part, ids in fresh.items():
                place = hash(part) & _PLACES
                if self.met[place]:
                    known[part] = ids
                self.met[place] = 1
        return out


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """The worker's encoder: what it remembers serves all tasks that the worker runs."""
    return Encoder(path, end_id)


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder: local ones by themselves, others by their URI."""
    if folder.startswith("file:"):
        folder = re.sub(r"^file:/*", "/", folder)
    return (pafs.LocalFileSystem(), folder) if "://" not in folder else pafs.FileSystem.from_uri(folder)


def write_shard(folder: str, name: str, rows: Iterable[tuple[int, bytes]], width: int) -> tuple[int, int]:
    """Writes (doc_id, payload) rows as ``name.rec`` and ``name.idx``; returns the numbers of records and ids."""
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}.{uuid.uuid4().hex}"
    index, at, ids = [], 8, 0
    with fs.open_output_stream(f"{attempt}.rec", buffer_size=1 << 20) as out:
        out.write(MAGIC + struct.pack("<I", width))
        for doc_id, payload in rows:
            length = struct.pack("<Q", len(payload))
            out.write(b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)))))
            index.append((at, doc_id, len(payload) // width))
            at += len(payload) + 16
            ids += len(payload) // width
    with fs.open_output_stream(f"{attempt}.idx") as out:
        out.write(np.array(index, _INDEX).tobytes())
    fs.move(f"{attempt}.rec", f"{path}/{name}.rec")
    fs.move(f"{attempt}.idx", f"{path}/{name}.idx")
    return len(index), ids


def read_index(folder: str, name: str) -> np.ndarray:
    fs, path = _store(folder)
    with fs.open_input_file(f"{path}/{name}.idx") as file:
        return np.frombuffer(file.read(), _INDEX)


def read_shard(folder: str, name: str, order: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a shard's records: in file order by one forward scan, or in the given order by the index.

    Raises ValueError where a checksum, a length or the index does not fit.
    """
    fs, path = _store(folder)
    index = read_index(folder, name)
    with fs.open_input_file(f"{path}/{name}.rec") if order is not None else fs.open_input_stream(f"{path}/{name}.rec", buffer_size=1 << 20) as file:
        head = file.read(8)
        if head[:4] != MAGIC:
            raise ValueError(f"{name}: not a record file")
        width = struct.unpack("<I", head[4:])[0]
        for k in range(len(index)) if order is None else order:
            if order is not None:
                file.seek(int(index[k]["offset"]))
            head = file.read(12)
            length, check = struct.unpack("<QI", head)
            if masked(head[:8]) != check or length != index[k]["n"] * width:
                raise ValueError(f"{name}: record {k} has a damaged length")
            payload = file.read(length)
            if masked(payload) != struct.unpack("<I", file.read(4))[0]:
                raise ValueError(f"{name}: record {k} is damaged")
            yield int(index[k]["doc_id"]), np.frombuffer(payload, f"<u{width}")
        if order is None and file.read(1):
            raise ValueError(f"{name}: bytes after the last record")


def write_records(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes every text's ids, with the end id, in ascending doc_id order; returns the shards.

    (shard, n_docs, n_tokens, start): one row a file, with the number of ids in all files before.  Shards follow
    the order of doc_id and hold whole documents; equal doc_ids keep an order by text.  Null texts count as
    empty and leave the end id alone.  Rows without doc_id come first.  Very long texts are one record each.  Columns other
    than doc_id and text are not written; an empty table writes no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    rows = rows.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def step(batches):
        own = encoder(path, end_id)
        name = f"shard-{TaskContext.get().partitionId():06d}"

        def encoded():
            for batch in common.pieces(batches, "text", SLICE_BYTES):
                yield from zip(batch.column("doc_id").to_pylist(), own.payloads(batch.column("text").to_pylist()), strict=True)

        source = encoded()
        first = next(source, None)
        if first is None:
            return

        def every():
            yield first
            yield from source

        n_docs, n_ids = write_shard(folder, name, every(), own.width)
        yield common.batch_of(shard=[name], n_docs=pa.array([n_docs], pa.int64()), n_tokens=pa.array([n_ids], pa.int64()))

    shards = common.arrow_map(rows, step, "shard string, n_docs long, n_tokens long").collect()  # runs once; one row a file
    total, placed = 0, []
    for r in sorted(shards, key=lambda r: r["shard"]):
        placed.append((r["shard"], r["n_docs"], r["n_tokens"], total))
        total += r["n_tokens"]
    return spark.createDataFrame(placed, "shard string, n_docs long, n_tokens long, start long")


def read_records(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record: read back from the files, one task for some shards.

    ids_crc32 is the CRC-32 of the ids as little-endian 32-bit numbers.  shards: as ``write_records`` returned them, in any
    order; one that is named twice is read twice, and no shards give no rows.  Records without doc_id have a null one; those of
    null or empty texts hold the end id alone; a record as long as its text was is read whole.  A damaged file is an error.
    """

    def step(batches):
        for batch in batches:
            for name, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                out = []
                for doc_id, ids in read_shard(folder, name):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                doc, at, n, crc = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
                doc = pc.if_else(pc.equal(doc, NO_ID), pa.scalar(None, pa.int64()), doc)
                yield common.batch_of(doc_id=doc, start=at, n_tokens=n, ids_crc32=crc)

    spread = shards.repartition(common.partitions(shards.sparkSession), "shard")
    return common.arrow_map(spread.select("shard", "start"), step, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    """A folder of its own for one run, in the shared folder."""
    return f"{common.shared_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
