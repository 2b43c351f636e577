"""SimHash near-duplicates, found by anchor-point covering (operator 5).

A fingerprint has 64 bits.  Two fingerprints within the threshold of 2 differ in at most 1 bit in one of
their two 32-bit halves.  On 31 bits of each half the anchors are the codewords of the perfect Hamming code
[31, 26]: they cover all 31-bit words with radius 1, each word having exactly one anchor, its *home*.  A word
at distance 1 or less from another is within 1 + 1 = 2 of the other's home, so each fingerprint goes to all
anchors within 2 of it in each half (16, or 1 if it is a codeword) and is compared there with those at home.
All links are found; with 2**26 anchors a half, few others meet.

Equal fingerprints are one before that, so copies cost one comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, rolling
from .components import components

SHINGLE = 3
THRESHOLD = 2
SEED = 42

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("A") : ord("Z") + 1] += 32
#: Of each byte value, its eight bits as counts of one.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _fingerprint(text: bytes, end: np.ndarray, shingle: int) -> int:
    """The fingerprint of a text of words joined by one space; end: where each word ends."""
    if not len(end):
        return 0
    begin = np.concatenate(([0], end[:-1] + 1))
    k = min(shingle, len(end))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], SEED) for a, b in zip(begin[: len(begin) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64)
    each = h.view(np.uint8).reshape(-1, 8)
    count = np.concatenate([np.bincount(each[:, k], minlength=256) @ _BITS for k in range(8)])
    return sum(1 << k for k in np.flatnonzero(2 * count > len(h)).tolist())


def _fingerprints(shingle: int, carried: str, field: str | None = None):
    """Adds ``fp`` to the carried column; texts stand in column ``text``, or in a field of the carried one."""
    column = "text" if field is None else carried

    def step(batches):
        for batch in common.pieces(batches, column, field=field):
            words = rolling.Words(common.child(batch, column, field))
            words.data = _UPPER[words.data]
            data, at = words.kept(np.ones(len(words.start), bool))
            size = words.end - words.start
            out = []
            for k in range(batch.num_rows):
                own = slice(words.first[k], words.first[k + 1])
                end = np.cumsum(size[own] + 1) - 1
                out.append(_fingerprint(data[at[k] : at[k + 1]].tobytes(), end, shingle))
            yield common.batch_of(**{carried: batch.column(carried)}, fp=np.array(out, np.uint64).view(np.int64))

    return step


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of the lower-cased (A-Z) words' shingles, repeats included.

    Fewer words than a shingle: the whole sequence is one; none (null, empty or blank text): zero.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.arrow_map(slim, _fingerprints(shingle, "doc_id"), "doc_id long, fp long")


def _syndrome(word: Column) -> Column:
    """The exclusive or of the positions (1 to 31) of the set bits: 0 for codewords, else the bit to flip."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << p for p in range(1, 32) if p >> k & 1)
        out = out + F.shiftleft((F.bit_count(word.bitwiseAND(F.lit(mask))) % 2).cast("int"), k)
    return out


def _flip(word: Column, position: Column) -> Column:
    """The word with the bit of that position flipped; position 0 stands for none."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), position)
    return word.bitwiseXOR(F.when(position == 0, F.lit(0).cast("long")).otherwise(bit))


def _halves(reps: DataFrame) -> DataFrame:
    """(fp, half, word, s): the 31 covered bits of each half at positions 1 to 31, and their syndrome."""
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("fp").alias("x")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("x")))
    out = reps.select("fp", F.explode(halves).alias("e")).select("fp", "e.half", F.col("e.x").bitwiseAND(F.lit(0xFFFFFFFE)).alias("word"))
    return out.withColumn("s", _syndrome(F.col("word")))


def close_pairs(reps: DataFrame) -> DataFrame:
    """(u, v): all pairs u < v of distinct fingerprints ``fp`` with at most two differing bits, each once."""
    words = _halves(reps)
    homes = words.select(F.col("fp").alias("u"), "half", _flip(F.col("word"), F.col("s")).alias("anchor"))
    # within 2 of a word with syndrome s: the word with bits i and i ^ s flipped (bit 0: none), for each such pair
    partner = F.when(F.col("s") == 0, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i < i.bitwiseXOR(F.col("s"))))
    near = words.select(F.col("fp").alias("v"), "half", "word", "s", F.explode(partner).alias("i"))
    near = near.select("v", "half", _flip(_flip(F.col("word"), F.col("i")), F.col("i").bitwiseXOR(F.col("s"))).alias("anchor"))
    met = homes.join(near, ["half", "anchor"]).where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _groups(reps: DataFrame) -> DataFrame:
    """The fingerprints with ``c``, the smallest (signed) fingerprint that each is linked with."""
    parts = components(close_pairs(reps), reps.count())
    return reps.join(parts, reps["fp"] == parts["node"], "left").withColumn("c", F.coalesce("component", "fp")).drop("node", "component")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id each document is linked with, itself included.

    Documents link if their fingerprints differ in at most two bits; a text without words (null, empty, blank) has the
    fingerprint zero and links like any other.  Very long texts are fingerprinted whole.  Repeated rows are documents like
    others, and so are rows without doc_id, which link what they are near to; a component without any id is null.  Other
    columns, whatever their names, play no part; an empty table gives no rows.
    """
    prints = common.durable(fingerprints(docs, shingle))
    reps = common.durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), prints.count())
    named = _groups(reps)
    label = named.join(named.groupBy("c").agg(F.min("rep").alias("component_id")), "c")
    label = label.select("fp", "component_id", common.hot_share(reps, "copies", common.partitions(docs.sparkSession)).alias("hot"))
    label = common.durable(label, reps.count())
    return common.join_by_key(prints, label, "fp", "hot").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each component the row with the smallest doc_id.

    A row is itself, whatever its id: of repeated rows with the smallest id one stays; a component without any id keeps
    one row.
    """
    rows = docs.select(F.struct("*").alias("row"))
    schema = rows.withColumn("fp", F.lit(None).cast("long")).schema
    rows = common.arrow_map(rows, _fingerprints(shingle, "row", common.own_name(docs, "text")), schema)
    rows = common.durable(rows.withColumn("at", F.monotonically_increasing_id()))
    doc_id = F.col("row")[common.own_name(docs, "doc_id")].cast("long")
    first = F.min(F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.col("at").alias("at"))).alias("first")
    reps = common.durable(rows.groupBy("fp").agg(first), rows.count())
    stays = _groups(reps).groupBy("c").agg(F.min("first").alias("first")).select(F.col("first.at").alias("at"))
    return rows.join(stays, "at", "left_semi").select("row.*")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
