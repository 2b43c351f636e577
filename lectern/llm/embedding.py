"""Near-duplicate vectors by randomised-rotation binary codes (operator 3).

A unit vector o is rotated at random, taken into a space of more coordinates by random orthonormal columns P, and coded
by the signs x of what it has there, a corner of the cube scaled to length 1; f = <x, Po> is stored with the code.  For
another unit vector q, <x, Pq> / f is an unbiased estimate of <o, q>: the rest is the product of x with a random direction
at right angles to o.  With r the length of x's shadow on P's columns beside o, the error is at most r / f, and stays under
e * r / (f * sqrt(d - 1))  but for a chance that falls as exp(-e*e/2).  The other side of the estimate is stored with four
bits a coordinate, rounded after a fixed random shift, so that it is unbiased too, and with the length of what rounding
left out.  Pairs whose bound, from either side, stays under the threshold need no exact product; all others are computed
from the vectors in double precision, so no link below the threshold is ever reported.

Each distinct vector is coded once.  Which pairs meet: bits of further rotations form the keys of several tables, and
vectors with the same label that share a key in any table are compared, by their codes alone.  The number of bits
follows the number of vectors, so that codes of one key fit in a task; the number of tables follows the wanted recall at the threshold.
A pair that shares several keys counts in the first table only.  Vectors are only fetched for members of a bucket that have
a pair the bounds leave open; a bucket of very many is cut into tiles.  A bucket reports counts and a spanning forest of its
links, never all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

THRESHOLD = 0.93
#: Wanted share of the pairs at the threshold that meet in a table.
RECALL = 0.9995
#: Codes with one key, in the mean, and at most in a tile; least bits of a key.
BUCKET, TILE, LEAST_BITS = 2048, 8192, 4
#: Confidence e of the estimate's error bound.
CONFIDENCE = 4.5
#: Least bits of a code, and bits for each coordinate.
CODE_BITS, CODE_FACTOR = 128, 2
#: Values of a coordinate in four bits, and rows of a tile that are estimated at a time.
LEVELS, BLOCK = 15, 256

_CELL = ["label", "dim", "tab", "key", "ti", "tj"]
_CODED = "label long, dim int, digest binary, rep long, mult long, data binary, code binary, keys array<int>"


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=16)
def _frame(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The orthonormal columns P, and the shift of each coordinate before rounding."""
    rng = np.random.default_rng([1 << 20, dim])
    wide = -(-max(CODE_BITS, CODE_FACTOR * dim) // 8) * 8
    return np.linalg.qr(rng.standard_normal((wide, dim)))[0], rng.random(dim)


def tables_for(count: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a key for that many vectors, and tables so that a pair at the threshold shares a key with that chance."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, count) / BUCKET)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of numbers as binary values."""
    raw = np.ascontiguousarray(rows)
    size = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Binary values of one size as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _keyed(dtype: str):
    """Valid vectors as raw numbers, with a digest of label and numbers; the rest with null."""

    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            vectors, label = batch.column("embedding"), batch.column("label")
            size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten()
            values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(dtype)
            first = np.concatenate(([0], np.cumsum(size)))
            owner = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(owner[~np.isfinite(values)], minlength=len(size)) > 0
            some = np.bincount(owner[values != 0], minlength=len(size)) > 0
            good = some & ~bad & label.is_valid().to_numpy(zero_copy_only=False)
            out = [(np.flatnonzero(~good), None)]
            out += [(np.flatnonzero(good & (size == dim)), int(dim)) for dim in np.unique(size[good])]
            for rows, dim in out:
                if not len(rows):
                    continue
                own, n = batch.take(pa.array(rows)), len(rows)
                if dim is None:
                    digest, data = pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())
                else:
                    matrix = values[first[rows][:, None] + np.arange(dim)] + values.dtype.type(0)  # the sum makes zeros positive
                    data = _binary(matrix)
                    names = own.column("label").to_numpy(zero_copy_only=False).astype("<i8")
                    digest = pa.array([hashlib.blake2b(m.tobytes(), digest_size=16, key=k.tobytes()).digest() for m, k in zip(matrix, names, strict=True)], pa.binary())
                yield common.batch_of(vec_id=own.column("vec_id"), label=own.column("label"), dim=pa.repeat(pa.scalar(dim, pa.int32()), n), digest=digest, data=data)

    return step


def _units(data: pa.Array, dtype: str) -> np.ndarray:
    """Unit vectors in double precision."""
    x = _matrix(data, dtype).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each vector in each table."""
    dim = x.shape[1]
    signs = np.concatenate([x @ rotation(dim, k + 1) > 0 for k in range(-(-bits * tables // dim))], axis=1)[:, : bits * tables]
    return (signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits))).astype(np.int32)


def encode(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The stored codes of unit vectors, a row of bytes each: f, the largest coordinate and the rounding's rest, signs, levels, keys."""
    y = x @ rotation(x.shape[1], 0)
    frame, shift = _frame(x.shape[1])
    z = y @ frame.T
    f = np.abs(z).sum(axis=1) / math.sqrt(z.shape[1])
    top = np.abs(y).max(axis=1)
    step = 2 * top / LEVELS
    level = np.clip(np.floor((y + top[:, None]) / step[:, None] + shift), 0, LEVELS).astype(np.uint8)
    rest = np.linalg.norm(y - _levels(level, top, shift), axis=1)
    level = np.pad(level, ((0, 0), (0, level.shape[1] % 2)))
    head = np.stack((f, top, rest), axis=1).astype("<f4")
    return np.concatenate((head.view(np.uint8), np.packbits(z > 0, axis=1), level[:, ::2] << 4 | level[:, 1::2], keys.astype("<i4").view(np.uint8)), axis=1)


def _levels(level: np.ndarray, top: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The coordinates that levels stand for: the middle of what was rounded to them."""
    return (level - shift + 0.5) * (2 * top / LEVELS)[:, None] - top[:, None]


class Codes:
    """Stored codes, read for estimates between their vectors."""

    def __init__(self, rows: np.ndarray, dim: int, tables: int):
        frame, shift = _frame(dim)
        wide = len(frame)
        head = np.ascontiguousarray(rows[:, :12]).view("<f4").astype(np.float64)
        f, top, rest = head.T
        at = 12 + wide // 8
        signs = np.unpackbits(np.ascontiguousarray(rows[:, 12:at]), axis=1).astype(np.float32) * 2 - 1
        packed = rows[:, at : at + -(-dim // 2)]
        level = np.stack((packed >> 4, packed & 15), axis=2).reshape(len(rows), -1)[:, :dim]
        #: x's shadow on P's columns over f; the rounded vector; bounds of the estimate's and the rounding's errors.
        self.shadow = ((signs / np.float32(math.sqrt(wide))) @ frame.astype(np.float32)) / f[:, None].astype(np.float32)
        self.rounded = _levels(level, top, shift).astype(np.float32)
        length = np.linalg.norm(self.shadow.astype(np.float64), axis=1)
        beside = np.sqrt(np.maximum(length**2 - 1, 0))
        self.slack = (beside * min(1.0, CONFIDENCE / math.sqrt(max(dim - 1, 1))) + 1e-4).astype(np.float32)
        self.length = length.astype(np.float32)
        self.rest = (rest * min(1.0, CONFIDENCE / math.sqrt(dim))).astype(np.float32)
        self.keys = np.ascontiguousarray(rows[:, at + -(-dim // 2) :]).view("<i4")[:, :tables]

    def estimate(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The estimates of all pairs by the codes of i."""
        return self.shadow[i] @ self.rounded[j].T

    def open(self, left: np.ndarray, right: np.ndarray, tab: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (of left, of right; i < j where the sets are one) that the bounds leave open, and that share no key before ``tab``."""
        for k in range(0, len(left), BLOCK):
            i = left[k : k + BLOCK]
            j = right[k:] if left is right else right
            may = self.estimate(i, j) + self.slack[i, None] + self.length[i, None] * self.rest[j] >= threshold
            a, b = np.nonzero(np.triu(may, 1) if left is right else may)
            i, j = i[a], j[b]
            back = np.einsum("ij,ij->i", self.shadow[j], self.rounded[i]) + self.slack[j] + self.length[j] * self.rest[i] >= threshold
            i, j = i[back], j[back]
            fresh = ~(self.keys[i, :tab] == self.keys[j, :tab]).any(axis=1)
            yield i[fresh], j[fresh]


def _coded(bits: int, tables: int, dtype: str):
    """Adds to each distinct vector its code and its keys."""

    def step(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for at in range(0, own.num_rows, 4096):
                    part = own.slice(at, 4096)
                    x = _units(part.column("data"), dtype)
                    keys = _keys(x, bits, tables)
                    lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * tables, pa.array(keys.ravel(), pa.int32()))
                    yield common.batch_of(**{c: part.column(c) for c in ("label", "dim", "digest", "rep", "mult", "data")}, code=_binary(encode(x, keys)), keys=lists)

    return step


def _by_cell(group: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A step that hands the rows of each cell, which come sorted by cell, to ``group``."""

    def step(batches):
        held: pa.Table | None = None

        def cut(rows: pa.Table, last: bool):
            nonlocal held
            rows = rows.combine_chunks()
            keys = [rows.column(c).to_numpy() for c in _CELL]
            new = np.ones(len(rows), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            bounds = [*np.flatnonzero(new).tolist(), len(rows)]
            ends = bounds if last else bounds[:-1]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if b - a > 1:
                    yield from group(rows.slice(a, b - a).combine_chunks().to_batches()[0])
            held = None if last else rows.slice(ends[-1])

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                yield from cut(rows if held is None else pa.concat_tables([held, rows]), False)
        if held is not None and len(held):
            yield from cut(held, True)

    return step


def _sides(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the cell's two tiles; one array for both where the tiles are one."""
    chunk = rows.column("chunk").to_numpy()
    ti, tj = (rows.column(c)[0].as_py() for c in ("ti", "tj"))
    left = np.flatnonzero(chunk == ti)
    return left, left if ti == tj else np.flatnonzero(chunk == tj)


def _codes_of(rows: pa.RecordBatch, tables: int) -> Codes:
    return Codes(_matrix(rows.column("code"), "u1"), rows.column("dim")[0].as_py(), tables)


def _opened(threshold: float, tables: int):
    """Of each cell the members that have a pair which the codes leave open."""

    def group(rows: pa.RecordBatch):
        found = np.zeros(rows.num_rows, bool)
        for i, j in _codes_of(rows, tables).open(*_sides(rows), rows.column("tab")[0].as_py(), threshold):
            found[i] = found[j] = True
        if found.any():
            yield rows.filter(pa.array(found)).select([*_CELL, "chunk", "at"])

    return _by_cell(group)


def _compared(threshold: float, tables: int, dtype: str):
    """Of each cell the links: counts of each member, and to each member a smaller one of its component (u, v, n)."""

    def group(rows: pa.RecordBatch):
        at, mult = (rows.column(c).to_numpy() for c in ("at", "mult"))
        x = _units(rows.column("data"), dtype)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in _codes_of(rows, tables).open(*_sides(rows), rows.column("tab")[0].as_py(), threshold):
            for k in range(0, len(i), 65536):
                a, b = i[k : k + 65536], j[k : k + 65536]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                ends.append((a[near], b[near]))
        i, j = (np.concatenate([e[s] for e in ends]) if ends else np.empty(0, int) for s in (0, 1))
        if not len(i):
            return
        links = np.bincount(i, mult[j], len(x)) + np.bincount(j, mult[i], len(x))
        root = _forest(len(x), i, j)
        some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
        yield common.batch_of(
            u=np.concatenate((at[some], at[moved])), v=pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(at[root[moved]], pa.int64())]),
            n=np.concatenate((links[some], np.zeros(len(moved)))).astype(np.int64),
        )

    return _by_cell(group)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n vertices the smallest in its component, by hooking and halving."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiled(dealt: DataFrame, cell: list[str]) -> DataFrame:
    """The rows with the pairs of tiles that they take part in; nearly all cells are one tile."""
    large = dealt.groupBy(*cell).count().where(F.col("count") > TILE).select(*cell, F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("tiles"))
    tiled = dealt.join(large, cell, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("chunk", F.pmod(F.xxhash64("at"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return tiled.withColumn("ti", F.least("chunk", "other")).withColumn("tj", F.greatest("chunk", "other")).drop("tiles", "other")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row a vector.

    vectors: (vec_id, embedding, label).  Two vectors link if their labels are equal and not null, they have as
    many coordinates, and their cosine in double precision is at least ``threshold``.  Null, empty and zero vectors,
    and those with null or non-finite components, link with nothing and stay.  n_links counts the other vectors
    linked directly, repeated rows included; component_id is the smallest vec_id reachable by links; kept marks
    the vector whose id that is.  Rows without vec_id are left out of links but keep a row with null ids.  Very long vectors
    are coded and compared whole.  Other columns, whatever their names, play no part; an empty table gives no rows.
    """
    n = common.partitions(vectors.sparkSession)
    dtype = "<f4" if dict(vectors.dtypes)[common.own_name(vectors, "embedding")] == "array<float>" else "<f8"
    vec_id = F.col("vec_id").cast("long")
    slim = vectors.select(vec_id.alias("vec_id"), F.col("embedding").alias("embedding"), F.when(vec_id.isNotNull(), F.col("label").cast("long")).alias("label"))
    rows = common.arrow_map(slim, _keyed(dtype), "vec_id long, label long, dim int, digest binary, data binary")
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    most = slim.where("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0]
    if not most:
        return alone
    bits, tables = tables_for(most, threshold, recall)
    reps = rows.where("digest IS NOT NULL").groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("data").alias("data"))
    store = common.durable(common.arrow_map(reps.select("label", "dim", "digest", "rep", "mult", "data"), _coded(bits, tables, dtype), _CODED).withColumn("at", F.monotonically_increasing_id()))
    dealt = store.select("label", "dim", "at", "code", F.posexplode("keys").alias("tab", "key"))
    tiled = _tiled(dealt, ["label", "dim", "tab", "key"]).select(*_CELL, "chunk", "at", "code")
    tiled = tiled.repartition(n, *_CELL).sortWithinPartitions(*_CELL)
    opened = common.arrow_map(tiled, _opened(threshold, tables), "label long, dim int, tab int, key int, ti int, tj int, chunk int, at long")
    fetched = opened.join(store.select("at", "mult", "data", "code"), "at").select(*_CELL, "chunk", "at", "mult", "data", "code")
    fetched = fetched.repartition(n, *_CELL).sortWithinPartitions(*_CELL, "at")
    found = common.durable(common.arrow_map(fetched, _compared(threshold, tables, dtype), "u long, v long, n long"))
    links = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
    total = store.count()
    parts = components(found.where("v IS NOT NULL").select("u", "v"), total)
    named = store.select("digest", "at", "rep", "mult").join(links, F.col("at") == F.col("u"), "left").join(parts, F.col("at") == F.col("node"), "left")
    named = named.select("digest", "rep", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "at").alias("c"))
    named = named.join(named.groupBy("c").agg(F.min("rep").alias("component_id")), "c")
    named = common.durable(named.select("digest", "n_links", "component_id", common.hot_share(store, "mult", n).alias("hot")), total)
    out = common.join_by_key(rows.where("digest IS NOT NULL").select("vec_id", "digest"), named, "digest", "hot")
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)
