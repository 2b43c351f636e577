"""Session, storage and record-batch helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shipping import ship

#: Bytes of text that one vectorised step handles at a time.
SLICE_BYTES = 2 << 20

#: Bytes of a batch between Spark and Python, for sessions that do not say.
BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

# Workers serve one stage after the other; Arrow's own pools would keep what the largest batch took.
pa.set_memory_pool(pa.system_memory_pool())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session in local mode; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Rows of a few numbers that one file of a checkpoint holds at least, where their count is known.
FILE_ROWS = 200_000


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder: later readers neither recompute it nor lose it.

    rows: about how many there are, of a few numbers each; few rows then go to few files, however many partitions they come from.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if rows is not None:
        files = -(-rows // FILE_ROWS)
        df = df.coalesce(max(1, files)) if files < partitions(spark) else df
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """The column as one array of ``kind``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if column.type == kind else column.cast(kind)


def child(batch: pa.RecordBatch, column: str, field: str | None = None) -> pa.Array:
    """A column of the batch, or the field of a column of structs."""
    array = batch.column(column)
    return array if field is None else pc.struct_field(array, field)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, field: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with about ``limit`` bytes of ``column`` (or its ``field``); a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(child(batch, column, field)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def arrow_map(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, with batches of a bounded size: a row may be a very long document."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    ship(df.sparkSession)
    return df.mapInArrow(step, schema)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the table has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_name(df: DataFrame, name: str) -> str:
    """The column's name as the table spells it."""
    return next(c for c in df.columns if c.lower() == name.lower())


def hot_share(counted: DataFrame, count: str, n: int) -> Column:
    """Whether a key has so many rows that its share would stand out among ``n`` tasks: true for 4 n keys at most."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    return F.col(count) * (4 * n) >= F.lit(max(total, 1))


def join_by_key(rows: DataFrame, named: DataFrame, key: str, hot: str) -> DataFrame:
    """``rows`` joined with ``named`` (one row a key, each key of rows among them), of which column ``hot`` marks frequent keys.

    Rows with a frequent key, however many, stay where they are: of those keys there are few, and their names are broadcast.
    Only the others are shuffled.
    """
    few, rest = named.where(hot).drop(hot), named.where(f"NOT {hot}").drop(hot)
    near = rows.join(F.broadcast(few), key)
    far = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key)
    return near.unionByName(far)


def batch_of(**columns) -> pa.RecordBatch:
    """A record batch of numpy arrays, Arrow arrays or lists."""
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
