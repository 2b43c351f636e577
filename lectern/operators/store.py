"""Tables that several branches of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def once(rows: DataFrame) -> DataFrame:
    """``rows``, computed now and written to the folder that all executors share (``spark.checkpoint.dir``).

    For rows that cost much more to compute than to read, and that a ranking reads twice: for the sums of its slices and for
    the rows themselves.  In local mode without such a folder a temporary one serves; on a cluster that is an error.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return rows.checkpoint(eager=True)
