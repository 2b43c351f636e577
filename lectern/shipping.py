"""Makes this package importable where Python functions run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Sends the package's sources to the executors of the session's context, once.

    Functions of Python steps are pickled by name, so workers import them; a worker need not share the driver's
    path or working folder.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_lectern_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lectern-")), "lectern.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(home)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._lectern_shipped = True
