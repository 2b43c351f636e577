"""Connected components of an edge table, without gathering edges on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, about: int | None = None) -> DataFrame:
    """(node, component): for every node of the edges (u, v), the smallest node it is connected with.

    about: how many edges there may be, so that few go to few files.

    Alternates large-star and small-star steps: each links the neighbours of a node to the smallest of them,
    until every component is a star around its smallest node.  The number of rounds grows with the logarithm
    of a component's size.  Minima are combined before every shuffle, and a node with very many neighbours
    only meets a join that Spark can split.  Each round is written to the shared folder; the driver sees two
    numbers a round.  Null ends and loops are left out.
    """
    pairs = common.durable(_down(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))), about)
    seen = None
    while True:  # each round that changes something brings a node nearer to the smallest of its component
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (now["n"], now["h"]) == seen or not now["n"]:
            break
        seen = (now["n"], now["h"])
        pairs = common.durable(_small_star(_large_star(pairs)), now["n"])
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _down(pairs: DataFrame) -> DataFrame:
    """Every pair once, from the larger to the smaller end."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    pairs = _down(pairs)
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return _down(pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))
