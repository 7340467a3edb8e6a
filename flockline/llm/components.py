"""Connected components of an edge table, distributed: alternating large and small stars.

Each round rewrites the edges so that every node points nearer to the least node of its component;
the rounds grow with the logarithm of the longest path.  Lineage is cut by a checkpoint a round, so
a lost executor costs one round.  Minima are pre-aggregated before they are shuffled, and no
component is ever gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    down = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a but the least of its component b; edges: (a, b), any direction.

    Nulls, loops and repeats among the edges are harmless; no edges give an empty result.  Rounds go
    on until one changes nothing, seen by the number of edges and the whole sum of their 64-bit hashes.
    """
    e = cut(_directed(edges.dropna(subset=["a", "b"])))
    before, now = None, ()
    while now != before:
        e = cut(_small_star(_large_star(e)))
        before, now = now, e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return e
