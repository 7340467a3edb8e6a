"""Runs: the stretches of frames an object stays in a region; unions and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.points import select_points
from ..schema import Query


def runs(points: DataFrame, duration: int = 1) -> DataFrame:
    """oid, cls, b, e: maximal frames [b, e) of consecutive points, `duration` long at least.

    Points that repeat an object's frame count once.  One shuffle, by object: the islands are
    found and closed under the same partitioning.
    """
    seen = points.groupBy("oid", "fid").agg(F.min("cls").alias("cls"))
    island = F.col("fid") - F.row_number().over(W.partitionBy("oid").orderBy("fid"))
    out = seen.withColumn("island", island).groupBy("oid", "island").agg(F.min("cls").alias("cls"), F.min("fid").alias("b"), (F.max("fid") + 1).alias("e"))
    return out.where(F.col("e") - F.col("b") >= duration).select("oid", "cls", "b", "e")


def query_runs(points: DataFrame, query: Query) -> DataFrame:
    """The runs that a query is answered from."""
    return runs(select_points(points, query.labels, query.region, query.interval), query.duration)


def union_intervals(pieces: DataFrame, duration: int = 1, keys: tuple[str, ...] = ("oid", "cls")) -> DataFrame:
    """Pieces [b, e) of the same keys that overlap or touch, as one; `duration` long at least."""
    if duration < 1:
        raise ValueError("duration must be positive")
    some = pieces.where("e > b")
    order = W.partitionBy(*keys).orderBy("b", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = some.withColumn("fresh", (reach.isNull() | (F.col("b") > reach)).cast("int"))
    group = F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))
    out = marked.withColumn("g", group).groupBy(*keys, "g").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("g")
    return out.where(F.col("e") - F.col("b") >= duration)


def clip(pieces: DataFrame, lo: int, hi: int) -> DataFrame:
    """Pieces cut to [lo, hi); what is empty then is left out."""
    return pieces.withColumn("b", F.greatest("b", F.lit(lo))).withColumn("e", F.least("e", F.lit(hi))).where("e > b")


def overlapping(pieces: DataFrame, lo: int, hi: int) -> DataFrame:
    """Pieces that share a frame with [lo, hi)."""
    return pieces.where((F.col("b") < hi) & (F.col("e") > lo))


def by_length(pieces: DataFrame) -> DataFrame:
    """Pieces with their length, sorted into groups of equal length (`len`)."""
    return pieces.withColumn("len", F.col("e") - F.col("b"))


def window_pieces(pieces: DataFrame, stride: int) -> DataFrame:
    """Pieces cut at every multiple of `stride`; `cut` marks those that go on in the next window."""
    w = F.explode(F.sequence(F.floor(F.col("b") / stride), F.floor((F.col("e") - 1) / stride)))
    out = pieces.select("*", w.alias("w"))
    b, e = F.greatest(F.col("b"), F.col("w") * stride).cast("int"), F.least(F.col("e"), (F.col("w") + 1) * stride).cast("int")
    return out.withColumns({"cut": F.col("e") > (F.col("w") + 1) * stride, "b": b, "e": e}).withColumn("w", F.col("w").cast("int"))
