"""Track construction: boxes to points, interpolation, class revision, merging of parts."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.points import every_kth, unused


def center_points(detections: DataFrame, center: bool = True) -> DataFrame:
    """Box centres, or the middle of the lower edge."""
    y = F.floor((F.col("y1") + F.col("y2")) / 2).cast("int") if center else F.col("y2").cast("int")
    return detections.select("oid", "cls", "fid", F.floor((F.col("x1") + F.col("x2")) / 2).cast("int").alias("x"), y.alias("y"))


def class_modes(points: DataFrame) -> DataFrame:
    """oid, cls: each object's most frequent class, ties to the least."""
    counts = points.groupBy("oid", "cls").agg(F.count("*").alias("n"))
    return counts.groupBy("oid").agg(F.min_by("cls", F.struct(-F.col("n"), F.col("cls"))).alias("cls"))


def without_single_points(points: DataFrame) -> DataFrame:
    """Objects that are seen once only are left out."""
    seen = points.groupBy("oid").agg(F.count("*").alias("n")).where("n > 1").select("oid")
    return points.join(seen, "oid", "left_semi").select(*points.columns)


def interpolate(points: DataFrame) -> DataFrame:
    """A point at every frame between an object's first and last, linear between its own, truncated.

    Classes become the object's mode; objects seen once are left out; of several points at one
    frame the one with the least (x, y) counts.  Each point fills the gap up to the next one, so
    the frames in between need no join and no gap is ever in one task with another.
    """
    once = points.groupBy("oid", "fid").agg(F.min(F.struct("x", "y")).alias("p"))
    track = W.partitionBy("oid").orderBy("fid")
    ahead = once.select("oid", "fid", "p", F.lead("fid").over(track).alias("f2"), F.lead("p").over(track).alias("q"), F.lag("fid").over(track).alias("f0"))
    many = ahead.where("f2 is not null or f0 is not null")
    filled = many.select("oid", "fid", "p", "f2", "q", F.explode(F.sequence("fid", F.coalesce(F.col("f2") - 1, F.col("fid")))).alias("at"))

    def between(c: str):
        a, b = F.col("p")[c], F.col("q")[c]
        slope = (b - a).cast("double") / (F.col("f2") - F.col("fid"))
        return F.when(F.col("at") == F.col("fid"), a).otherwise((slope * (F.col("at") - F.col("fid")) + a).cast("int")).cast("int").alias(c)

    dense = filled.select("oid", F.col("at").cast("int").alias("fid"), between("x"), between("y"))
    return dense.join(class_modes(points), "oid").select("oid", "cls", "fid", "x", "y")


def part_order(names: Iterable[str]) -> list[str]:
    """Parts by name, the first one last: recordings begin with a part that was saved after the others."""
    first, *others = sorted(names)
    return [*others, first]


def merge_parts(parts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Parts of one data set (column `part`) as one table, with ids that do not collide.

    Each part's ids are moved past the greatest ids of all the parts before it, by the order given
    or by name; they become long, as those of many parts add up.
    """
    tops = parts.groupBy("part").agg(F.max("oid").alias("top"))
    place = F.array_position(F.lit(order), F.col("part")) if order else F.lit(0)
    before = W.orderBy(place, "part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    move = unused(parts, "move")
    moves = tops.select("part", F.coalesce(F.sum(F.col("top").cast("long") + 1).over(before), F.lit(0)).alias(move))
    return parts.join(F.broadcast(moves), "part").withColumn("oid", F.col("oid") + F.col(move)).drop(move, "part")


def tracks(points: DataFrame, classes: list[int] | None = None, stride: int = 1, scale: float = 1) -> DataFrame:
    """oid, cls, start and the track's points in order."""
    rows = points if classes is None else points.where(F.col("cls").isin(classes))
    rows = every_kth(rows, stride) if stride > 1 else rows
    pts = F.transform(F.sort_array(F.collect_list(F.struct("fid", "x", "y"))), lambda p: F.struct((p["x"] * scale).alias("x"), (p["y"] * scale).alias("y")))
    return rows.groupBy("oid").agg(F.min("cls").alias("cls"), F.min("fid").alias("start"), pts.alias("points"))


def view_field(points: DataFrame) -> DataFrame:
    """x0, x1, y0, y1 of all points."""
    return points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def grid_borders(region: tuple[int, int, int, int], cells: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Cell borders along x and y: evenly spaced whole numbers, and one past the last."""
    out = []
    for lo, hi, n in ((region[0], region[1], cells[0]), (region[2], region[3], cells[1])):
        b = np.linspace(lo, hi, n + 1).astype(int).tolist()
        out.append([*b[:-1], b[-1] + 1])
    return out[0], out[1]
