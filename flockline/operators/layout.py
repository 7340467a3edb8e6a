"""Grids, cells and layout statistics: what a spatial index over tracks is made of."""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import Region

#: By number of objects of a class, the step of its life quantiles.
LIFE_STEPS = ((0, 0.5), (5_000, 0.2), (50_000, 0.05))
TEMPO_STRIDE = 60


def cell_axis(value: Column, borders: list[int]) -> Column:
    """The cell along one axis: how many borders are at or below the value, less one."""
    out = F.lit(-1)
    for b in borders:
        out = out + (value >= b).cast("int")
    return out


def with_cells(points: DataFrame, borders: tuple[list[int], list[int]]) -> DataFrame:
    """points with cx, cy and cell, of any borders.  Cells are numbered row by row."""
    xs, ys = borders
    out = points.withColumn("cx", cell_axis(F.col("x"), xs)).withColumn("cy", cell_axis(F.col("y"), ys))
    return out.withColumn("cell", F.col("cy") * (len(xs) - 1) + F.col("cx"))


def with_uniform_cells(points: DataFrame, size: int, columns: int, rows: int) -> DataFrame:
    """points with cx, cy and cell of a uniform grid; places beyond it fall in its last cells."""
    out = points.withColumn("cx", F.least(F.floor(F.col("x") / size), F.lit(columns - 1)).cast("int")).withColumn("cy", F.least(F.floor(F.col("y") / size), F.lit(rows - 1)).cast("int"))
    return out.withColumn("cell", F.col("cy") * columns + F.col("cx"))


def cell_segments(celled: DataFrame) -> DataFrame:
    """oid, cls, cell, b, e: the stretches of frames that a track stays in one cell."""
    track = W.partitionBy("oid").orderBy("fid")
    same = (F.lag("cell").over(track) == F.col("cell")) & (F.lag("fid").over(track) == F.col("fid") - 1)
    marked = celled.withColumn("fresh", F.when(same, 0).otherwise(1))
    part = F.sum("fresh").over(track.rowsBetween(W.unboundedPreceding, 0))
    out = marked.withColumn("part", part).groupBy("oid", "part").agg(F.min("cls").alias("cls"), F.min("cell").alias("cell"), F.min("fid").alias("b"), (F.max("fid") + 1).alias("e"))
    return out.select("oid", "cls", "cell", "b", "e")


def cells_of_box(borders: tuple[list[int], list[int]], region: Region) -> dict[str, list[tuple[int, int]]]:
    """Cells that a box touches, as (cx, cy): `sure` if it covers them wholly, else `check`."""
    axes = []
    for b, lo, hi in ((borders[0], region.x0, region.x1), (borders[1], region.y0, region.y1)):
        first, last = max(0, bisect.bisect_right(b, lo) - 1), min(len(b) - 2, bisect.bisect_right(b, hi) - 1)
        axes.append([(i, b[i] >= lo and b[i + 1] - 1 <= hi) for i in range(first, last + 1)])
    touched = [((cx, cy), a and c) for cy, c in axes[1] for cx, a in axes[0]]
    return {"sure": [p for p, whole in touched if whole], "check": [p for p, whole in touched if not whole]}


def search_cells(celled: DataFrame, borders: tuple[list[int], list[int]], region: Region) -> DataFrame:
    """Points in a box: pruned by cell ranges, tested against the box only in its border cells."""
    cells = cells_of_box(borders, region)
    touched = cells["sure"] + cells["check"]
    if not touched:
        return celled.where("false")
    near = F.col("cx").between(min(x for x, _ in touched), max(x for x, _ in touched)) & F.col("cy").between(min(y for _, y in touched), max(y for _, y in touched))
    inside = F.col("x").between(region.x0, region.x1) & F.col("y").between(region.y0, region.y1)
    sure = F.lit(False)
    if cells["sure"]:
        xs, ys = zip(*cells["sure"], strict=True)
        sure = F.col("cx").between(min(xs), max(xs)) & F.col("cy").between(min(ys), max(ys))
    return celled.where(near & (sure | inside))


def write_layout(celled_segments: DataFrame, path: str) -> None:
    """The two-level layout: a folder a class, files of cell ranges sorted by cell and begin, so scans prune by all three."""
    celled_segments.repartitionByRange("cls", "cell", "b").sortWithinPartitions("cls", "cell", "b").write.mode("overwrite").partitionBy("cls").parquet(path)


def search_layout(spark: SparkSession, path: str, borders: tuple[list[int], list[int]], region: Region, classes: Iterable[int], interval: tuple[int, int]) -> DataFrame:
    """oid, cls, cell, b, e, sure: the segments of a written layout in cells that a box touches, during [lo, hi).

    `sure`: the box covers the cell wholly, so all points of the segment are inside.  Folders of other
    classes are not read; cells and begins and ends prune by the files' statistics.
    """
    cells = cells_of_box(borders, region)
    number = lambda some: [y * (len(borders[0]) - 1) + x for x, y in some]
    touched = number(cells["sure"] + cells["check"])
    found = spark.read.parquet(path).where(F.col("cls").isin(sorted(set(classes))) & F.col("cell").isin(touched) & (F.col("b") < interval[1]) & (F.col("e") > interval[0]))
    return found.select("oid", "cls", "cell", "b", "e", F.col("cell").isin(number(cells["sure"])).alias("sure"))


def by_cell(found: DataFrame) -> DataFrame:
    """cell, candidates, probation: of search_layout's segments, the objects that are inside for sure and
    those whose places must still be tested against the box, by cell."""
    ids = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("oid"))))
    return found.groupBy("cell").agg(ids(F.col("sure")).alias("candidates"), ids(~F.col("sure")).alias("probation"))


def top_classes_by_objects(points: DataFrame, k: int = 9) -> DataFrame:
    """cls, n_objects of the k classes with most objects, ties to the least class."""
    return points.groupBy("cls").agg(F.count_distinct("oid").alias("n_objects")).orderBy(F.desc("n_objects"), "cls").limit(k)


def top_classes(points: DataFrame, k: int = 9) -> DataFrame:
    """cls, n_points of the k classes with most points, ties to the least class."""
    return points.groupBy("cls").agg(F.count("*").alias("n_points")).orderBy(F.desc("n_points"), "cls").limit(k)


def _quantiles(step: float) -> list[float]:
    n = int(1 / step)
    return [i * (1 - step) / (n - 1) if n > 1 else 0.0 for i in range(n)]


def life_borders(points: DataFrame, k: int = 9, steps: tuple[tuple[int, float], ...] = LIFE_STEPS) -> DataFrame:
    """cls, n_objects, life_border: quantiles of points per object, finer for classes with more objects."""
    lives = points.groupBy("cls", "oid").agg(F.count("*").alias("life"))
    per = lives.groupBy("cls").agg(F.count("*").alias("n_objects"), *[F.percentile("life", F.array(*map(F.lit, _quantiles(s)))).alias(f"q{i}") for i, (_, s) in enumerate(steps)])
    chosen = F.col("q0")
    for i, (least, _) in enumerate(steps):
        chosen = F.when(F.col("n_objects") >= least, F.col(f"q{i}")).otherwise(chosen)
    top = per.orderBy(F.desc("n_objects"), "cls").limit(k)
    return top.select("cls", "n_objects", F.transform(chosen, lambda v: v.cast("int")).alias("life_border"))


def region_borders(points: DataFrame) -> DataFrame:
    """cls, x0, x1, y0, y1."""
    return points.groupBy("cls").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def layout_meta(points: DataFrame, k: int = 9, tempo_stride: int = TEMPO_STRIDE) -> DataFrame:
    """Life and region borders of the top classes: what an index is laid out by."""
    return life_borders(points, k).join(region_borders(points), "cls").withColumn("tempo_stride", F.lit(tempo_stride))


def border_strides(borders: DataFrame, cells: tuple[int, int]) -> DataFrame:
    """region_borders with the strides sx, sy of a grid of so many cells."""
    stride = lambda lo, hi, n: (F.floor((F.col(hi) - F.col(lo) - 1) / n) + 1).cast("int")
    return borders.select("cls", "x0", "x1", stride("x0", "x1", cells[0]).alias("sx"), "y0", "y1", stride("y0", "y1", cells[1]).alias("sy"))
