"""Filters and scalar functions over track points."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import Region

# Names of the 80 object classes, by id.
CLASS_NAMES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck",
    "boat", "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat",
    "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe",
    "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard",
    "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake",
    "chair", "couch", "potted plant", "bed", "dining table", "toilet", "tv", "laptop",
    "mouse", "remote", "keyboard", "cell phone", "microwave", "oven", "toaster", "sink",
    "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def of_classes(classes: Iterable[int]) -> Column:
    return F.col("cls").isin(sorted({int(c) for c in classes}))


def inside(region: Region | None) -> Column:
    if region is None:
        return F.lit(True)
    return F.col("x").between(region.x0, region.x1) & F.col("y").between(region.y0, region.y1)


def inside_corners(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> Column:
    """Within the rectangle with sides AB and BC, at any angle: projections within both sides."""

    def along(p, q):
        ux, uy = q[0] - p[0], q[1] - p[1]
        dot = (F.col("x") - p[0]) * ux + (F.col("y") - p[1]) * uy
        return dot.between(0, ux * ux + uy * uy)

    return along(a, b) & along(b, c)


def during(lo: int, hi: int) -> Column:
    return (F.col("fid") >= lo) & (F.col("fid") < hi)


def select_points(points: DataFrame, classes: Iterable[int] | None = None, region: Region | None = None, interval: tuple[int, int] | None = None) -> DataFrame:
    """Rows that pass all filters; those with a null id, frame or place never do."""
    out = points.where("oid is not null and fid is not null and x is not null and y is not null")
    if classes is not None:
        out = out.where(of_classes(classes))
    if region is not None:
        out = out.where(inside(region))
    if interval is not None:
        out = out.where(during(*interval))
    return out


def class_of_objects(points: DataFrame) -> DataFrame:
    """oid, cls; where an object has several, the least."""
    return points.groupBy("oid").agg(F.min("cls").alias("cls"))


def class_name(cls: Column) -> Column:
    """The name of a class id; null outside 0..79."""
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    return F.get(names, cls.cast("int"))


def class_axis(points: DataFrame, classes: Sequence[int]) -> DataFrame:
    """points of the given classes with `ci`, the place of their class among them."""
    places = F.create_map(*[F.lit(v) for pair in zip(map(int, classes), range(len(classes)), strict=True) for v in pair])
    return points.where(of_classes(classes)).withColumn("ci", F.try_element_at(places, F.col("cls").cast("int")))


def every_kth(points: DataFrame, k: int) -> DataFrame:
    """Each track's points 0, k, 2k, ... in the order of frames."""
    if k < 1:
        raise ValueError("k must be positive")
    nth = F.row_number().over(W.partitionBy("oid").orderBy("fid")) - 1
    n = unused(points, "nth")
    return points.withColumn(n, nth).where(F.col(n) % k == 0).drop(n)


def scaled(points: DataFrame, factor: float) -> DataFrame:
    return points.withColumn("x", F.col("x") * factor).withColumn("y", F.col("y") * factor)


def string_key(value: Column) -> Column:
    return F.md5(value.cast("string"))


def area_size(width: int, height: int, fraction: float, aspect: tuple[float, float] | None = None) -> tuple[int, int]:
    """Width and height of a region that covers a fraction of the frame."""
    rw, rh = aspect or (width, height)
    w = round((fraction * width * height * rw / rh) ** 0.5)
    return max(1, w), max(1, round(w * rh / rw))
