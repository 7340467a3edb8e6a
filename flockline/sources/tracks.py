"""Readers and writers of tracks, statistics and configuration."""

from __future__ import annotations

import json
import math
import re
import tempfile
import zipfile
from dataclasses import dataclass, replace
from io import BytesIO
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DETECTIONS, POINTS

#: Class names of the intersection recordings, in the order of their ids.
RECORDING_CLASSES = ("car", "truck", "van", "trailer", "bus", "pedestrian", "bicycle", "motorcycle")


def conform(df: DataFrame, schema: T.StructType = POINTS) -> DataFrame:
    """The columns of a schema, cast; a missing one is an error."""
    missing = {f.name for f in schema} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_points(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet tracks.  Unsigned columns read as wider signed ones; only `columns` are read."""
    df = conform(spark.read.parquet(path))
    return df.select(*columns) if columns else df


def read_points_csv(spark: SparkSession, path: str, factor: int = 100) -> DataFrame:
    """CSV with a header; x and y are fractional there and become integers of a finer unit."""
    schema = T.StructType([T.StructField("oid", T.IntegerType()), T.StructField("fid", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("cls", T.ShortType())])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return conform(df.withColumn("x", (F.col("x") * factor).cast("int")).withColumn("y", (F.col("y") * factor).cast("int")))


def read_recording_zip(spark: SparkSession, path: str, recording: str) -> DataFrame:
    """Tracks of one recording in a zip of `<id>_tracks.csv` and `<id>_tracksMeta.csv`.

    The archive comes through Spark's binary reader, so it may lie on any file system; its members
    are parsed on one executor, as a zip can't be split.
    """
    classes = {n: i for i, n in enumerate(RECORDING_CLASSES)}

    def members(frames):
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(BytesIO(content)) as z:
                    find = lambda end: next(n for n in z.namelist() if n.endswith(f"{recording}_{end}.csv"))
                    meta = pd.read_csv(z.open(find("tracksMeta")), usecols=["trackId", "class"])
                    rows = pd.read_csv(z.open(find("tracks")), usecols=["trackId", "frame", "xCenter", "yCenter"])
                kinds = meta.set_index("trackId")["class"].map(classes)
                yield pd.DataFrame({"oid": rows["trackId"], "cls": rows["trackId"].map(kinds), "fid": rows["frame"], "x": rows["xCenter"], "y": rows["yCenter"]}).dropna()

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "oid int, cls int, fid int, x double, y double")
    return out.select("oid", F.col("cls").cast("short").alias("cls"), "fid", "x", "y")


def dataset_of(path: str) -> str:
    """The stem that the parts of one data set share: letters before the first digit or underscore part."""
    name = re.split(r"[\\/]", path)[-1].rsplit(".", 1)[0]
    return re.match(r"[A-Za-z]+", name)[0] if re.match(r"[A-Za-z]+", name) else name


def read_detection_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Detections of `.npy` parts: columns of DETECTIONS plus dataset and part (the file's name).

    Files are read by Spark and parsed on executors, one array a row.
    """
    names = [f.name for f in DETECTIONS]

    def parse(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                data = np.load(BytesIO(content), allow_pickle=False)[:, : len(names)].astype(np.int32)
                yield pd.DataFrame(data, columns=names).assign(dataset=dataset_of(file), part=re.split(r"[\\/]", file)[-1])

    schema = T.StructType([*DETECTIONS, T.StructField("dataset", T.StringType()), T.StructField("part", T.StringType())])
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(parse, schema)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's name: below spark.checkpoint.dir, which a cluster shares, or temporary on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or tempfile.gettempdir()}/flockline-{uuid4().hex}"


def frame_bounds_of_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Least and greatest frame of Parquet tracks, from the files' statistics alone."""
    plan = "spark.sql.parquet.aggregatePushdown", "spark.sql.sources.useV1SourceList"
    before = [spark.conf.get(k, None) for k in plan]
    try:
        spark.conf.set(plan[0], "true")
        spark.conf.set(plan[1], "")
        lo, hi = spark.read.parquet(path).agg(F.min("fid"), F.max("fid")).first()
    finally:
        for k, v in zip(plan, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if lo is None:
        raise ValueError("no rows")
    return lo, hi


def frame_bounds(points: DataFrame) -> tuple[int, int]:
    """Least and greatest frame; an error for an empty table."""
    lo, hi = points.agg(F.min("fid"), F.max("fid")).first()
    if lo is None:
        raise ValueError("no rows")
    return lo, hi


def write_frame_range(points: DataFrame, path: str, first: int, last: int) -> None:
    """The frames first..last, both included, as a table of their own."""
    points.where(F.col("fid").between(first, last)).write.mode("overwrite").parquet(path)


def write_points(points: DataFrame, path: str, by_class: bool = False) -> None:
    """Parquet; by class, queries read only their classes' folders.  Sorted by object and frame.

    Ranges of objects are written by different tasks, so a class with most of the points is not one task.
    """
    out = conform(points)
    if by_class:
        out.repartitionByRange("cls", "oid").sortWithinPartitions("cls", "oid", "fid").write.mode("overwrite").partitionBy("cls").parquet(path)
    else:
        out.sortWithinPartitions("oid", "fid").write.mode("overwrite").parquet(path)


def write_runs(runs: DataFrame, table: str, buckets: int = 64) -> None:
    """Runs as a table bucketed by object, for joins without a shuffle."""
    runs.write.mode("overwrite").bucketBy(buckets, "oid").sortBy("oid", "b").saveAsTable(table)


def write_stats(parts: dict[str, DataFrame], manifest: dict, path: str) -> None:
    """Tables of statistics and a manifest, one folder each."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = df.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_stats(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, manifest


def read_layout_meta(text: str) -> dict[int, dict]:
    """Index metadata; JSON has class ids as strings."""
    return {int(k): v for k, v in json.loads(text).items()}


@dataclass(frozen=True)
class Config:
    """What a run is configured by."""

    fps: int = 30
    width: int = 1920
    height: int = 1080
    grid: tuple[int, int] = (24, 20)
    cell_px: int = 32
    bucket_sec: int = 60
    joint_cell_px: int = 64
    joint_bucket_sec: int = 300
    minima: int = 3000
    expend: int = 2
    top_classes: int = 9

    def with_values(self, values: dict) -> Config:
        known = {k: v for k, v in values.items() if k in self.__dataclass_fields__}
        if unknown := set(values) - set(known):
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})

    def frames(self, first: int, last: int) -> int:
        return math.ceil((last - first + 1) / (self.bucket_sec * self.fps))
