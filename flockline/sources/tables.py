"""Tracks derived from the star schema's tables: objects are suppliers or users, frames are time steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1992-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_suppkey, cls: a supplier's region."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").cast("int").alias("cls"))


def frame_of(day: Column, days: int) -> Column:
    return F.floor(F.datediff(day.cast("date"), F.lit(EPOCH).cast("date")) / days).cast("int")


def raw_points(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """One point a line item: oid, cls, fid, x, y."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return lines.join(_classes(spark, sf_dir), "l_suppkey").select(
        F.col("l_suppkey").cast("int").alias("oid"), "cls", frame_of(F.col("l_shipdate"), days).alias("fid"),
        F.floor("l_quantity").cast("int").alias("x"), F.floor(F.col("l_extendedprice") / 100).cast("int").alias("y"),
    )


def tracks(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """One point an object and frame.  Line items are reduced before the classes are joined."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", frame_of(F.col("l_shipdate"), days).alias("fid"))
    points = lines.groupBy("l_suppkey", "fid").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))
    return points.join(_classes(spark, sf_dir), "l_suppkey").select(
        F.col("l_suppkey").cast("int").alias("oid"), "cls", "fid", F.floor("q").cast("int").alias("x"), F.floor(F.col("p") / 100).cast("int").alias("y")
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a user has events."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value", "props")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("int")
    return e.select(F.col("user_id").cast("int").alias("oid"), (F.col("user_id") % 3).cast("int").alias("cls"), hour.alias("fid"), F.floor("value").cast("int").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("y"))
