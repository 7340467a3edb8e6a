"""Sets of objects: class minimums, pattern algebra, closed sets over windows of frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def class_counts(points: DataFrame) -> DataFrame:
    """fid, cls, n_objects."""
    return points.groupBy("fid", "cls").agg(F.count_distinct("oid").alias("n_objects"))


def satisfies(counts: Column, labels: dict[int, int]) -> Column:
    """Whether a map of class counts has exactly the classes of labels, each with its minimum."""
    out = F.size(counts) == len(labels)
    for c, n in labels.items():
        out = out & (F.coalesce(F.try_element_at(counts, F.lit(c)), F.lit(0)) >= n)
    return out


def long_enough(ids: Column, n: int) -> Column:
    return F.size(ids) >= n


def intersect(left: DataFrame, right: DataFrame, at_least: int = 1) -> DataFrame:
    """Patterns of both tables with the objects they share and the frames they share.

    Both have (ids, start_fid, end_fid).  They meet by an object that they share, each pair once,
    and only where their frames overlap.
    """
    a = left.withColumn("a", F.monotonically_increasing_id())
    b = right.withColumn("b", F.monotonically_increasing_id())
    x = a.select("a", F.explode("ids").alias("oid"), F.col("start_fid").alias("s1"), F.col("end_fid").alias("e1"))
    y = b.select("b", F.explode("ids").alias("oid"), F.col("start_fid").alias("s2"), F.col("end_fid").alias("e2"))
    shared = x.join(y, "oid").where("s1 <= e2 and s2 <= e1").groupBy("a", "b", "s1", "e1", "s2", "e2").agg(F.array_sort(F.collect_list("oid")).alias("ids"))
    return shared.where(F.size("ids") >= at_least).select("ids", F.greatest("s1", "s2").alias("start_fid"), F.least("e1", "e2").alias("end_fid")).distinct()


def maximal(patterns: DataFrame) -> DataFrame:
    """Patterns without those that another one covers, in objects and in frames.

    Patterns meet by the rarest object of the covered one, as numbers only: frames and sizes settle
    most pairs, and lists are sent for those alone that remain.  Spark takes exploded lists for as
    small as their patterns, so all joins of them are told not to broadcast.
    """
    whole = ["ids", "start_fid", "end_fid"]
    # the distinct rows as one value: filters of the branches below stay above it, so patterns are made once
    named = F.struct(*whole, F.xxhash64(*whole).alias("p"), F.size(F.array_distinct("ids")).alias("n"))
    p = patterns.groupBy(*whole).agg(F.first(named).alias("t")).select("t.*")
    members = p.select("p", "start_fid", "end_fid", "n", F.explode(F.array_distinct("ids")).alias("oid"))
    held = members.groupBy("oid").agg(F.count("*").alias("holders"))
    mine = members.join(held.hint("merge"), "oid").groupBy("p", "start_fid", "end_fid", "n").agg(F.min(F.struct("holders", "oid"))["oid"].alias("oid"))
    others = members.select(F.col("p").alias("q"), "oid", F.col("start_fid").alias("s"), F.col("end_fid").alias("e"), F.col("n").alias("m"))
    likely = mine.join(others.hint("merge"), "oid").where("p != q and s <= start_fid and e >= end_fid and m >= n").select("p", "q")
    lists, more = p.select("p", "ids"), p.select(F.col("p").alias("q"), F.col("ids").alias("more"))
    inside = likely.join(lists.hint("merge"), "p").join(more.hint("merge"), "q").where(F.size(F.array_except("ids", "more")) == 0)
    return p.join(inside.select("p").distinct(), "p", "left_anti").select(*whole)


def sliding_windows(frames: DataFrame, n: int, block: int = 4096) -> DataFrame:
    """fid and the sets of the last n frames, oldest first (fewer at the start); a row a frame.

    Only the frame numbers are ranked in one task; the sets are dealt to blocks of ranks, and the
    last n - 1 of a block to the next ones, too.
    """
    rank = frames.select("fid").withColumn("rank", F.row_number().over(W.orderBy("fid")) - 1)
    ranked = frames.select("fid", "ids").join(rank, "fid")
    home = F.floor(F.col("rank") / block)
    dealt = ranked.withColumn("home", home).withColumn("block", F.explode(F.sequence(home, F.floor((F.col("rank") + (n - 1)) / block))))
    last = W.partitionBy("block").orderBy("fid").rowsBetween(1 - n, 0)
    return dealt.withColumn("window", F.collect_list(F.struct("fid", "ids")).over(last)).where("block = home").select("fid", "window")


def _intersections(sets: list[tuple[int, frozenset]]) -> dict[frozenset, list[int]]:
    """Every intersection of some of the sets, but the empty one, with the frames whose sets hold it."""
    found: set[frozenset] = set()
    for _, s in sets:
        found |= {s & f for f in found} | {s}
    found.discard(frozenset())
    return {f: [fid for fid, s in sets if f <= s] for f in found}


def closed_sets(frames: DataFrame, window: int) -> DataFrame:
    """end_fid, ids, frames: the closed object sets of each `window` frames, with exact support.

    frames: fid, ids.  Each frame is sent to the windows that hold it, so a task sees `window`
    frames at a time; the number of sets a window has is a property of the data.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        end = int(pdf["end_fid"].iloc[0])
        rows = sorted((int(f), frozenset(int(i) for i in ids)) for f, ids in zip(pdf["fid"], pdf["ids"], strict=True))
        if not any(f == end for f, _ in rows):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("end_fid", "ids", "frames")})
        sets = _intersections(rows)
        order = sorted(sets, key=sorted)
        return pd.DataFrame({"end_fid": [end] * len(order), "ids": [sorted(s) for s in order], "frames": [sets[s] for s in order]})

    dealt = frames.select("fid", "ids", F.explode(F.sequence(F.col("fid"), F.col("fid") + window - 1)).alias("end_fid"))
    return dealt.groupBy("end_fid").applyInPandas(solve, "end_fid int, ids array<int>, frames array<int>")
