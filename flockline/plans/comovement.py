"""Closed co-movement patterns: who stays together in a region, and how long.

A pattern (ids, start_fid, end_fid): all objects whose runs cover the frames start..end, end
included, with some run that begins at start, some that ends at end, `duration` frames at least and
the minimum of every class.  Three plans give the same rows: `prefix`, for production; `windowed`,
whose tasks hold the runs of a window of frames each, and nothing that grows with the time; and
`closed`, the definition itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.points import select_points
from ..operators.runs import query_runs, runs, union_intervals
from ..schema import Query


def _spread(runs_: DataFrame, width: int) -> DataFrame:
    """A row for every time bucket that a run touches: the equi-join key of the range joins."""
    return runs_.select("*", F.explode(F.sequence(F.floor(F.col("b") / width), F.floor((F.col("e") - 1) / width))).alias("bucket"))


def bucket_width(duration: int) -> int:
    """Runs last `duration` at least, so they touch few buckets of four times that; an event touches one."""
    return 4 * duration


def enough(labels: dict[int, int], count: Callable[[int], Column]) -> Column:
    """Whether every class reaches its minimum."""
    out = F.lit(True)
    for c, n in sorted(labels.items()):
        out = out & (count(c) >= n)
    return out


def prefix_patterns(runs_: DataFrame, labels: dict[int, int], duration: int, width: int | None = None) -> DataFrame:
    """Patterns by end event.

    At an end e the runs that cover frame e-1 and began by e-duration are active.  Sorted by begin,
    each prefix that reaches the last-begun run that ends there is a pattern, as soon as its
    classes suffice.  Active runs meet their event by time bucket (a run covers e-1 in exactly one
    bucket), are grouped by (e, b), and only then are prefixes formed over distinct begins.
    Ends whose active runs can't satisfy the classes are dropped before any list is built.
    """
    if not labels:
        return runs_.where("false").select(F.array().cast("array<int>").alias("ids"), F.col("b").alias("start_fid"), F.col("e").alias("end_fid"), F.lit(0).alias("n_objects"))
    width = width or bucket_width(duration)
    runs_ = runs_.where(F.col("e") - F.col("b") >= duration)
    ends = runs_.groupBy("e").agg(F.min("b").alias("low")).select(F.col("e").alias("end"), "low", F.floor((F.col("e") - 1) / width).alias("bucket"))
    active = _spread(runs_, width).join(ends, "bucket").where((F.col("b") <= F.col("end") - duration) & (F.col("e") >= F.col("end")))
    counted = [F.sum(F.when(F.col("cls") == c, 1).otherwise(0)).alias(f"n_{c}") for c in labels]
    steps = active.groupBy("end", "low", "b").agg(F.collect_list("oid").alias("some"), *counted)
    whole = W.partitionBy("end")
    upto = whole.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    possible = steps.withColumn("_ok", enough(labels, lambda c: F.sum(f"n_{c}").over(whole))).where("_ok")
    lists = possible.select("end", "low", "b", F.flatten(F.collect_list("some").over(upto)).alias("ids"), enough(labels, lambda c: F.sum(f"n_{c}").over(upto)).alias("ok"))
    found = lists.where("ok and b >= low")
    return found.select(F.array_sort("ids").alias("ids"), F.col("b").alias("start_fid"), (F.col("end") - 1).alias("end_fid"), F.size("ids").alias("n_objects"))


def closed_patterns(runs_: DataFrame, labels: dict[int, int], duration: int, width: int | None = None) -> DataFrame:
    """Patterns by definition: begins and ends of overlapping runs, and the runs that cover both."""
    width = width or bucket_width(duration)
    runs_ = runs_.where(F.col("e") - F.col("b") >= duration)
    start_at = lambda df: df.withColumn("bucket", F.floor(F.col("b") / width))
    first = start_at(runs_).select("bucket", F.col("b").alias("s"), F.col("e").alias("until"))
    spread = _spread(runs_, width)
    pairs = first.join(spread, "bucket").where((F.col("b") <= F.col("s")) & (F.col("until") >= F.col("e")) & (F.col("e") - F.col("s") >= duration))
    spans = pairs.select("bucket", "s", F.col("e").alias("end")).distinct()
    members = spans.join(spread, "bucket").where((F.col("b") <= F.col("s")) & (F.col("e") >= F.col("end")))
    counted = [F.sum(F.when(F.col("cls") == c, 1).otherwise(0)).alias(f"n_{c}") for c in labels]
    groups = members.groupBy("s", "end").agg(F.array_sort(F.collect_list("oid")).alias("ids"), *(counted or [F.lit(0).alias("n_")]))
    kept = groups.where(enough(labels, lambda c: F.col(f"n_{c}")) if labels else F.lit(False))
    return kept.select("ids", F.col("s").alias("start_fid"), (F.col("end") - 1).alias("end_fid"), F.size("ids").alias("n_objects"))


def windowed_patterns(runs_: DataFrame, labels: dict[int, int], duration: int, stride: int) -> DataFrame:
    """Patterns by windows of `stride` frames, each a task of its own: those whose last frame is in the window.

    A task holds the runs that touch its window, uncut, and goes through their ends in order.
    `stride` must hold two durations, so that a run is in few windows.
    """
    if stride < 2 * duration:
        raise ValueError(f"a window of {stride} frames does not hold two durations of {duration}")
    schema = "ids array<int>, start_fid int, end_fid int, n_objects int"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w = int(pdf["bucket"].iloc[0])
        rows = sorted(zip(*(pdf[c].tolist() for c in ("b", "e", "oid", "cls")), strict=True))
        out, active, at = [], [], 0
        for end in sorted({e for _, e, _, _ in rows if (e - 1) // stride == w}):
            while at < len(rows) and rows[at][0] <= end - duration:
                active.append(rows[at])
                at += 1
            active = [r for r in active if r[1] >= end]
            low = min((b for b, e, _, _ in active if e == end), default=None)
            ids, left = [], dict(labels)
            for i, (b, _, oid, cls) in enumerate(active):
                ids.append(oid)
                left[cls] -= 1
                closed = i + 1 == len(active) or active[i + 1][0] > b
                if closed and low is not None and b >= low and max(left.values()) <= 0:
                    out.append((sorted(ids), b, end - 1, len(ids)))
        return pd.DataFrame(out, columns=["ids", "start_fid", "end_fid", "n_objects"])

    some = runs_.where((F.col("e") - F.col("b") >= duration) & F.col("cls").isin(sorted(labels)))
    return _spread(some, stride).groupBy("bucket").applyInPandas(solve, schema)


def sliding_counts(points: DataFrame, query: Query) -> DataFrame:
    """oid, cls, fid: objects in the region at each of the `duration` frames up to fid."""
    seen = select_points(points, query.labels, query.region, query.interval).groupBy("oid", "fid").agg(F.min("cls").alias("cls"))
    last = W.partitionBy("oid").orderBy("fid").rangeBetween(1 - query.duration, 0)
    return seen.withColumn("n", F.count("*").over(last)).where(F.col("n") == query.duration).select("oid", "cls", "fid")


def frame_sets(points: DataFrame, query: Query) -> DataFrame:
    """fid, ids: the objects that qualify at each frame, where their classes suffice."""
    rows = sliding_counts(points, query)
    counted = [F.sum(F.when(F.col("cls") == c, 1).otherwise(0)).alias(f"n_{c}") for c in query.labels]
    sets = rows.groupBy("fid").agg(F.array_sort(F.collect_list("oid")).alias("ids"), *counted)
    return sets.where(enough(query.labels, lambda c: F.col(f"n_{c}"))).select("fid", "ids")


def runs_of_frames(qualified: DataFrame, duration: int) -> DataFrame:
    """Runs from objects that qualify by frame: each began duration - 1 frames before it first did."""
    return runs(qualified.select("oid", "cls", "fid")).withColumn("b", F.col("b") - (duration - 1))


# ---------------------------------------------------------------- methods by name


@dataclass(frozen=True)
class Method:
    """What a method's name asks for.  All give the same rows; merges by strides take the window from minima and expend."""

    family: str = "index"
    enumerator: str = "obj"
    merge: str = "stored"
    minima: int = 3000
    expend: int = 2


_MERGES = {  # fixed values: the names of the merge strategies
    "stored": "stored", "materialized": "stored", "vanilla": "stored", "multi": "stored",
    "streaming": "streaming", "stream": "streaming", "one": "streaming",
    "one_pass": "one_pass", "onepass": "one_pass",
    "stride": "stride", "stride_stream": "stride_stream", "ss": "stride_stream", "stride_win": "stride_win", "win": "stride_win",
}


WINDOWED = ("stride", "stride_stream", "stride_win", "state")


def parse_method(name: str | tuple) -> Method:
    """A method from its name, `index_max_dur_stride_m600_e3`, or from a tuple of its parts."""
    if not isinstance(name, str):
        parts = [str(p) for p in name]
        sizes = [p for p in parts if p.isdigit()]
        name = "_".join([p for p in parts if not p.isdigit()] + [f"{k}{v}" for k, v in zip("me", sizes, strict=False)])
    family, enumerator, sizes, words = "index", "obj", {}, []
    for token in name.split("_"):
        if token in ("index", "sliding"):
            family = token
        elif token in ("dur", "obj"):
            enumerator = token
        elif m := re.fullmatch(r"([me])(\d+)", token):
            sizes["minima" if m[1] == "m" else "expend"] = int(m[2])
        elif token not in ("max", ""):
            words.append(token)
    merge = "_".join(words)
    if family == "sliding":
        if merge not in ("naive", "base", "state"):
            raise NotImplementedError(f"no sliding method {merge!r}")
        return Method("sliding", enumerator, "state" if merge == "state" else "naive")
    if merge and merge not in _MERGES:
        raise ValueError(f"no method {name!r}")
    merge = _MERGES.get(merge, "stored")
    if merge == "streaming":
        merge = "stride_stream" if enumerator == "dur" else "stride_win"
    return Method(family, enumerator, merge, **sizes)


def check_stride(method: Method, duration: int) -> int:
    """The window of the windowed merges; it must hold two durations."""
    if method.expend < 2 or method.minima < 1:
        raise ValueError("expend must be above 1 and minima above 0")
    return max(duration * method.expend, method.minima)


def require_classes(points: DataFrame, labels: dict[int, int]) -> None:
    """A KeyError if a class of a query has no points at all; without this check it gives no rows."""
    have = {int(r.cls) for r in points.where(F.col("cls").isin(sorted(labels))).select("cls").distinct().collect()}  # as many as there are labels
    if missing := sorted(set(labels) - have):
        raise KeyError(f"no points of classes {', '.join(map(str, missing))}")


def co_movement(points: DataFrame, query: Query, method: str | tuple | None = None) -> DataFrame:
    """Patterns of a query: ids, start_fid, end_fid, n_objects.

    method: `prefix` or `closed` name a plan; the names of the index and sliding methods are
    accepted and give the same rows: sliding ones from the objects that qualify at each frame, those
    that merge by strides (and `sliding_state`) by windows of `minima` or `expend` durations.  No
    labels, and classes that are absent from the points, give no rows.
    """
    name = method or query.method
    if name == "closed":
        return closed_patterns(query_runs(points, query), query.labels, query.duration)
    if name == "prefix" or not query.labels:
        return prefix_patterns(query_runs(points, query), query.labels, query.duration)
    parsed = parse_method(name)
    stride = check_stride(parsed, query.duration)
    found = runs_of_frames(sliding_counts(points, query), query.duration) if parsed.family == "sliding" else query_runs(points, query)
    if parsed.merge in WINDOWED:
        return windowed_patterns(found, query.labels, query.duration, stride)
    return prefix_patterns(found, query.labels, query.duration)


def bind(method: str | tuple) -> Callable[[DataFrame, Query], DataFrame]:
    """A query function with its method fixed."""
    if method not in ("prefix", "closed"):
        parse_method(method)
    return partial(co_movement, method=method)


def from_segments(segments: DataFrame, query: Query) -> DataFrame:
    """Patterns of segments (oid, cls, b, e): clipped to the interval, unioned, enumerated."""
    from ..operators.runs import clip

    some = segments.where(F.col("cls").isin(sorted(query.labels))) if query.labels else segments.where("false")
    return prefix_patterns(union_intervals(clip(some, *query.interval), query.duration), query.labels, query.duration)
