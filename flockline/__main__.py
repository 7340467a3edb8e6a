"""Command line: statistics of track tables, and queries made from them."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import density as dn
from .operators import layout as ly
from .sources import tracks as src


def resolve(name: str, names: list[str]) -> str:
    """The one name that begins so."""
    found = [n for n in names if n == name] or [n for n in names if n.startswith(name)]
    if len(found) != 1:
        raise SystemExit(f"{name!r} names {len(found)} of {', '.join(names)}")
    return found[0]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="flockline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("stats", "layout"):
        s = sub.add_parser(name)
        s.add_argument("tracks")
        s.add_argument("out")
        s.add_argument("--classes", type=int, nargs="*")
        s.add_argument("--width", type=int, default=1920)
        s.add_argument("--height", type=int, default=1080)
        s.add_argument("--fps", type=int, default=30)
    q = sub.add_parser("queries")
    q.add_argument("stats")
    q.add_argument("-n", type=int, default=5)
    q.add_argument("--fraction", type=float, default=0.1)
    q.add_argument("--interval", type=float, default=600)
    q.add_argument("--mode", choices=["greedy", "weighted"], default="greedy")
    q.add_argument("--seed", type=int, default=1234)
    q.add_argument("--strict-interval", action="store_true", help="refuse intervals that are no whole number of buckets")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("flockline").getOrCreate()
    if a.command == "layout":
        ly.layout_meta(src.read_points(spark, a.tracks)).write.mode("overwrite").json(a.out)
        return 0
    if a.command == "stats":
        points = src.read_points(spark, a.tracks)
        classes = a.classes or [r.cls for r in ly.top_classes(points).collect()]
        lo, hi = src.frame_bounds(points)
        grid = dn.Grid(a.width, a.height, lo, hi, fps=a.fps)
        parts = {"spatial": dn.spatial_histogram(points, classes, grid), "temporal": dn.temporal_histogram(points, classes, grid), "joint": dn.joint_histogram(points, classes, grid), "totals": dn.totals(points, classes)}
        src.write_stats(parts, {"classes": list(map(int, classes)), "width": a.width, "height": a.height, "fid_min": lo, "fid_max": hi, "fps": a.fps}, a.out)
        return 0
    parts, m = src.read_stats(spark, a.stats, ["joint"])
    grid = dn.Grid(m["width"], m["height"], m["fid_min"], m["fid_max"], fps=m["fps"])
    if a.interval % grid.joint_bucket_sec:
        if a.strict_interval:
            raise SystemExit(f"{a.interval} s is no multiple of {grid.joint_bucket_sec} s")
        print(f"interval is rounded to buckets of {grid.joint_bucket_sec} s", file=sys.stderr)
    from .functions.points import area_size

    made = dn.make_queries(parts["joint"], grid, *area_size(grid.width, grid.height, a.fraction), a.interval, a.n, a.mode, seed=a.seed)
    if len(made) < a.n:
        print(f"only {len(made)} regions fit", file=sys.stderr)
    json.dump(made, sys.stdout, indent=1)
    return 0


if __name__ == "__main__":
    sys.exit(main())
