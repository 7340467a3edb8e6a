"""Track construction, layout, density, time units, sources, and the registered queries."""

import glob
import json
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockline import catalog
from flockline.functions import points as fp
from flockline.operators import density as dn
from flockline.operators import layout as ly
from flockline.operators import patterns as pt
from flockline.operators import prep
from flockline.schema import DETECTIONS, POINTS, Query, Region, duration_to_frames, hour_to_frame, interval_to_frames, seconds_to_frames
from flockline.sources import tracks as src

PT = "oid int, cls int, fid int, x int, y int"


def pts(spark, rows):
    return spark.createDataFrame(rows, PT)


# ---------------------------------------------------------------- time units


def test_time_units():
    assert [seconds_to_frames(v, 1) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert duration_to_frames(0.001) == 1 and duration_to_frames(2) == 60
    assert interval_to_frames((0, 2), 10) == (0, 20)
    assert hour_to_frame(1) == 108001
    with pytest.raises(ValueError):
        interval_to_frames((1, 1.01), 30)
    with pytest.raises(ValueError):
        seconds_to_frames(1, 0)
    assert Query.in_seconds({0: 1}, 2, (0, 10), fps=30) == Query({0: 1}, 60, (0, 300))
    for bad in (lambda: Query({0: 0}, 1, (0, 1)), lambda: Query({0: 1}, 0, (0, 1)), lambda: Query({0: 1}, 1, (3, 3)), lambda: Region(1, 0, 0, 1)):
        with pytest.raises(ValueError):
            bad()


# ---------------------------------------------------------------- filters


def test_filters(spark):
    df = pts(spark, [(1, 0, 0, 0, 0), (1, 0, 1, 10, 10), (2, 1, 0, 10, 0), (3, 2, 2, 5, 5), (4, 0, 5, None, 1)])
    ids = lambda d: sorted((r.oid, r.fid) for r in d.collect())
    assert ids(fp.select_points(df, [0], Region(0, 10, 0, 10))) == [(1, 0), (1, 1)]
    assert ids(fp.select_points(df, interval=(1, 3))) == [(1, 1), (3, 2)]
    assert ids(df.where(fp.inside_corners((0, 0), (10, 0), (10, 10)))) == [(1, 0), (1, 1), (2, 0), (3, 2)]
    assert ids(df.where(fp.inside_corners((5, 0), (10, 5), (5, 10)))) == [(3, 2)]
    assert [r.ci for r in fp.class_axis(df, [1, 0]).orderBy("oid", "fid").collect()] == [1, 1, 0, 1]
    names = df.select(fp.class_name(F.col("cls")).alias("n")).distinct()
    assert {r.n for r in names.collect()} == {"person", "bicycle", "car"}
    assert len(fp.CLASS_NAMES) == 80 and fp.CLASS_NAMES[79] == "toothbrush"


def test_stride_is_by_place_in_the_track(spark):
    df = pts(spark, [(1, 0, f, 0, 0) for f in (3, 4, 9, 20, 21)] + [(2, 0, 7, 0, 0)])
    assert sorted((r.oid, r.fid) for r in fp.every_kth(df, 2).collect()) == [(1, 3), (1, 9), (1, 21), (2, 7)]


def test_area_size():
    assert fp.area_size(1920, 1080, 0.25) == (960, 540)
    assert fp.area_size(100, 100, 0.01, (4, 1)) == (20, 5)
    assert fp.area_size(10, 10, 1e-9) == (1, 1)


# ---------------------------------------------------------------- track construction


def test_interpolation_equals_numpy(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for oid in range(12):
        fids = sorted(rng.sample(range(60), rng.randint(1, 8)))
        xs, ys = [rng.randrange(500) for _ in fids], [rng.randrange(500) for _ in fids]
        cls = [rng.randrange(3) for _ in fids]
        rows += list(zip([oid] * len(fids), cls, fids, xs, ys, strict=True))
        if len(fids) > 1:
            t = np.arange(fids[0], fids[-1] + 1)
            mode = min(set(cls), key=lambda c: (-cls.count(c), c))
            want |= {(oid, mode, int(f), int(x), int(y)) for f, x, y in zip(t, np.interp(t, fids, xs).astype(np.int32), np.interp(t, fids, ys).astype(np.int32), strict=True)}
    assert {tuple(r) for r in prep.interpolate(pts(spark, rows)).collect()} == want


def test_centering_and_singles(spark):
    det = spark.createDataFrame([(1, 0, 1, 0, 0, 5, 9), (1, 0, 2, 1, 1, 4, 4), (2, 0, 1, 0, 0, 2, 2)], DETECTIONS)
    assert {tuple(r) for r in prep.center_points(det).collect()} == {(1, 0, 1, 2, 4), (1, 0, 2, 2, 2), (2, 0, 1, 1, 1)}
    assert {r.y for r in prep.center_points(det, center=False).collect()} == {9, 4, 2}
    assert prep.without_single_points(prep.center_points(det)).count() == 2


def test_merged_ids_do_not_collide(spark):
    df = spark.createDataFrame([("b", 0), ("b", 4), ("a", 0), ("a", 9), ("c", 0)], "part string, oid int")
    assert sorted(r.oid for r in prep.merge_parts(df).collect()) == [0, 9, 10, 14, 15]
    assert sorted(r.oid for r in prep.merge_parts(df, ["c", "b", "a"]).collect()) == [0, 1, 5, 6, 15]
    assert prep.part_order(["a2", "a3", "a1"]) == ["a2", "a3", "a1"]
    large = spark.createDataFrame([(p, 2**31 - 1, "m") for p in "abc"], "part string, oid int, move string")
    assert sorted(r.oid for r in prep.merge_parts(large).collect()) == [2**31 * i - 1 for i in (1, 2, 3)]
    assert prep.merge_parts(large).columns == ["oid", "move"]


def test_tracks_and_borders(spark):
    df = pts(spark, [(1, 0, f, f, 2 * f) for f in (5, 3, 4)])
    t = prep.tracks(df, [0], 1, 2).first()
    assert (t.start, [tuple(p) for p in t.points]) == (3, [(6, 12), (8, 16), (10, 20)])
    assert prep.grid_borders((0, 100, 0, 10), (4, 2)) == ([0, 25, 50, 75, 101], [0, 5, 11])
    assert tuple(prep.view_field(df).first()) == (3, 5, 6, 10)


# ---------------------------------------------------------------- layout


def test_cells_and_box_search(spark):
    rng = random.Random(2)
    borders = prep.grid_borders((0, 99, 0, 59), (5, 3))
    df = pts(spark, [(i, 0, i, rng.randrange(100), rng.randrange(60)) for i in range(400)])
    celled = ly.with_cells(df, borders)
    seen = {}
    for r in celled.collect():
        assert borders[0][r.cx] <= r.x < borders[0][r.cx + 1] and borders[1][r.cy] <= r.y < borders[1][r.cy + 1]
        assert seen.setdefault(r.cell, (r.cx, r.cy)) == (r.cx, r.cy)
    for box in (Region(10, 70, 5, 50), Region(0, 99, 0, 59), Region(20, 39, 20, 39), Region(3, 4, 3, 4)):
        got = {r.oid for r in ly.search_cells(celled, borders, box).collect()}
        assert got == {r.oid for r in df.where(fp.inside(box)).collect()}
    cells = ly.cells_of_box(([0, 20, 40, 61], [0, 30, 61]), Region(0, 45, 0, 60))
    assert cells["sure"] == [(0, 0), (1, 0), (0, 1), (1, 1)] and cells["check"] == [(2, 0), (2, 1)]


def test_layout_is_read_back_with_pruning(spark, tmp_path):
    rng = random.Random(6)
    borders = prep.grid_borders((0, 99, 0, 59), (5, 3))
    df = pts(spark, [(o, o % 3, f, rng.randrange(100), rng.randrange(60)) for o in range(9) for f in range(40)])
    segments = ly.cell_segments(ly.with_cells(df, borders)).cache()
    ly.write_layout(segments, f"{tmp_path}/layout")
    box = Region(10, 70, 5, 50)
    found = ly.search_layout(spark, f"{tmp_path}/layout", borders, box, [0, 2], (10, 25))
    cells = ly.cells_of_box(borders, box)
    number = lambda k: {y * 5 + x for x, y in cells[k]}
    want = {(*r, r.cell in number("sure")) for r in segments.collect() if r.cls != 1 and r.cell in number("sure") | number("check") and r.b < 25 and r.e > 10}
    assert {tuple(r) for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cls" in plan, plan
    assert "In(cell" in plan and "LessThan(b,25)" in plan


def test_windows_of_frames_in_blocks(spark):
    frames = [(f, [f, f + 1]) for f in range(0, 60, 3)]
    df = spark.createDataFrame(frames, "fid int, ids array<int>")
    for n in (1, 4, 30):
        got = {r.fid: [x.fid for x in r.window] for r in pt.sliding_windows(df, n, block=3).collect()}
        assert got == {f: [g for g, _ in frames[max(0, i - n + 1) : i + 1]] for i, (f, _) in enumerate(frames)}


def test_life_borders(spark):
    rows = [(o, 0, f, 0, 0) for o in range(10) for f in range(o + 1)] + [(99, 1, 0, 0, 0)]
    got = {r.cls: (r.n_objects, r.life_border) for r in ly.life_borders(pts(spark, rows), 2, ((0, 0.5), (5, 0.2))).collect()}
    lives = np.arange(1, 11)
    assert got == {0: (10, [int(np.quantile(lives, q)) for q in np.linspace(0, 0.8, 5)]), 1: (1, [1, 1])}


def test_border_strides(spark):
    df = pts(spark, [(1, 0, 0, 3, 10), (1, 0, 1, 103, 71)])
    assert tuple(ly.border_strides(ly.region_borders(df), (24, 20)).first()) == (0, 3, 103, 5, 10, 71, 4)


# ---------------------------------------------------------------- density

# two classes that count and one that doesn't; one point lies beyond the extent
SEEN = [(1, 4, 0, 3, 3), (1, 4, 9, 19, 3), (2, 4, 10, 20, 25), (3, 4, 39, 49, 29), (4, 7, 25, 45, 10), (4, 7, 26, 60, 99), (5, 8, 5, 1, 1)]
GRID = dn.Grid(50, 30, 0, 39, 20, 2, 25, 4, 5)


def test_histograms_of_few_points(spark):
    df = pts(spark, SEEN)
    get = lambda d, *c: {tuple(r[k] for k in c): r.n for r in d.collect()}
    assert get(dn.spatial_histogram(df, [4, 7], GRID), "cls", "cy", "cx") == {(4, 0, 0): 2, (4, 1, 1): 1, (4, 1, 2): 1, (7, 0, 2): 1, (7, 1, 2): 1}
    assert get(dn.temporal_histogram(df, [4, 7], GRID), "cls", "tb") == {(4, 0): 2, (4, 1): 1, (4, 3): 1, (7, 2): 2}
    assert (GRID.x_edges, GRID.y_edges, GRID.t_edges) == ([0, 20, 40, 50], [0, 20, 30], [0, 10, 20, 30, 40])
    assert (GRID.jx_edges, GRID.jt_edges) == ([0, 25, 50], [0, 20, 40])
    assert {r.cls: (r.n_points, r.n_objects) for r in dn.totals(df, [4, 7]).collect()} == {4: (4, 3), 7: (2, 1), None: (7, 4)}
    every = dn.all_histograms(df, [4, 7], GRID)
    assert {r.kind: r.s for r in every.groupBy("kind").agg(F.sum("n").alias("s")).collect()} == {"spatial": 6, "temporal": 6, "joint": 6}


def cube(seed=0):
    rng = np.random.default_rng(seed)
    grid = dn.Grid(70, 50, 1, 95, 10, 1, 10, 1, 10)
    n = rng.integers(0, 6, (2, 10, 5, 7)) * (rng.random((2, 10, 5, 7)) < 0.4)
    return grid, n


def joint_of(spark, n):
    c, t, y, x = np.nonzero(n)
    return spark.createDataFrame([tuple(map(int, v)) for v in zip(c, t, y, x, n[c, t, y, x], strict=True)], "cls int, jt int, jy int, jx int, n long")


def test_scores_and_prefix_sums_equal_brute_force(spark):
    grid, n = cube()
    flat = n.sum(axis=0)
    joint = joint_of(spark, n)
    for box, rs, ts in ((dn.Box(2, 3, 4), 1, 1), (dn.Box(7, 5, 10), 1, 1), (dn.Box(2, 2, 3), 2, 3)):
        want = {}
        for x, y, t in np.ndindex(8 - box.cw, 6 - box.ch, 11 - box.nt):
            s = int(flat[t : t + box.nt, y : y + box.ch, x : x + box.cw].sum())
            if s and x % rs == y % rs == t % ts == 0:
                want[x, y, t] = s
        assert {(r.ix, r.iy, r.t0): r["count"] for r in dn.candidate_scores(joint, grid, box, rs, ts).collect()} == want
    p = dn.prefix_sums(joint, grid)
    assert p.count() == 11 * 6 * 8
    boxes = [(0, 10, 0, 5, 0, 7), (2, 5, 1, 4, 3, 6), (9, 10, 4, 5, 6, 7)]
    got = {tuple(r)[:6]: r["count"] for r in dn.box_sums(p, spark.createDataFrame(boxes, "t0 int, t1 int, y0 int, y1 int, x0 int, x1 int")).collect()}
    assert got == {b: int(flat[b[0] : b[1], b[2] : b[3], b[4] : b[5]].sum()) for b in boxes}


def test_made_queries(spark):
    grid, n = cube(3)
    joint = joint_of(spark, n)
    made = dn.make_queries(joint, grid, 20, 20, 3, 6)
    scores = [q["score"] for q in made]
    assert scores == sorted(scores, reverse=True) and made
    for q in made:
        x, y, t = q["cell_origin"]
        per = n[:, t : t + 3, y : y + 2, x : x + 2].sum(axis=(1, 2, 3))
        assert q["per_class"] == {0: int(per[0]), 1: int(per[1])} and q["count"] == per.sum()
    regions = [Region(*q["region"]) for q in made]
    assert not any(a.overlaps(b) for i, a in enumerate(regions) for b in regions[:i])
    again = [dn.make_queries(joint, grid, 20, 20, 3, 6, "weighted", seed=s) for s in (1, 1)]
    assert again[0] == again[1] and len(again[0]) > 0
    with pytest.raises(ValueError):
        dn.make_queries(joint, grid, 20, 20, 3, 6, labels=[9])
    with pytest.raises(ValueError):
        dn.candidates(grid, dn.Box(8, 1, 1))
    tops = dn.top_regions(joint, grid, 40, 30, 5)
    assert len(tops) == 5 and tops[0]["count"] == max(r["count"] for r in dn.region_scores(joint, grid, 4, 3).collect())


def test_interval_ends():
    assert dn.interval_ends([1] * 60, 60, 60, 6) == [10, 20, 30, 40, 50, 60]
    assert dn.interval_ends([0] * 10, 60, 10, 5) == [1, 3, 5, 7, 9]
    spiked = dn.interval_ends([100] + [1] * 59, 60, 60, 5)
    assert len(spiked) == 5 and spiked == sorted(set(spiked)) and spiked[-1] <= 60


def test_overlapping_pairs(spark):
    rng = random.Random(4)
    boxes = [(i, (x := rng.randrange(200)), x + rng.randrange(30), (y := rng.randrange(200)), y + rng.randrange(30)) for i in range(60)]
    got = {tuple(r) for r in dn.overlapping_pairs(spark.createDataFrame(boxes, "id int, x0 int, x1 int, y0 int, y1 int")).collect()}
    reg = {b[0]: Region(*b[1:]) for b in boxes}
    assert got == {(a, b) for a in reg for b in reg if a < b and reg[a].overlaps(reg[b])}


def test_overlapping_pairs_are_those_of_the_rows(spark):
    rng = random.Random(9)
    place = lambda n, size: ((x := rng.randrange(-n, n)), x + rng.randrange(size), (y := rng.randrange(-n, n)), y + rng.randrange(size))
    some = [place(60, 12) for _ in range(40)] + [place(60, 2) for _ in range(20)] + [(-900, 900, -900, 900), (-900, 900, 3, 3), (5, 5, -900, 900), (20, 11, 0, 30), (7, None, 1, 2)]
    # equal boxes, and ids that come twice: in one place and in two
    boxes = [(i, *b) for i, b in enumerate(some + some[:15] + some[60:])] + [(3, *some[3]), (3, *some[30]), (None, *some[60])]
    df = spark.createDataFrame(boxes, "id int, x0 int, x1 int, y0 int, y1 int")
    df.createOrReplaceTempView("some_boxes")
    want = spark.sql("SELECT a.id AS a, b.id AS b FROM some_boxes a JOIN some_boxes b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
    got = dn.overlapping_pairs(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert dn.overlapping_pairs(df.where("id < 0")).count() == 0


def test_overlapping_pairs_meet_by_cells(spark):
    i = F.col("id")
    stack = spark.range(400).select("id", F.lit(0).alias("x0"), F.lit(9).alias("x1"), (i % 200 * 10).alias("y0"), (i % 200 * 10 + 9).alias("y1"))
    found = dn.overlapping_pairs(stack)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "keys=[a#" not in plan  # no pairs are gathered to be told apart
    keys = [line for line in plan.splitlines() if "SortMergeJoin [cx#" in line]
    assert len(keys) == 1 and "cy#" in keys[0]
    assert {tuple(r) for r in found.collect()} == {(k, k + 200) for k in range(200)}


# ---------------------------------------------------------------- sources


def test_round_trips(spark, tmp_path):
    df = pts(spark, [(1, 0, 1, 2, 3), (2, 1, 5, 6, 7)])
    src.write_points(df, f"{tmp_path}/a")
    src.write_points(df, f"{tmp_path}/b", by_class=True)
    for p in "ab":
        back = src.read_points(spark, f"{tmp_path}/{p}")
        assert back.schema == POINTS and sorted(map(tuple, back.collect())) == [(1, 0, 1, 2, 3), (2, 1, 5, 6, 7)]
    src.write_frame_range(df, f"{tmp_path}/c", 5, 9)
    assert src.read_points(spark, f"{tmp_path}/c", ["oid"]).collect()[0].oid == 2
    assert src.frame_bounds(df) == src.frame_bounds_of_files(spark, f"{tmp_path}/a") == (1, 5)
    with pytest.raises(ValueError):
        src.frame_bounds(df.where("false"))
    with pytest.raises(ValueError):
        src.conform(df.drop("cls"))
    (tmp_path / "t.csv").write_text("oid,fid,x,y,cls\n1,2,0.5,1.25,0\n")
    assert tuple(src.read_points_csv(spark, f"{tmp_path}/t.csv").first()) == (1, 0, 2, 50, 125)


def test_stats_round_trip(spark, tmp_path):
    grid, n = cube()
    src.write_stats({"joint": joint_of(spark, n)}, {"fps": 10, "classes": [0, 1]}, f"{tmp_path}/s")
    parts, manifest = src.read_stats(spark, f"{tmp_path}/s", ["joint"])
    assert manifest == {"classes": [0, 1], "fps": 10} and parts["joint"].agg(F.sum("n")).first()[0] == n.sum()
    assert src.read_layout_meta(json.dumps({"3": {"tempo_stride": 60}})) == {3: {"tempo_stride": 60}}
    assert src.Config().with_values({"grid": [4, 5]}).grid == (4, 5)
    with pytest.raises(KeyError):
        src.Config().with_values({"nothing": 1})


def test_arrays_and_archives(spark, tmp_path):
    np.save(tmp_path / "town1.npy", np.array([[1, 0, 1, 0, 0, 4, 4], [2, 2, 1, 1, 1, 2, 2]]))
    got = src.read_detection_arrays(spark, str(tmp_path)).orderBy("oid").collect()
    assert [(r.oid, r.x2, r.dataset, r.part) for r in got] == [(1, 4, "town", "town1.npy"), (2, 2, "town", "town1.npy")]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("data/07_tracks.csv", "recordingId,trackId,frame,xCenter,yCenter\n7,0,1,1.5,2.5\n7,1,2,3.5,4.5\n")
        z.writestr("data/07_tracksMeta.csv", "recordingId,trackId,class\n7,0,car\n7,1,bicycle\n")
    got = src.read_recording_zip(spark, f"{tmp_path}/r.zip", "07").orderBy("oid").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 1.5, 2.5), (1, 6, 2, 3.5, 4.5)]


def test_pushdown(spark, sf_dir):
    from flockline.sources.tables import tracks

    plan = tracks(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lineitem = next(line for line in plan.splitlines() if "FileScan" in line and "l_suppkey" in line)
    assert "l_comment" not in lineitem and "l_orderkey" not in lineitem


# ---------------------------------------------------------------- registered queries


def _plain(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    df = catalog.queries()[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    assert cols == sorted(df.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    key = lambda rows: sorted(tuple(_plain(r[c]) for c in cols) for r in rows)
    assert key(got) == key(want)
