"""Registered queries of the engine, each with the same in SQL where SQL can express it.

Names follow the operator that a query is about; the ids of the inventory stand in the comments.
Object sets are shown as comma-separated ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import points as fp
from .operators import density as dn
from .operators import layout as ly
from .operators import patterns as pt
from .operators import prep
from .operators import runs as rn
from .plans import comovement as cm
from .schema import Query, Region, duration_to_frames, hour_to_frame, interval_to_frames, seconds_to_frames
from .sources import tracks as src
from .sources.tables import event_points, raw_points, table, tracks

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}

LABELS = {0: 1, 1: 1}
REGION = Region(5, 50, 0, 1000)
FLAGSHIP = Query(LABELS, 6, (160, 420), REGION)
GRID = dn.Grid(width=50, height=1050, fid_min=0, fid_max=371, cell_px=10, bucket_sec=10, joint_cell_px=10, joint_bucket_sec=40, fps=1)
CLASSES = [0, 1, 2]
BORDERS = ([0, 10, 25, 51], [0, 200, 500, 1051])

# ---------------------------------------------------------------- SQL of the shared views

PTS = """cls_of AS (SELECT s_suppkey, CAST(n_regionkey AS INT) AS cls FROM supplier JOIN nation ON s_nationkey = n_nationkey),
pts AS (SELECT CAST(l_suppkey AS INT) AS oid, any_value(cls) AS cls,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 7 AS INT) AS fid,
  CAST(floor(max(l_quantity)) AS INT) AS x, CAST(floor(max(l_extendedprice) / 100) AS INT) AS y
  FROM lineitem JOIN cls_of ON l_suppkey = s_suppkey GROUP BY l_suppkey, 3)"""
RAW = """cls_of AS (SELECT s_suppkey, CAST(n_regionkey AS INT) AS cls FROM supplier JOIN nation ON s_nationkey = n_nationkey),
raw AS (SELECT CAST(l_suppkey AS INT) AS oid, cls, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 7 AS INT) AS fid,
  CAST(floor(l_quantity) AS INT) AS x, CAST(floor(l_extendedprice / 100) AS INT) AS y
  FROM lineitem JOIN cls_of ON l_suppkey = s_suppkey)"""


def _filtered(labels: str = "0, 1", extra: str = "x BETWEEN 5 AND 50 AND y BETWEEN 0 AND 1000", lo: int = 160, hi: int = 420, pts: str = "pts") -> str:
    return f"f AS (SELECT oid, cls, fid FROM {pts} WHERE cls IN ({labels}) AND fid >= {lo} AND fid < {hi} AND {extra})"


def _runs(duration: int, source: str = "f") -> str:
    return f"""g AS (SELECT oid, cls, fid, fid - row_number() OVER (PARTITION BY oid ORDER BY fid) AS isl FROM {source}),
k AS (SELECT oid, min(cls) AS cls, CAST(min(fid) AS INT) AS b, CAST(max(fid) + 1 AS INT) AS e FROM g GROUP BY oid, isl HAVING max(fid) + 1 - min(fid) >= {duration})"""


def _patterns(labels: dict[int, int], duration: int, lo: int = 160, hi: int = 420, extra: str = "x BETWEEN 5 AND 50 AND y BETWEEN 0 AND 1000", pts: str = PTS, name: str = "pts") -> str:
    having = " AND ".join(f"count(*) FILTER (cls = {c}) >= {n}" for c, n in labels.items())
    return f"""WITH {pts}, {_filtered(", ".join(map(str, labels)), extra, lo, hi, name)}, {_runs(duration)},
c AS (SELECT DISTINCT r1.b AS s, r2.e AS e FROM k r1 JOIN k r2 ON r1.b >= r2.b AND r1.e >= r2.e AND r2.e - r1.b >= {duration}),
m AS (SELECT c.s, c.e, k.oid, k.cls FROM c JOIN k ON k.b <= c.s AND k.e >= c.e)
SELECT string_agg(CAST(oid AS VARCHAR), ',' ORDER BY oid) AS ids, s AS start_fid, CAST(e - 1 AS INT) AS end_fid, CAST(count(*) AS INT) AS n_objects
FROM m GROUP BY s, e HAVING {having}"""


def _query(sql: str | None = None):
    def register(f: Run) -> Run:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def ids_text(ids: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(ids), lambda v: v.cast("string")), ",")


def _shown(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("ids", ids_text(F.col("ids")))


# ---------------------------------------------------------------- sources, filters, scalar functions


@_query(f"WITH {PTS} SELECT oid, cls, fid, x, y FROM pts")
def track_points(spark, sf):
    """The track view."""
    return tracks(spark, sf).select("oid", "cls", "fid", "x", "y")


@_query(f"WITH {PTS} SELECT oid, cls, fid, x, y FROM pts WHERE cls IN (0, 3)")
def class_filter(spark, sf):
    """F1."""
    return tracks(spark, sf).where(fp.of_classes([0, 3])).select("oid", "cls", "fid", "x", "y")


@_query(f"WITH {PTS} SELECT oid, cls, fid, x, y FROM pts WHERE x BETWEEN 5 AND 30 AND y BETWEEN 100 AND 600")
def region_filter(spark, sf):
    """F2, F3."""
    return tracks(spark, sf).where(fp.inside(Region(5, 30, 100, 600))).select("oid", "cls", "fid", "x", "y")


@_query(f"""WITH {PTS} SELECT oid, cls, fid, x, y FROM pts
WHERE (x - 10) * 20 + (y - 0) * 10 BETWEEN 0 AND 500 AND (x - 30) * -200 + (y - 10) * 400 BETWEEN 0 AND 200000""")
def rotated_region_filter(spark, sf):
    """a rectangle at an angle."""
    return tracks(spark, sf).where(fp.inside_corners((10, 0), (30, 10), (-170, 410))).select("oid", "cls", "fid", "x", "y")


@_query(f"WITH {PTS} SELECT oid, cls, fid, x, y FROM pts WHERE cls IN (0, 1) AND x BETWEEN 5 AND 50 AND y BETWEEN 0 AND 1000")
def class_region_filter(spark, sf):
    """F5."""
    return fp.select_points(tracks(spark, sf), LABELS, REGION).select("oid", "cls", "fid", "x", "y")


@_query(f"WITH {PTS} SELECT oid, cls, fid, x, y FROM pts WHERE fid >= 200 AND fid < 240")
def interval_slice(spark, sf):
    """F6, S6."""
    return fp.select_points(tracks(spark, sf), interval=(200, 240)).select("oid", "cls", "fid", "x", "y")


@_query(f"WITH {PTS} SELECT fid, count(*) AS n_points FROM pts WHERE fid >= 160 AND fid < 420 GROUP BY fid")
def group_by_frame(spark, sf):
    """F6."""
    return fp.select_points(tracks(spark, sf), interval=(160, 420)).groupBy("fid").agg(F.count("*").alias("n_points"))


@_query(f"WITH {PTS} SELECT min(fid) AS first_fid, max(fid) AS last_fid FROM pts")
def fid_bounds(spark, sf):
    """S7."""
    return tracks(spark, sf).agg(F.min("fid").alias("first_fid"), F.max("fid").alias("last_fid"))


@_query(f"WITH {PTS} SELECT oid, min(cls) AS cls FROM pts GROUP BY oid")
def obj_class_map(spark, sf):
    """F10."""
    return fp.class_of_objects(tracks(spark, sf))


@_query(f"""WITH {PTS} SELECT cls, ['person', 'bicycle', 'car', 'motorcycle', 'airplane'][cls + 1] AS name, count(*) AS n_points FROM pts GROUP BY cls""")
def class_names(spark, sf):
    """F11."""
    return tracks(spark, sf).groupBy("cls").agg(F.count("*").alias("n_points")).select("cls", fp.class_name(F.col("cls")).alias("name"), "n_points")


@_query(f"WITH {PTS} SELECT oid, fid, CASE cls WHEN 4 THEN 0 WHEN 1 THEN 1 END AS ci FROM pts WHERE cls IN (1, 4)")
def class_axis(spark, sf):
    """F12."""
    return fp.class_axis(tracks(spark, sf), [4, 1]).select("oid", "fid", "ci")


@_query(f"""WITH {PTS}, r AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY fid) - 1 AS n FROM pts)
SELECT oid, cls, fid, x * 2.0 AS x, y * 2.0 AS y FROM r WHERE n % 5 = 0""")
def stride_sample(spark, sf):
    """F13, F14."""
    return fp.scaled(fp.every_kth(tracks(spark, sf), 5), 2.0).select("oid", "cls", "fid", "x", "y")


@_query("SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS key FROM part")
def md5_key(spark, sf):
    """F15."""
    return table(spark, sf, "part").select("p_partkey", fp.string_key(F.col("p_partkey")).alias("key"))


@_query(f"WITH {PTS} SELECT CAST(round_even(fid / 8.0, 0) AS BIGINT) AS second, count(*) AS n FROM pts GROUP BY 1")
def frames_to_seconds(spark, sf):
    """halves to even."""
    return tracks(spark, sf).groupBy(F.bround(F.col("fid") / F.lit(8.0)).cast("long").alias("second")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- track construction


def _detections(spark, sf) -> DataFrame:
    """Boxes around raw points: oid, cls, fid, x1, y1, x2, y2, a row a line item; classes vary."""
    lines = table(spark, sf, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return lines.select(
        F.col("l_suppkey").cast("int").alias("oid"), F.col("l_linenumber").cast("int").alias("cls"), F.floor(day / 7).cast("int").alias("fid"),
        F.floor("l_quantity").cast("int").alias("x1"), F.floor(F.col("l_extendedprice") / 100).cast("int").alias("y1"),
        (F.floor("l_quantity") + 7).cast("int").alias("x2"), (F.floor(F.col("l_extendedprice") / 100) + 4).cast("int").alias("y2"),
    )


_DET = """det AS (SELECT CAST(l_suppkey AS INT) AS oid, CAST(l_linenumber AS INT) AS cls,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 7 AS INT) AS fid,
  CAST(floor(l_quantity) AS INT) AS x1, CAST(floor(l_extendedprice / 100) AS INT) AS y1,
  CAST(floor(l_quantity) + 7 AS INT) AS x2, CAST(floor(l_extendedprice / 100) + 4 AS INT) AS y2 FROM lineitem),
ctr AS (SELECT oid, cls, fid, (x1 + x2) // 2 AS x, (y1 + y2) // 2 AS y FROM det)"""
_MODE = "md AS (SELECT oid, cls FROM (SELECT oid, cls, row_number() OVER (PARTITION BY oid ORDER BY count(*) DESC, cls) AS rk FROM ctr GROUP BY oid, cls) WHERE rk = 1)"


@_query(f"WITH {_DET} SELECT oid, cls, fid, x, y, count(*) AS n FROM ctr GROUP BY ALL")
def center_points(spark, sf):
    """T1."""
    return prep.center_points(_detections(spark, sf)).groupBy("oid", "cls", "fid", "x", "y").agg(F.count("*").alias("n"))


@_query(f"WITH {_DET} SELECT oid, fid, (x1 + x2) // 2 AS x, y2 AS y, count(*) AS n FROM det GROUP BY ALL")
def bottom_points(spark, sf):
    """T1, lower edge."""
    return prep.center_points(_detections(spark, sf), center=False).groupBy("oid", "fid", "x", "y").agg(F.count("*").alias("n"))


@_query(f"WITH {_DET}, {_MODE} SELECT oid, cls FROM md")
def class_mode_revision(spark, sf):
    """T3."""
    return prep.class_modes(prep.center_points(_detections(spark, sf))).select("oid", "cls")


@_query(f"""WITH {_DET}, {_MODE},
one AS (SELECT oid, fid, min({{'x': x, 'y': y}}) AS p FROM ctr GROUP BY oid, fid),
nx AS (SELECT oid, fid, p.x AS x, p.y AS y, lead(fid) OVER w AS f2, lead(p.x) OVER w AS x2, lead(p.y) OVER w AS y2, count(*) OVER (PARTITION BY oid) AS c
  FROM one WINDOW w AS (PARTITION BY oid ORDER BY fid)),
fl AS (SELECT *, unnest(range(fid, coalesce(f2, fid + 1))) AS t FROM nx WHERE c > 1)
SELECT oid, cls, CAST(t AS INT) AS fid,
  CAST(CASE WHEN t = fid THEN x ELSE trunc((x2 - x)::DOUBLE / (f2 - fid) * (t - fid) + x) END AS INT) AS x,
  CAST(CASE WHEN t = fid THEN y ELSE trunc((y2 - y)::DOUBLE / (f2 - fid) * (t - fid) + y) END AS INT) AS y
FROM fl JOIN md USING (oid)""")
def interp_tracks(spark, sf):
    """T2-T4."""
    return prep.interpolate(prep.center_points(_detections(spark, sf)))


@_query("""WITH c AS (SELECT CAST(o_custkey AS INT) AS oid, CAST(o_orderkey % 3 AS VARCHAR) AS part, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT part, max(oid) + 1 AS top FROM c GROUP BY part),
m AS (SELECT part, coalesce(sum(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mv FROM t)
SELECT CAST(oid + mv AS BIGINT) AS oid, n FROM c JOIN m USING (part)""")
def merged_part_ids(spark, sf):
    """T5."""
    parts = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("int").alias("oid"), (F.col("o_orderkey") % 3).cast("string").alias("part")).agg(F.count("*").alias("n"))
    return prep.merge_parts(parts).select("oid", "n")


@_query(f"""WITH {PTS} SELECT oid, min(fid) AS start, count(*) AS n_points, string_agg(x || ':' || y, ' ' ORDER BY fid) AS path FROM pts WHERE cls IN (0, 1) GROUP BY oid""")
def track_sequences(spark, sf):
    """T7."""
    t = prep.tracks(tracks(spark, sf), [0, 1])
    path = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))), " ")
    return t.select("oid", "start", F.size("points").cast("long").alias("n_points"), path.alias("path"))


@_query(f"WITH {PTS} SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts")
def view_field(spark, sf):
    """T8."""
    return prep.view_field(tracks(spark, sf))


# ---------------------------------------------------------------- cells and layout

_CX = "CASE WHEN x >= 51 THEN 3 WHEN x >= 25 THEN 2 WHEN x >= 10 THEN 1 WHEN x >= 0 THEN 0 ELSE -1 END"
_CY = "CASE WHEN y >= 1051 THEN 3 WHEN y >= 500 THEN 2 WHEN y >= 200 THEN 1 WHEN y >= 0 THEN 0 ELSE -1 END"
_CELL = f"cel AS (SELECT *, {_CX} AS cx, {_CY} AS cy, ({_CY}) * 3 + ({_CX}) AS cell FROM pts)"


@_query(f"WITH {PTS}, {_CELL} SELECT oid, fid, cx, cy, cell FROM cel")
def cell_index(spark, sf):
    """I1, I4."""
    return ly.with_cells(tracks(spark, sf), BORDERS).select("oid", "fid", "cx", "cy", "cell")


@_query(f"""WITH {PTS}, {_CELL},
l AS (SELECT *, CASE WHEN lag(cell) OVER w = cell AND lag(fid) OVER w = fid - 1 THEN 0 ELSE 1 END AS fresh FROM cel WINDOW w AS (PARTITION BY oid ORDER BY fid)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY oid ORDER BY fid) AS part FROM l)
SELECT oid, min(cls) AS cls, min(cell) AS cell, min(fid) AS b, max(fid) + 1 AS e FROM p GROUP BY oid, part""")
def cell_segments(spark, sf):
    """I2, I3, M10."""
    return ly.cell_segments(ly.with_cells(tracks(spark, sf), BORDERS))


@_query(f"WITH {PTS} SELECT oid, cls, fid, x, y FROM pts WHERE x BETWEEN 8 AND 30 AND y BETWEEN 150 AND 600")
def cell_pruned_search(spark, sf):
    """Sure cells skip the box test."""
    return ly.search_cells(ly.with_cells(tracks(spark, sf), BORDERS), BORDERS, Region(8, 30, 150, 600)).select("oid", "cls", "fid", "x", "y")


@_query(f"WITH {PTS}, {_filtered()}, {_runs(1)} SELECT oid, cls, b, e, e - b AS len FROM k WHERE b < 260 AND e > 240")
def temporal_overlap_probe(spark, sf):
    """I9, I11."""
    return rn.by_length(rn.overlapping(rn.query_runs(tracks(spark, sf), Query(LABELS, 1, (160, 420), REGION)), 240, 260))


@_query(f"""WITH {PTS}, {_CELL},
l AS (SELECT *, CASE WHEN lag(cell) OVER w = cell AND lag(fid) OVER w = fid - 1 THEN 0 ELSE 1 END AS fresh FROM cel WINDOW w AS (PARTITION BY oid ORDER BY fid)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY oid ORDER BY fid) AS part FROM l),
s AS (SELECT oid, min(cls) AS cls, min(cell) AS cell, min(fid) AS b, max(fid) + 1 AS e FROM p GROUP BY oid, part)
SELECT oid, cls, cell, b, e, cell IN (4) AS sure FROM s WHERE cls IN (0, 3) AND cell IN (4, 5, 7, 8) AND b < 260 AND e > 200""")
def layout_search(spark, sf):
    """A written layout, searched by class, cell and time."""
    path = src.scratch_folder(spark)
    ly.write_layout(ly.cell_segments(ly.with_cells(tracks(spark, sf), BORDERS)), path)
    return ly.search_layout(spark, path, BORDERS, Region(10, 30, 200, 600), [0, 3], (200, 260))


@_query(f"WITH {PTS} SELECT oid, cls, fid, x, y FROM pts")
def points_by_class(spark, sf):
    """Points written by class and read again."""
    path = src.scratch_folder(spark)
    src.write_points(tracks(spark, sf), path, by_class=True)
    return src.read_points(spark, path).withColumn("cls", F.col("cls").cast("int"))


@_query(f"WITH {PTS} SELECT oid, cls, fid, x, y FROM pts")
def points_csv(spark, sf):
    """Fractional places that become whole ones of a finer unit."""
    path = src.scratch_folder(spark)
    tracks(spark, sf).select("oid", "fid", (F.col("x") / 4).alias("x"), (F.col("y") / 4).alias("y"), "cls").write.option("header", True).csv(path)
    return src.read_points_csv(spark, path, 4).withColumn("cls", F.col("cls").cast("int"))


@_query(f"WITH {PTS} SELECT min(fid) AS first_fid, max(fid) AS last_fid FROM pts")
def fid_bounds_of_files(spark, sf):
    """From the files' statistics."""
    path = src.scratch_folder(spark)
    src.write_points(tracks(spark, sf), path)
    return spark.createDataFrame([src.frame_bounds_of_files(spark, path)], "first_fid int, last_fid int")


@_query(f"WITH {PTS} SELECT cls, count(*) AS n FROM pts WHERE fid BETWEEN 200 AND 239 GROUP BY cls")
def frame_range_file(spark, sf):
    """A range of frames as a table of its own; statistics with their manifest."""
    path = src.scratch_folder(spark)
    src.write_frame_range(tracks(spark, sf), f"{path}/points", 200, 239)
    counts = spark.read.parquet(f"{path}/points").groupBy("cls").agg(F.count("*").alias("n"))
    src.write_stats({"counts": counts}, {"frames": [200, 239]}, f"{path}/stats")
    return src.read_stats(spark, f"{path}/stats", ["counts"])[0]["counts"]


@_query(f"""WITH {PTS}, {_CELL},
l AS (SELECT *, CASE WHEN lag(cell) OVER w = cell AND lag(fid) OVER w = fid - 1 THEN 0 ELSE 1 END AS fresh FROM cel WINDOW w AS (PARTITION BY oid ORDER BY fid)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY oid ORDER BY fid) AS part FROM l),
s AS (SELECT oid, min(cls) AS cls, min(cell) AS cell, min(fid) AS b, max(fid) + 1 AS e FROM p GROUP BY oid, part)
SELECT cell, coalesce(string_agg(DISTINCT CAST(oid AS VARCHAR), ',' ORDER BY CAST(oid AS VARCHAR)) FILTER (cell = 4), '') AS candidates,
  coalesce(string_agg(DISTINCT CAST(oid AS VARCHAR), ',' ORDER BY CAST(oid AS VARCHAR)) FILTER (cell <> 4), '') AS probation
FROM s WHERE cls IN (0, 3) AND cell IN (4, 5, 7, 8) AND b < 260 AND e > 200 GROUP BY cell""")
def layout_candidates(spark, sf):
    """Objects inside for sure, and those to be tested, by cell."""
    as_text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda v: v.cast("string"))), ",")
    found = ly.by_cell(layout_search(spark, sf))
    return found.select("cell", as_text("candidates").alias("candidates"), as_text("probation").alias("probation"))


@_query(f"""WITH {PTS} SELECT CAST(least(x // 10, 4) AS INT) AS cx, CAST(least(y // 350, 2) AS INT) AS cy, count(*) AS n_points FROM pts GROUP BY ALL""")
def even_grid(spark, sf):
    """Cells between evenly spaced borders."""
    celled = ly.with_cells(tracks(spark, sf), prep.grid_borders((0, 50, 0, 1050), (5, 3)))
    return celled.groupBy("cx", "cy").agg(F.count("*").alias("n_points"))


@_query("""SELECT CAST(k AS INT) AS k, CAST(round_even(k / 8.0 * 30, 0) AS BIGINT) AS frames, CAST(greatest(1, round_even(k / 400.0 * 30, 0)) AS BIGINT) AS least_frames,
  CAST(round_even(k / 8.0 * 30, 0) AS BIGINT) AS lo, CAST(round_even((k / 8.0 + 1.5) * 30, 0) AS BIGINT) AS hi, CAST(k * 108000 + 1 AS BIGINT) AS hour,
  CAST(greatest(1, round_even(sqrt(k / 50.0::DOUBLE * 1920 * 1080 * 4 / 3), 0)) AS BIGINT) AS w,
  CAST(greatest(1, round_even(round_even(sqrt(k / 50.0::DOUBLE * 1920 * 1080 * 4 / 3), 0) * 3 / 4.0, 0)) AS BIGINT) AS h FROM range(1, 41) r(k)""")
def time_and_size_units(spark, sf):
    """F7, F8, F16, F17."""
    rows = [(k, seconds_to_frames(k / 8, 30), duration_to_frames(k / 400, 30), *interval_to_frames((k / 8, k / 8 + 1.5), 30), hour_to_frame(k), *fp.area_size(1920, 1080, k / 50, (4, 3))) for k in range(1, 41)]
    return spark.createDataFrame(rows, "k int, frames long, least_frames long, lo long, hi long, hour long, w long, h long")


def _quantile_sql(step: float) -> str:
    return "[" + ", ".join(f"CAST(trunc(quantile_cont(life, {q})) AS INT)" for q in ly._quantiles(step)) + "]"


_STEPS = ((0, 0.5), (30, 0.2), (150, 0.05))


@_query(f"""WITH {RAW}, lf AS (SELECT cls, oid, count(*) AS life FROM raw GROUP BY cls, oid),
q AS (SELECT cls, count(*) AS n_objects, {_quantile_sql(0.5)} AS a, {_quantile_sql(0.2)} AS b, {_quantile_sql(0.05)} AS c FROM lf GROUP BY cls)
SELECT cls, n_objects, array_to_string(CASE WHEN n_objects >= 150 THEN c WHEN n_objects >= 30 THEN b ELSE a END, ',') AS life_border FROM q ORDER BY n_objects DESC, cls LIMIT 4""")
def life_borders(spark, sf):
    """I16."""
    return ly.life_borders(raw_points(spark, sf), 4, _STEPS).withColumn("life_border", F.array_join(F.transform("life_border", lambda v: v.cast("string")), ","))


@_query(f"WITH {RAW} SELECT cls, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM raw GROUP BY cls")
def region_borders(spark, sf):
    """I17."""
    return ly.region_borders(raw_points(spark, sf))


@_query(f"""WITH {RAW}, bd AS (SELECT cls, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM raw GROUP BY cls)
SELECT cls, x0, x1, CAST((x1 - x0 - 1) // 24 + 1 AS INT) AS sx, y0, y1, CAST((y1 - y0 - 1) // 20 + 1 AS INT) AS sy FROM bd""")
def border_strides(spark, sf):
    """I19."""
    return ly.border_strides(ly.region_borders(raw_points(spark, sf)), (24, 20))


@_query(f"""WITH {RAW}, lf AS (SELECT cls, oid, count(*) AS life FROM raw GROUP BY cls, oid),
q AS (SELECT cls, count(*) AS n_objects FROM lf GROUP BY cls ORDER BY n_objects DESC, cls LIMIT 3)
SELECT q.cls, n_objects, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, 60 AS tempo_stride FROM q JOIN raw ON raw.cls = q.cls GROUP BY q.cls, n_objects""")
def layout_meta(spark, sf):
    """I18."""
    return ly.layout_meta(raw_points(spark, sf), 3).drop("life_border")


@_query(f"WITH {RAW} SELECT cls, count(DISTINCT oid) AS n_objects FROM raw GROUP BY cls ORDER BY n_objects DESC, cls LIMIT 3")
def top_classes_by_objects(spark, sf):
    """I16, Q23."""
    return ly.top_classes_by_objects(raw_points(spark, sf), 3)


@_query(f"WITH {RAW} SELECT cls, count(*) AS n_points FROM raw GROUP BY cls ORDER BY n_points DESC, cls LIMIT 3")
def top_classes(spark, sf):
    """D19."""
    return ly.top_classes(raw_points(spark, sf), 3)


# ---------------------------------------------------------------- runs and interval algebra


@_query(f"WITH {PTS}, {_filtered()}, {_runs(1)} SELECT oid, cls, b, e FROM k")
def runs(spark, sf):
    """M1, M2."""
    return rn.query_runs(tracks(spark, sf), Query(LABELS, 1, (160, 420), REGION))


@_query(f"WITH {PTS}, {_filtered()}, {_runs(6)} SELECT oid, cls, b, e FROM k")
def runs_min_dur(spark, sf):
    """M5-M8, M12."""
    return rn.query_runs(tracks(spark, sf), FLAGSHIP)


def _order_spans(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    b = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.select(F.col("o_custkey").cast("int").alias("oid"), (F.col("o_custkey") % 3).cast("int").alias("cls"), b.alias("b"), (b + 5 + F.col("o_orderkey") % 90).cast("int").alias("e"))


_SPANS = """sp AS (SELECT CAST(o_custkey AS INT) AS oid, CAST(o_custkey % 3 AS INT) AS cls, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS b,
  CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 5 + o_orderkey % 90 AS INT) AS e FROM orders)"""


def _union_sql(duration: int, source: str = "sp") -> str:
    return f"""mk AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY oid, cls ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source}),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY oid, cls ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM mk),
un AS (SELECT oid, cls, min(b) AS b, max(e) AS e FROM gr GROUP BY oid, cls, g HAVING max(e) - min(b) >= {duration})"""


@_query(f"WITH {_SPANS}, {_union_sql(40)} SELECT oid, cls, b, e FROM un")
def interval_union(spark, sf):
    """M3, M4, M11."""
    return rn.union_intervals(_order_spans(spark, sf), 40)


@_query(f"WITH {_SPANS} SELECT oid, cls, greatest(b, 1400) AS b, least(e, 1900) AS e, count(*) AS n FROM sp WHERE b < 1900 AND e > 1400 GROUP BY ALL")
def interval_clip(spark, sf):
    """F9."""
    return rn.clip(_order_spans(spark, sf), 1400, 1900).groupBy("oid", "cls", "b", "e").agg(F.count("*").alias("n"))


@_query(f"""WITH {_SPANS}, w AS (SELECT DISTINCT oid, b, e, unnest(range(b // 64, (e - 1) // 64 + 1)) AS w FROM sp)
SELECT oid, CAST(w AS INT) AS w, CAST(greatest(b, w * 64) AS INT) AS b, CAST(least(e, (w + 1) * 64) AS INT) AS e, e > (w + 1) * 64 AS cut FROM w""")
def window_pieces(spark, sf):
    """M9: tracks cut at the windows' borders."""
    return rn.window_pieces(_order_spans(spark, sf).select("oid", "b", "e").distinct(), 64).select("oid", "w", "b", "e", "cut")


@_query(f"""WITH {_SPANS}, d AS (SELECT DISTINCT oid, cls, b, e FROM sp), {_union_sql(40, "d")} SELECT oid, cls, b, e FROM un""")
def windowed_union(spark, sf):
    """Cutting at windows and uniting again changes nothing."""
    return rn.union_intervals(rn.window_pieces(_order_spans(spark, sf), 64).select("oid", "cls", "b", "e"), 40)


# ---------------------------------------------------------------- patterns


@_query(_patterns(LABELS, 6))
def comove_two_labels(spark, sf):
    """The flagship, by the production plan."""
    return _shown(cm.co_movement(tracks(spark, sf), FLAGSHIP))


@_query(_patterns({2: 1}, 6))
def comove_single_label(spark, sf):
    """P1."""
    return _shown(cm.co_movement(tracks(spark, sf), Query({2: 1}, 6, (160, 420), REGION)))


@_query(_patterns({0: 2, 1: 1, 2: 1}, 5))
def comove_counts(spark, sf):
    """Several objects of a class."""
    return _shown(cm.co_movement(tracks(spark, sf), Query({0: 2, 1: 1, 2: 1}, 5, (160, 420), REGION)))


@_query(_patterns({0: 1, 1: 1}, 5, 0, 400, "x BETWEEN 10 AND 48 AND y BETWEEN 100 AND 900"))
def comove_region(spark, sf):
    """P1, P16."""
    return _shown(cm.co_movement(tracks(spark, sf), Query({0: 1, 1: 1}, 5, (0, 400), Region(10, 48, 100, 900))))


@_query(_patterns(LABELS, 6))
def comove_closed(spark, sf):
    """By the definition."""
    return _shown(cm.co_movement(tracks(spark, sf), FLAGSHIP, "closed"))


@_query(_patterns(LABELS, 6))
def comove_index_dur(spark, sf):
    """By windows of 60 frames."""
    return _shown(cm.co_movement(tracks(spark, sf), FLAGSHIP, "index_max_dur_ss_m60_e2"))


@_query(_patterns(LABELS, 6))
def comove_index_obj(spark, sf):
    """One window of 600 frames."""
    return _shown(cm.co_movement(tracks(spark, sf), FLAGSHIP, ("max", "obj", "win", 600, 3)))


@_query(_patterns(LABELS, 6))
def comove_sliding_naive(spark, sf):
    """From the objects that qualify at each frame."""
    return _shown(cm.bind("sliding_naive")(tracks(spark, sf), FLAGSHIP))


@_query(_patterns(LABELS, 6))
def comove_sliding_state(spark, sf):
    """From the objects that qualify at each frame, by windows."""
    return _shown(cm.bind("sliding_state")(tracks(spark, sf), FLAGSHIP))


@_query(f"""WITH {_SPANS}, cp AS (SELECT oid, cls, greatest(b, 1400) AS b, least(e, 1600) AS e FROM sp WHERE cls = 0 AND b < 1600 AND e > 1400), {_union_sql(85, "cp")},
c AS (SELECT DISTINCT r1.b AS s, r2.e AS e FROM un r1 JOIN un r2 ON r1.b >= r2.b AND r1.e >= r2.e AND r2.e - r1.b >= 85),
m AS (SELECT c.s, c.e, un.oid FROM c JOIN un ON un.b <= c.s AND un.e >= c.e)
SELECT string_agg(CAST(oid AS VARCHAR), ',' ORDER BY oid) AS ids, s AS start_fid, CAST(e - 1 AS INT) AS end_fid, CAST(count(*) AS INT) AS n_objects FROM m GROUP BY s, e HAVING count(*) >= 2""")
def comove_segments(spark, sf):
    """Patterns from segments."""
    return _shown(cm.from_segments(_order_spans(spark, sf), Query({0: 2}, 85, (1400, 1600))))


_EVENTS = """ev AS (SELECT CAST(user_id AS INT) AS oid, CAST(user_id % 3 AS INT) AS cls, CAST(floor(epoch(ts) / 3600) AS INT) AS fid FROM events),
pts AS (SELECT DISTINCT oid, cls, fid FROM ev)"""


@_query(_patterns({0: 1, 1: 1}, 2, 0, 10_000_000, "true", _EVENTS))
def comove_events(spark, sf):
    """P1 over sparse tracks: hours with events."""
    return _shown(cm.co_movement(event_points(spark, sf).na.fill(0, ["x", "y"]), Query({0: 1, 1: 1}, 2, (0, 10_000_000))))


@_query(f"""WITH {PTS}, {_filtered()}, w AS (SELECT oid, cls, fid, count(*) OVER (PARTITION BY oid ORDER BY fid RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM f)
SELECT oid, cls, fid FROM w WHERE n = 6""")
def sliding_window_objs(spark, sf):
    """P9."""
    return cm.sliding_counts(tracks(spark, sf), FLAGSHIP)


@_query(f"""WITH {PTS}, {_filtered()}, w AS (SELECT oid, cls, fid, count(*) OVER (PARTITION BY oid ORDER BY fid RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM f)
SELECT fid, string_agg(CAST(oid AS VARCHAR), ',' ORDER BY oid) AS ids FROM w WHERE n = 6 GROUP BY fid HAVING count(*) FILTER (cls = 0) >= 1 AND count(*) FILTER (cls = 1) >= 1""")
def frame_object_sets(spark, sf):
    """P10, P14."""
    return cm.frame_sets(tracks(spark, sf), FLAGSHIP).withColumn("ids", ids_text(F.col("ids")))


@_query(f"WITH {PTS} SELECT fid, cls, count(DISTINCT oid) AS n_objects FROM pts GROUP BY fid, cls")
def label_counts_by_frame(spark, sf):
    """P14."""
    return pt.class_counts(tracks(spark, sf))


@_query(f"""WITH {PTS}, s AS (SELECT fid, list(oid ORDER BY oid) AS ids FROM pts WHERE cls = 0 GROUP BY fid)
SELECT a.fid, CAST(count(*) AS INT) AS n_frames, CAST(sum(len(b.ids)) AS BIGINT) AS n_seen FROM
  (SELECT fid, row_number() OVER (ORDER BY fid) AS rk FROM s) a JOIN (SELECT ids, row_number() OVER (ORDER BY fid) AS rk FROM s) b ON b.rk BETWEEN a.rk - 3 AND a.rk GROUP BY a.fid""")
def frame_windows(spark, sf):
    """P13."""
    sets = tracks(spark, sf).where("cls = 0").groupBy("fid").agg(F.array_sort(F.collect_list("oid")).alias("ids"))
    w = pt.sliding_windows(sets, 4)
    return w.select("fid", F.size("window").alias("n_frames"), F.aggregate("window", F.lit(0).cast("long"), lambda s, x: s + F.size(x["ids"])).alias("n_seen"))


def _small_patterns(spark, sf, labels) -> DataFrame:
    return cm.co_movement(tracks(spark, sf), Query(labels, 6, (160, 420), REGION))


def _lists(sql: str) -> str:
    """Patterns as lists, from a statement that shows them as text."""
    return f"(SELECT string_split(ids, ',')::INT[] AS ids, start_fid AS s, end_fid AS e FROM ({sql}))"


_IDS = "array_to_string(list_sort(ids), ',') AS ids"


@_query(f"""WITH a AS {_lists(_patterns({0: 1}, 6))}, b AS {_lists(_patterns(LABELS, 6))},
x AS (SELECT DISTINCT list_sort(list_intersect(a.ids, b.ids)) AS ids, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM a JOIN b ON a.s <= b.e AND b.s <= a.e)
SELECT {_IDS}, s AS start_fid, e AS end_fid FROM x WHERE len(ids) >= 2""")
def pattern_intersection(spark, sf):
    """P15."""
    return _shown(pt.intersect(_small_patterns(spark, sf, {0: 1}), _small_patterns(spark, sf, {0: 1, 1: 1}), 2))


@_query(f"""WITH p AS {_lists(_patterns(LABELS, 6))}
SELECT {_IDS}, s AS start_fid, e AS end_fid FROM p WHERE NOT EXISTS (
  SELECT 1 FROM p q WHERE q.s <= p.s AND q.e >= p.e AND list_has_all(q.ids, p.ids) AND (q.s <> p.s OR q.e <> p.e OR len(q.ids) <> len(p.ids)))""")
def maximal_patterns(spark, sf):
    """Patterns that no other one covers."""
    return _shown(pt.maximal(_small_patterns(spark, sf, LABELS)))


@_query(f"""WITH {PTS}, {_filtered("0", "x BETWEEN 5 AND 50 AND y BETWEEN 0 AND 1000", -1_000_000, 1_000_000)}, fr AS (SELECT fid, list(DISTINCT oid) AS ids FROM f GROUP BY fid),
w AS (SELECT a.fid AS end_fid, b.fid, b.ids, (1 << (a.fid - b.fid))::INT AS bit FROM fr a JOIN fr b ON b.fid BETWEEN a.fid - 3 AND a.fid),
m AS (SELECT end_fid, list_sort(list_reduce(list(ids), lambda x, y: list_intersect(x, y))) AS ids FROM w, range(1, 16) r(mask) WHERE mask & bit > 0 GROUP BY end_fid, mask HAVING count(*) = bit_count(mask)),
d AS (SELECT DISTINCT end_fid, ids FROM m WHERE len(ids) > 0)
SELECT d.end_fid, array_to_string(d.ids, ',') AS ids, string_agg(CAST(w.fid AS VARCHAR), ',' ORDER BY w.fid) AS frames FROM d JOIN w ON w.end_fid = d.end_fid AND list_has_all(w.ids, d.ids) GROUP BY d.end_fid, d.ids""")
def closed_sets_window(spark, sf):
    """P12."""
    sets = fp.select_points(tracks(spark, sf), [0], REGION).groupBy("fid").agg(F.array_sort(F.collect_list("oid")).alias("ids"))
    found = pt.closed_sets(sets, 4)
    return found.select("end_fid", ids_text(F.col("ids")).alias("ids"), ids_text(F.col("frames")).alias("frames"))


# ---------------------------------------------------------------- density and query generation

_SLOT = """sl AS (SELECT cls, oid, CAST(least(y // 10, 104) AS INT) AS cy, CAST(least(x // 10, 4) AS INT) AS cx,
  CAST(greatest(0, least(fid // 10, 37)) AS INT) AS tb, CAST(greatest(0, least(fid // 40, 9)) AS INT) AS jt,
  CAST(least(y // 10, 104) AS INT) AS jy, CAST(least(x // 10, 4) AS INT) AS jx FROM raw WHERE cls IN (0, 1, 2))"""
_JOINT = f"{RAW}, {_SLOT}, jh AS (SELECT cls, jt, jy, jx, count(*) AS n FROM sl GROUP BY ALL)"


def _joint(spark, sf) -> DataFrame:
    return dn.joint_histogram(raw_points(spark, sf), CLASSES, GRID)


@_query(f"WITH {RAW}, {_SLOT} SELECT cls, cy, cx, count(*) AS n FROM sl GROUP BY ALL")
def density_spatial(spark, sf):
    """D1, D2."""
    return dn.spatial_histogram(raw_points(spark, sf), CLASSES, GRID)


@_query(f"WITH {RAW}, {_SLOT} SELECT cls, tb, count(*) AS n FROM sl GROUP BY ALL")
def density_temporal(spark, sf):
    """D3."""
    return dn.temporal_histogram(raw_points(spark, sf), CLASSES, GRID)


@_query(f"WITH {_JOINT} SELECT cls, jt, jy, jx, n FROM jh")
def density_joint(spark, sf):
    """D4."""
    return _joint(spark, sf)


@_query(f"""WITH {RAW}, {_SLOT} SELECT CASE WHEN grouping(cy) = 0 THEN 'spatial' WHEN grouping(tb) = 0 THEN 'temporal' ELSE 'joint' END AS kind, cls, cy, cx, tb, jt, jy, jx, count(*) AS n
FROM sl GROUP BY GROUPING SETS ((cls, cy, cx), (cls, tb), (cls, jt, jy, jx))""")
def density_all(spark, sf):
    """D2-D4 from one scan."""
    return dn.all_histograms(raw_points(spark, sf), CLASSES, GRID)


@_query(f"""WITH {RAW}, p AS (SELECT cls, count(*) AS n_points, count(DISTINCT oid) AS n_objects FROM raw WHERE cls IN (0, 1, 2) GROUP BY cls)
SELECT cls, n_points, n_objects FROM p UNION ALL SELECT NULL, (SELECT count(*) FROM raw), CAST((SELECT sum(n_objects) FROM p) AS BIGINT)""")
def class_objects(spark, sf):
    """D5, D6."""
    return dn.totals(raw_points(spark, sf), CLASSES)


@_query(f"""WITH {_JOINT}, c AS (SELECT jt + 1 AS t, jy + 1 AS y, jx + 1 AS x, sum(n) AS n FROM jh GROUP BY ALL),
sc AS (SELECT t, y, x FROM range(11) a(t), range(106) b(y), range(6) d(x)),
a AS (SELECT sc.t, sc.y, sc.x, sum(coalesce(n, 0)) OVER (PARTITION BY sc.t, sc.y ORDER BY sc.x) AS v FROM sc LEFT JOIN c ON sc.t = c.t AND sc.y = c.y AND sc.x = c.x),
b AS (SELECT t, y, x, sum(v) OVER (PARTITION BY t, x ORDER BY y) AS v FROM a)
SELECT CAST(t AS INT) AS t, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(sum(v) OVER (PARTITION BY y, x ORDER BY t) AS BIGINT) AS total FROM b""")
def density_prefix(spark, sf):
    """D7."""
    return dn.prefix_sums(_joint(spark, sf), GRID)


_BOXES = [(0, 3, 0, 50, 0, 2), (2, 9, 20, 105, 1, 5), (5, 6, 10, 11, 3, 4), (0, 10, 0, 105, 0, 5)]


@_query(f"""WITH {_JOINT}, bx(t0, t1, y0, y1, x0, x1) AS (VALUES {", ".join(map(str, _BOXES))})
SELECT t0, t1, y0, y1, x0, x1, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM bx LEFT JOIN jh ON jt >= t0 AND jt < t1 AND jy >= y0 AND jy < y1 AND jx >= x0 AND jx < x1 GROUP BY ALL""")
def density_box_sums(spark, sf):
    """D8."""
    boxes = spark.createDataFrame(_BOXES, T.StructType([T.StructField(c, T.IntegerType()) for c in ("t0", "t1", "y0", "y1", "x0", "x1")]))
    return dn.box_sums(dn.prefix_sums(_joint(spark, sf), GRID), boxes)


@_query(f"""WITH {_JOINT}, cd AS (SELECT CAST(x AS INT) AS ix, CAST(y AS INT) AS iy, CAST(t AS INT) AS t0 FROM range(4) a(x), range(96) b(y), range(0, 9, 2) d(t))
SELECT ix, iy, t0, CAST(sum(n) AS BIGINT) AS count, CAST(sum(n) AS BIGINT) / 40.0::DOUBLE AS density FROM cd JOIN jh ON jt >= t0 AND jt < t0 + 2 AND jy >= iy AND jy < iy + 10 AND jx >= ix AND jx < ix + 2 GROUP BY ALL""")
def density_candidates(spark, sf):
    """D9-D11."""
    box = dn.Box.of(GRID, 20, 100, 80)
    return dn.candidate_scores(_joint(spark, sf), GRID, box, 1, 2)


@_query(f"""WITH {_JOINT}, cd AS (SELECT CAST(x AS INT) AS ix, CAST(y AS INT) AS iy FROM range(4) a(x), range(96) b(y))
SELECT ix, iy, CAST(sum(n) AS BIGINT) AS count FROM cd JOIN jh ON jy >= iy AND jy < iy + 10 AND jx >= ix AND jx < ix + 2 GROUP BY ALL""")
def region_top_scores(spark, sf):
    """D14."""
    return dn.region_scores(_joint(spark, sf), GRID, 2, 10)


def _chosen_sql(order: str, n: int, times: str = "range(0, 9, 2)", until: int = 2) -> str:
    """Of all origins (ix, iy, t0, count) in an order, the first n without overlap in the plane: id, o."""
    return f"""WITH RECURSIVE {_JOINT},
og AS (SELECT CAST(x AS INT) AS ix, CAST(y AS INT) AS iy, CAST(t AS INT) AS t0 FROM range(4) a(x), range(96) b(y), {times} d(t)),
sc AS (SELECT ix, iy, t0, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM og LEFT JOIN jh ON jt >= t0 AND jt < t0 + {until} AND jy >= iy AND jy < iy + 10 AND jx >= ix AND jx < ix + 2 GROUP BY ALL),
wt AS (SELECT *, count / 40.0::DOUBLE AS w, (('0x' || left(md5('1234:' || ix || ':' || iy || ':' || t0), 12))::BIGINT + 1)::DOUBLE / 281474976710656.0::DOUBLE AS u FROM sc),
od AS (SELECT *, row_number() OVER (ORDER BY {order}) AS o FROM wt),
pk AS (
  SELECT 0 AS k, []::STRUCT(o BIGINT, x INT, y INT)[] AS ch
  UNION ALL
  SELECT k + 1, list_append(any_value(ch), min({{'o': o, 'x': ix, 'y': iy}})) FROM pk, od
  WHERE k < {n} AND len(list_filter(ch, lambda c: abs(c.x - ix) < 2 AND abs(c.y - iy) < 10)) = 0 GROUP BY k),
c AS (SELECT CAST(unnest(range(len(ch))) AS INT) AS id, unnest(list_transform(ch, lambda c: c.o)) AS o FROM pk WHERE k = (SELECT max(k) FROM pk))"""


_REGION_TEXT = "(10 * ix) || ',' || (10 * ix + 19) || ',' || (10 * iy) || ',' || (10 * iy + 99)"


def _made_sql(order: str) -> str:
    return f"""{_chosen_sql(order, 5)},
pc AS (SELECT id, cls, coalesce(sum(n) FILTER (jt >= t0 AND jt < t0 + 2 AND jy >= iy AND jy < iy + 10 AND jx >= ix AND jx < ix + 2), 0) AS n FROM c JOIN od USING (o), jh GROUP BY id, cls)
SELECT id, {_REGION_TEXT} AS region, 40.0::DOUBLE * t0 AS start_sec, least(40.0::DOUBLE * (t0 + 2), 372.0::DOUBLE) AS end_sec, w AS score, count,
  (SELECT string_agg(cls || ':' || n, ',' ORDER BY cls) FROM pc WHERE pc.id = c.id) AS per_class FROM c JOIN od USING (o)"""


def _made(spark, sf, mode) -> DataFrame:
    made = dn.make_queries(_joint(spark, sf), GRID, 20, 100, 80, 5, mode)
    rows = [(q["id"], ",".join(map(str, q["region"])), float(q["interval"][0]), float(q["interval"][1]), q["score"], q["count"], ",".join(f"{c}:{n}" for c, n in sorted(q["per_class"].items()))) for q in made]
    return spark.createDataFrame(rows, "id int, region string, start_sec double, end_sec double, score double, count long, per_class string")


@_query(_made_sql("count DESC, ix, iy, t0"))
def density_greedy_queries(spark, sf):
    """D12, D15."""
    return _made(spark, sf, "greedy")


@_query(_made_sql("w <= 0, CASE WHEN w > 0 THEN -ln(u) / w ELSE u END, ix, iy, t0"))
def density_weighted_queries(spark, sf):
    """D13, D15."""
    return _made(spark, sf, "weighted")


@_query(f"{_chosen_sql('count DESC, ix, iy', 6, 'range(1)', 10)} SELECT {_REGION_TEXT} AS region, count FROM c JOIN od USING (o)")
def density_top_regions(spark, sf):
    """D14."""
    rows = [(",".join(map(str, r["region"])), r["count"]) for r in dn.top_regions(_joint(spark, sf), GRID, 20, 100, 6)]
    return spark.createDataFrame(rows, "region string, count long")


_PROFILE = f"""{RAW}, h AS (SELECT cls AS dataset, fid // 10 AS tb, count(*) AS n FROM raw GROUP BY ALL),
s AS (SELECT dataset, tb, n / sum(n) OVER (PARTITION BY dataset) AS share FROM h),
pr AS (SELECT CAST(tb AS INT) AS tb, sum(share) / (SELECT count(DISTINCT dataset) FROM h) AS share FROM s GROUP BY tb)"""


def _profile(spark, sf) -> DataFrame:
    h = raw_points(spark, sf).groupBy(F.col("cls").alias("dataset"), F.floor(F.col("fid") / 10).cast("int").alias("tb")).agg(F.count("*").alias("n"))
    return dn.mean_profile(h)


@_query(f"WITH {_PROFILE} SELECT tb, round(sum(share) OVER (ORDER BY tb) / sum(share) OVER (), 9) AS cdf FROM pr")
def temporal_profile_cdf(spark, sf):
    """D16, D17."""
    return dn.profile_cdf(_profile(spark, sf)).withColumn("cdf", F.round("cdf", 9))


@_query(f"""WITH {_PROFILE}, c AS (SELECT tb, sum(share) OVER (ORDER BY tb) / sum(share) OVER () AS cdf FROM pr)
SELECT CAST(k AS INT) AS k, CAST(min(tb) AS INT) AS tb FROM range(1, 8) r(k) JOIN c ON cdf >= k / 8.0 GROUP BY k""")
def interval_ends_raw(spark, sf):
    """D17."""
    c = dn.profile_cdf(_profile(spark, sf))
    marks = spark.range(1, 8).select(F.col("id").cast("int").alias("k"))
    return marks.join(F.broadcast(c), F.col("cdf") >= F.col("k") / 8).groupBy("k").agg(F.min("tb").alias("tb"))


@_query(f"""WITH {_PROFILE}, c AS (SELECT row_number() OVER (ORDER BY tb) AS pos, sum(share) OVER (ORDER BY tb) / (SELECT sum(share) FROM (SELECT share FROM pr ORDER BY tb LIMIT 38)) AS cdf FROM (SELECT * FROM pr ORDER BY tb LIMIT 38)),
m AS (SELECT i, coalesce(min(pos) FILTER (cdf >= i / 6.0::DOUBLE), max(pos)) AS m FROM range(1, 7) r(i), c GROUP BY i)
SELECT DISTINCT CAST(least(38, i + max(m - i) OVER (ORDER BY i)) AS INT) AS minute FROM m""")
def interval_ends(spark, sf):
    """D17."""
    profile = [r.share for r in _profile(spark, sf).orderBy("tb").collect()]
    return spark.createDataFrame([(e,) for e in dn.interval_ends(profile, 60, 38, 6)], "minute int")


def _boxes(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    x, y = (F.col("p_partkey") * 37) % 1000, (F.col("p_partkey") * 91) % 700
    return p.select(F.col("p_partkey").alias("id"), x.alias("x0"), (x + 5 + F.col("p_size")).alias("x1"), y.alias("y0"), (y + 9).alias("y1"))


@_query("""WITH b AS (SELECT p_partkey AS id, (p_partkey * 37) % 1000 AS x0, (p_partkey * 37) % 1000 + 5 + p_size AS x1, (p_partkey * 91) % 700 AS y0, (p_partkey * 91) % 700 + 9 AS y1 FROM part)
SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def box_overlap_pairs(spark, sf):
    """D18."""
    return dn.overlapping_pairs(_boxes(spark, sf))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(cm.co_movement(tracks(spark, sf_dir), Query(LABELS, 5, (160, 420), REGION)))


def queries() -> dict[str, Run]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
