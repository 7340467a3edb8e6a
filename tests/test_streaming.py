from flockline.operators.runs import query_runs
from flockline.plans.comovement import co_movement
from flockline.schema import Query, Region
from flockline.streaming import online
from flockline.streaming.pool import PatternPool

POINTS = "oid int, cls int, fid int, x int, y int"


def write_batches(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_stream_runs_equals_batch(spark, tmp_path):
    rows = [(o, 0, f, 5, 5) for o in (1, 2, 3) for f in range(60) if (f // (6 + o)) % 2 == 0]
    rows.sort(key=lambda r: r[2])
    cut = [[r for r in rows if a <= r[2] < a + 15] for a in range(0, 60, 15)]
    # a last row far ahead moves the watermark past all ends
    write_batches(spark, tmp_path / "in", [*cut, [(9, 0, 5000, 5, 5)], [(9, 0, 5001, 5, 5)]], POINTS)
    q = Query({0: 1}, 5, (0, 10_000), Region(0, 10, 0, 10))
    out = online.run_once(online.stream_runs(stream(spark, tmp_path / "in", POINTS), q, fps=1), "runs_out", str(tmp_path / "ck"))
    got = {tuple(r) for r in out.collect()}
    want = {tuple(r) for r in query_runs(spark.createDataFrame(rows, POINTS), q).collect()}
    assert got == want


def test_stream_patterns_equals_batch(spark, tmp_path):
    rows = [(o, o % 2, f, 5, 5) for o in range(1, 6) for f in range(40) if (f + o) % (7 + o) > 1]
    q = Query({0: 1, 1: 1}, 3, (0, 100))
    by = {}
    for o, c, f, _, _ in rows:
        by.setdefault(f, []).append((o, c))
    frames = [(7, f, [o for o, _ in by.get(f, [])], [c for _, c in by.get(f, [])]) for f in range(40)]
    schema = "query_id int, fid int, oids array<int>, classes array<int>"
    write_batches(spark, tmp_path / "in", [frames[:13], frames[13:30], [*frames[30:], (7, 99, None, None)]], schema)
    out = online.run_once(online.stream_patterns(stream(spark, tmp_path / "in", schema), q), "patterns_out", str(tmp_path / "ck"))
    got = {(tuple(r.ids), r.start_fid, r.end_fid) for r in out.collect()}
    want = {(tuple(r.ids), r.start_fid, r.end_fid) for r in co_movement(spark.createDataFrame(rows, POINTS), q).collect()}
    assert got == want and got


def test_stream_patterns_survive_disorder(spark, tmp_path):
    """Frames come in later micro-batches than their followers, one twice, one after its query's end."""
    rows = [(o, o % 2, f, 5, 5) for o in range(1, 6) for f in range(40) if (f + o) % (7 + o) > 1]
    q = Query({0: 1, 1: 1}, 3, (0, 100))
    by = {}
    for o, c, f, _, _ in rows:
        by.setdefault(f, []).append((o, c))
    frame = lambda k, f: (k, f, [o for o, _ in by.get(f, [])], [c for _, c in by.get(f, [])])
    batches = [[frame(k, f) for f in fs for k in (7, 8)] for fs in (range(5, 13), range(0, 6), range(20, 30), range(13, 20), range(30, 40))]
    batches += [[(7, 60, None, None)], [frame(7, 45)], [frame(8, 60)], [frame(8, 500)], [frame(8, 501)]]
    schema = "query_id int, fid int, oids array<int>, classes array<int>"
    write_batches(spark, tmp_path / "in", batches, schema)
    out = online.run_once(online.stream_patterns(stream(spark, tmp_path / "in", schema), q, fps=1, late_frames=20), "disorder_out", str(tmp_path / "ck"))
    want = {(tuple(r.ids), r.start_fid, r.end_fid) for r in co_movement(spark.createDataFrame(rows, POINTS), q).collect()}
    for k in (7, 8):  # 8 has no end: frames far ahead move the watermark past all others
        assert {(tuple(r.ids), r.start_fid, r.end_fid) for r in out.where(f"query_id = {k}").collect()} == want


def test_span_merge():
    assert online._merge([[0, 3], [7, 9]], [3, 6, 12]) == [[0, 4], [6, 9], [12, 13]]
    assert PatternPool({0: 1}, 1).finish() == []
