"""Structured Streaming: runs that are released when they are over, patterns as frames come in.

Frames become event times by fps.  State is kept by object (runs) or by query (patterns); rows that
come later than the watermark allows are dropped.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.points import select_points
from ..schema import Query
from .pool import PatternPool

#: Frame 0, in ms: watermarks start at the epoch, and rows at or before them are late.
ORIGIN_MS = 946_684_800_000


def with_event_time(points: DataFrame, fps: float) -> DataFrame:
    """points with `ts`, the frame's time."""
    return points.withColumn("ts", F.timestamp_millis((F.col("fid") * (1000 / fps)).cast("long") + ORIGIN_MS))


def _merge(spans: list[list[int]], fids: list[int]) -> list[list[int]]:
    """Half-open spans with single frames added, touching ones as one."""
    out: list[list[int]] = []
    for b, e in sorted([*spans, *([f, f + 1] for f in fids)]):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def stream_runs(points: DataFrame, query: Query, fps: float = 30, late_frames: int = 0) -> DataFrame:
    """oid, cls, b, e of a stream of points: each run once, when the watermark has passed its end.

    An object's state is its open spans: one, and one more for each gap that late rows may fill.
    """
    late = f"{int(late_frames * 1000 / fps)} milliseconds"
    rows = with_event_time(select_points(points, query.labels, query.region, query.interval), fps).withWatermark("ts", late)

    def step(key, frames, state: GroupState):
        cls, spans = state.get if state.exists else (None, "[]")
        spans = json.loads(spans)
        for pdf in frames:
            fids = pdf["fid"].tolist()
            cls = min([int(c) for c in pdf["cls"]] + ([cls] if cls is not None else []))
            spans = _merge(spans, fids)
        passed = (state.getCurrentWatermarkMs() - ORIGIN_MS) * fps / 1000
        over = [s for s in spans if s[1] < passed]
        spans = [s for s in spans if s[1] >= passed]
        if spans:
            state.update((cls, json.dumps(spans)))
            state.setTimeoutTimestamp(max(int(spans[0][1] * 1000 / fps) + 1 + ORIGIN_MS, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        done = [s for s in over if s[1] - s[0] >= query.duration]
        yield pd.DataFrame({"oid": [key[0]] * len(done), "cls": [cls] * len(done), "b": [s[0] for s in done], "e": [s[1] for s in done]})

    return rows.groupBy("oid").applyInPandasWithState(step, "oid int, cls int, b int, e int", "cls int, spans string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_patterns(frames: DataFrame, query: Query, fps: float = 30, late_frames: int = 0) -> DataFrame:
    """query_id, ids, start_fid, end_fid of a stream (query_id, fid, oids, classes), a row a frame.

    Frames of a query wait until the watermark has passed them, `late_frames` behind the newest, and
    then go through its PatternPool in order, in whatever micro-batches and order they came; as many
    queries run in parallel as there are ids.  Frames that are later than that, or repeat one, are
    dropped.  A row with null oids ends its query: what waits goes through, all patterns end, and
    the state is dropped once the watermark has passed the end.
    """
    late = f"{int(late_frames * 1000 / fps)} milliseconds"
    timed = with_event_time(frames, fps).withWatermark("ts", late)

    def step(key, batches, state: GroupState):
        pool, waiting, over = PatternPool(query.labels, query.duration), {}, False
        if state.exists:
            if state.hasTimedOut and json.loads(state.get[0])["over"]:
                state.remove()
                return
            held = json.loads(state.get[0])
            over, waiting = held["over"], {int(f): r for f, r in held["waiting"].items()}
            pool = PatternPool.restore(query.labels, query.duration, (held["pool"][0], [tuple(r) for r in held["pool"][1]]))
        for rows in batches:
            for fid, oids, classes in zip(rows["fid"].tolist(), rows["oids"], rows["classes"], strict=True):
                waiting.setdefault(int(fid), None if oids is None else [[int(o), int(c)] for o, c in zip(oids, classes, strict=True)])
        passed = (state.getCurrentWatermarkMs() - ORIGIN_MS) * fps / 1000
        ended = any(r is None for r in waiting.values())
        out = []
        for fid in sorted(waiting):
            if over or not (ended or fid < passed):
                break
            present = waiting.pop(fid)
            if present is None:
                out, over = out + pool.finish(), True
            elif pool.now is None or fid > pool.now:
                out += pool.frame(fid, {o: c for o, c in present})
        state.update((json.dumps({"pool": pool.state(), "waiting": {} if over else waiting, "over": over}),))
        due = max(int(min(waiting, default=0) * 1000 / fps) + 1 + ORIGIN_MS, state.getCurrentWatermarkMs() + 1)
        if waiting or over:
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"query_id": [key[0]] * len(out), "ids": [o[0] for o in out], "start_fid": [o[1] for o in out], "end_fid": [o[2] for o in out]})

    return timed.groupBy("query_id").applyInPandasWithState(step, "query_id int, ids array<int>, start_fid int, end_fid int", "pool string", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that is available, through a memory table: for tests and small replays."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)
