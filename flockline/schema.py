"""The data model: tracks, runs, queries, and time units."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: One row per object and frame.
POINTS = T.StructType([T.StructField("oid", T.IntegerType()), T.StructField("cls", T.ShortType()), T.StructField("fid", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
#: One row per detection box.
DETECTIONS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("oid", "cls", "fid", "x1", "y1", "x2", "y2")])

DEFAULT_FPS = 30


def seconds_to_frames(value: float, fps: float = DEFAULT_FPS, minimum: int | None = None) -> int:
    """Frames of a time in seconds, halves rounded to even; not below `minimum`."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    frames = round(value * fps)
    return frames if minimum is None else max(minimum, frames)


def duration_to_frames(seconds: float, fps: float = DEFAULT_FPS) -> int:
    """A minimum duration lasts a frame at least."""
    return seconds_to_frames(seconds, fps, 1)


def interval_to_frames(interval: tuple[float, float], fps: float = DEFAULT_FPS) -> tuple[int, int]:
    """[lo, hi) in seconds to frames."""
    lo, hi = (seconds_to_frames(v, fps) for v in interval)
    if hi <= lo:
        raise ValueError(f"interval {interval} is shorter than a frame")
    return lo, hi


def hour_to_frame(hour: float, fps: int = DEFAULT_FPS) -> int:
    """Frame ids start at 1."""
    return round(hour * 3600 * fps) + 1


@dataclass(frozen=True)
class Region:
    """A box, all four sides inclusive."""

    x0: float
    x1: float
    y0: float
    y1: float

    def __post_init__(self):
        if self.x0 > self.x1 or self.y0 > self.y1:
            raise ValueError(f"empty region {self}")

    def overlaps(self, other: Region) -> bool:
        return self.x0 <= other.x1 and other.x0 <= self.x1 and self.y0 <= other.y1 and other.y0 <= self.y1


@dataclass(frozen=True)
class Query:
    """Objects of the classes in `labels`, in `region`, over frames [lo, hi), together for `duration` frames."""

    labels: dict[int, int]
    duration: int
    interval: tuple[int, int]
    region: Region | None = None
    method: str = "prefix"
    tags: dict[str, object] = field(default_factory=dict)

    def __post_init__(self):
        if self.duration < 1:
            raise ValueError("duration must be at least one frame")
        if len(self.interval) != 2 or self.interval[0] >= self.interval[1]:
            raise ValueError(f"empty interval {self.interval}")
        if any(n < 1 for n in self.labels.values()):
            raise ValueError("each class needs a minimum of at least one object")

    @classmethod
    def in_seconds(cls, labels: dict[int, int], duration: float, interval: tuple[float, float], region: Region | None = None, fps: float = DEFAULT_FPS, **more) -> Query:
        return cls(dict(labels), duration_to_frames(duration, fps), interval_to_frames(interval, fps), region, **more)
