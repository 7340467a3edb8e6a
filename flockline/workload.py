"""Workloads: sweeps over query parameters, methods by letter, and timed runs."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import ContextDecorator
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import DataFrame

from .plans.comovement import co_movement
from .schema import Query, Region

#: What each letter of a method option stands for.
METHOD_LETTERS = {
    "v": ["sliding_naive"],
    "t": ["sliding_state"],
    "j": ["index_max_obj"],
    "a": ["index_base"],
    "o": ["index_max_dur_one"],
    "u": ["index_max_dur_multi"],
    "d": ["index_max_dur_multi", "index_max_dur_one"],
    "s": ["sliding_state", "sliding_naive"],
    "i": ["index_max_dur_multi", "index_max_dur_one", "index_max_obj", "index_base"],
    "b": ["index_max_dur_multi", "index_max_dur_one", "index_max_obj", "index_base", "sliding_state", "sliding_naive"],
}


def methods(option: str) -> list[str]:
    """The methods that the letters of an option name, each once."""
    if unknown := set(option) - set(METHOD_LETTERS):
        raise KeyError(f"no method for {', '.join(sorted(unknown))}")
    return list(dict.fromkeys(m for letter in option for m in METHOD_LETTERS[letter]))


def datasets(option: str, names: Sequence[str]) -> list[str]:
    """`all`, `default`, or the data sets whose first letters an option gives."""
    if option == "all":
        return [n for n in names if n != "default"]
    if option == "default":
        return ["default"]
    first = {n[0]: n for n in names}
    if unknown := set(option) - set(first):
        raise KeyError(f"no data set for {', '.join(sorted(unknown))}")
    return [first[c] for c in dict.fromkeys(option)]


@dataclass(frozen=True)
class Plan:
    """A query in seconds, with the regions that its figures are averaged over."""

    labels: Mapping[int, int]
    duration: float
    interval: tuple[float, float]
    regions: tuple[Region, ...]

    def queries(self, fps: float = 30, most_regions: int | None = None) -> list[Query]:
        return [Query.in_seconds(dict(self.labels), self.duration, self.interval, r, fps) for r in self.regions[:most_regions]]


def sweep_interval(plan: Plan, ends_minutes: Iterable[float]) -> Iterator[Plan]:
    for end in ends_minutes:
        yield replace(plan, interval=(plan.interval[0], end * 60))


def sweep_duration(plan: Plan, start: int, stop: int, step: int) -> Iterator[Plan]:
    for d in range(start, stop, step):
        yield replace(plan, duration=d)


def sweep_region(plan: Plan, by_scale: Iterable[Sequence[Sequence[float]]]) -> Iterator[Plan]:
    """Boxes [x0, x1, y0, y1] by scale."""
    for boxes in by_scale:
        yield replace(plan, regions=tuple(Region(*b) for b in boxes))


def sweep_objects(plan: Plan, start: int, stop: int, step: int) -> Iterator[Plan]:
    for n in range(start, stop, step):
        yield replace(plan, labels=dict.fromkeys(plan.labels, n))


def sweep_classes(plan: Plan, start: int, stop: int, step: int) -> Iterator[Plan]:
    """One object of each of the first 1, 2, ... classes."""
    classes = list(range(start, stop, step))
    for i in range(1, len(classes) + 1):
        yield replace(plan, labels=dict.fromkeys(classes[:i], 1))


def grids(widths: Sequence[int], heights: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Grid sizes to lay an index out by: range arguments for each axis."""
    return product(range(*widths), range(*heights))


class Timer(ContextDecorator):
    """Adds up the seconds spent inside it."""

    def __init__(self):
        self.total = self.last = 0.0

    def __enter__(self):
        self._start = time.perf_counter()
        return self

    def __exit__(self, *_):
        self.last = time.perf_counter() - self._start
        self.total += self.last
        return False


def measure(points: DataFrame, plans: Iterable[Plan], method: str, fps: float = 30, regions: int = 3, repeats: int = 1) -> list[dict]:
    """For each plan: patterns and seconds, averaged over its regions and repeats."""
    out = []
    for i, plan in enumerate(plans):
        timer, found, runs = Timer(), 0, 0
        for query in plan.queries(fps, regions):
            for _ in range(repeats):
                with timer:
                    found += co_movement(points, query, method).count()
                runs += 1
        out.append({"plan": i, "method": method, "patterns": found / max(1, runs), "seconds": timer.total / max(1, runs), "runs": runs})
    return out
