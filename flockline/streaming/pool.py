"""State of the streaming enumerator: who is present, in groups by when they came."""

from __future__ import annotations

from bisect import insort


class PatternPool:
    """Closed patterns of a stream of frames, emitted when an object leaves.

    The present objects are kept in groups by their begin.  The pattern that starts at a group's
    begin is the union of the groups up to it, so patterns are never stored: a group holds only
    what it adds.
    """

    def __init__(self, labels: dict[int, int], duration: int):
        if duration < 1:
            raise ValueError("duration must be at least one frame")
        self.labels, self.duration = labels, duration
        self.begin: dict[int, int] = {}
        self.cls: dict[int, int] = {}
        self.begins: list[int] = []
        self.groups: dict[int, set[int]] = {}
        self.now: int | None = None

    def frame(self, fid: int, present: dict[int, int]) -> list[tuple[list[int], int, int]]:
        """The patterns that end before frame fid, where `present` (id to class) are there."""
        if self.now is not None and fid <= self.now:
            raise ValueError("frames must ascend")
        out = []
        if self.now is not None:
            end = self.now + 1
            gone = set(self.begin) if fid > end else set(self.begin) - set(present)
            out = self._emit(end, gone)
            for oid in gone:
                self._leave(oid)
        for oid, cls in present.items():
            if cls in self.labels and oid not in self.begin:
                self._come(oid, cls, fid)
        self.now = fid
        return out

    def finish(self) -> list[tuple[list[int], int, int]]:
        """The patterns that the end of the stream ends."""
        if self.now is None:
            return []
        out = self._emit(self.now + 1, set(self.begin))
        for oid in list(self.begin):
            self._leave(oid)
        return out

    def _come(self, oid: int, cls: int, fid: int) -> None:
        if fid not in self.groups:
            insort(self.begins, fid)
            self.groups[fid] = set()
        self.groups[fid].add(oid)
        self.begin[oid], self.cls[oid] = fid, cls

    def _leave(self, oid: int) -> None:
        b = self.begin.pop(oid)
        del self.cls[oid]
        self.groups[b].discard(oid)
        if not self.groups[b]:
            del self.groups[b]
            self.begins.remove(b)

    def _emit(self, end: int, gone: set[int]) -> list[tuple[list[int], int, int]]:
        latest = end - self.duration
        low = min((self.begin[o] for o in gone), default=None)
        if low is None or low > latest or not self.labels:
            return []
        out, ids, counts = [], [], dict.fromkeys(self.labels, 0)
        for b in self.begins:
            if b > latest:
                break
            for oid in self.groups[b]:
                ids.append(oid)
                counts[self.cls[oid]] += 1
            if b >= low and all(counts[c] >= n for c, n in self.labels.items()):
                out.append((sorted(ids), b, end - 1))
        return out

    def state(self) -> tuple:
        """Plain values to keep the pool by."""
        return (self.now, [(o, self.cls[o], b) for o, b in sorted(self.begin.items())])

    @classmethod
    def restore(cls, labels: dict[int, int], duration: int, state: tuple) -> PatternPool:
        pool = cls(labels, duration)
        pool.now, rows = state
        for oid, c, b in rows:
            pool._come(oid, c, b)
        return pool
