"""The definition of a closed co-movement pattern, in plain Python."""


def islands(points):
    """{(oid, cls, fid)} -> runs (oid, cls, b, e)."""
    out = []
    by = {}
    for oid, cls, fid in points:
        by.setdefault((oid, cls), set()).add(fid)
    for (oid, cls), fids in by.items():
        start = prev = None
        for f in sorted(fids):
            if prev is None or f != prev + 1:
                if prev is not None:
                    out.append((oid, cls, start, prev + 1))
                start = f
            prev = f
        out.append((oid, cls, start, prev + 1))
    return out


def union(segments):
    """Segments (oid, cls, b, e) of an object that overlap or touch, as one."""
    return islands({(o, c, f) for o, c, b, e in segments for f in range(b, e)})


def closed(runs, labels, duration):
    """{(ids, start, end_inclusive)}"""
    runs = [r for r in runs if r[1] in labels and r[3] - r[2] >= duration]
    out = set()
    for s in {r[2] for r in runs}:
        for e in {r[3] for r in runs}:
            if e - s < duration:
                continue
            who = [r for r in runs if r[2] <= s and r[3] >= e]
            if not any(r[2] == s for r in who) or not any(r[3] == e for r in who):
                continue
            if labels and all(sum(r[1] == c for r in who) >= n for c, n in labels.items()):
                out.add((tuple(sorted(r[0] for r in who)), s, e - 1))
    return out


def clipped(segments, lo, hi):
    return [(o, c, max(b, lo), min(e, hi)) for o, c, b, e in segments if max(b, lo) < min(e, hi)]
