"""N-gram Jaccard join: documents whose sets of word shingles are alike, as connected classes.

Method: count-vector R-tree.  Tokens (shingles) are hashed into groups; the counts by group make
each set a point; the overlap of two sets is at most the sum of the coordinate minima of their
points, and at most the sum of minima with the upper corner of an R-tree node that holds one of
them.  Surviving pairs are verified on the sets.

*Where pairs meet.*  Sets with a Jaccard similarity of at least s share one of their rarest
shingles: of a set of n, the first n - ceil(s n) + 1 in an order that all sets agree on, here by
document frequency and then by hash.  Frequencies are counted over all documents: groups of documents
send the hashes they hold to buckets, which send back those that several have.  A document then
sends its point once to each bucket that one of its rarest shared shingles falls to, with those
shingles and its band of sizes.

*Join.*  In a bucket, the sets that share a shingle are joined by an R-tree over their points.  What
goes on is a spanning forest of the surviving pairs, and the components of these forests are the
blocks: documents that merely share a passage don't survive, so passages don't tie blocks together.
Long sets have more groups, about one for DENSITY shingles, so that the bounds stay as sharp; two
points of different sizes are compared in the groups of the coarser.

*Verification.*  Blocks are small but for true clusters.  In a block, an R-tree again proposes and the
sets decide, from one set to those not yet reached, so a cluster costs about one comparison a set and
not one a pair.  A shingle of more than HOT sets, or a block of more than TILE sets or TILE_SHINGLES
shingles, is cut into parts, and each pair of parts is a task of its own: no group grows without bound.

Equal sets are one point, wherever they are.  Texts are read three times and shingled twice.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as kn
from ._repeats import BLOCKS, _table, next_prime
from ._session import cut, ship, text_buckets
from .components import components

U = np.uint64
GROUPS, MOST_GROUPS, DENSITY = 64, 4096, 4
LEAF, FANOUT = 32, 16
TILE, TILE_SHINGLES = 8_000, 4_000_000
HOT = 8_000
RATIO = 1.4
MEET = 8
SALT = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and their offsets.

    A-Z are lower-cased; a text of fewer than `width` words is one shingle; without words, none.
    """
    data = kn.LOWER_ASCII[data]
    starts, ends, woff = kn.words(data, offsets)
    hashes = kn.word_hashes(data, starts, ends)
    n = len(hashes)
    room = np.repeat(woff[1:], np.diff(woff)) - np.arange(n)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(woff))
    first = np.arange(n) == woff[:-1][row] if n else np.zeros(0, bool)
    value = np.zeros(n, U)
    for j in range(width):
        part = kn.mix64(hashes[j:] + U(j + 1)) * U(0x9E3779B97F4A7C15 + 2 * j)
        inside = room > j
        value[: n - j][inside[: n - j]] += part[inside[: n - j]] if j else part[inside]
    keep = (room >= width) | first
    row, value = row[keep], kn.mix64(value[keep])
    cuts = np.searchsorted(row, np.arange(len(offsets))).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # texts are short beside a chunk: cheaper than one sort of all
        value[a:b].sort()
    once = kn.new_groups(row, value)
    row, value = row[once], value[once]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def _text_chunks(table, width: int):
    """(rows a..b, set values, set offsets) over the chunks of a table's texts."""
    data, offsets = kn.flat_text(table.column("text"))
    for a, b in kn.chunks(offsets):
        yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def _signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set."""
    out = []
    for salt in (U(0x51ED270B), U(0xB492B66F)):
        total = np.r_[U(0), np.cumsum(kn.mix64(values ^ salt), dtype=U)]
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _first_of_each(seen: set, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Which sets are not among those seen, nor before them here; seen grows by them."""
    out = np.zeros(len(s1), bool)
    for i, pair in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
        if pair not in seen:
            seen.add(pair)
            out[i] = True
    return out


def bands(n: int, percent: int) -> list[int]:
    """The bands of sizes in which a set of n takes part: its own, and those of larger partners."""
    return list(range(_band(n), _band(n * 100 // percent) + 1))


_UPPER = [1]
while _UPPER[-1] < 1 << 40:
    _UPPER.append(int(_UPPER[-1] * RATIO) + 1)


_LIMITS = np.array(_UPPER)


def _band(n: int) -> int:
    return bisect_left(_UPPER, n)


def groups_of(n: int, percent: int) -> int:
    """The number of groups of a set of n: a power of two that no set it may link with falls below by more than folding."""
    most = _UPPER[_band(n * 100 // percent)]
    return min(MOST_GROUPS, max(GROUPS, 1 << max(0, most // DENSITY - 1).bit_length()))


def prefix_length(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of the first shingles of a set hold one of every set that is like it."""
    return sizes - (-(-sizes * percent // 100)) + 1


def _code(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 40 bits that tell shingles of a bucket apart; what they confuse counts as one for all."""
    return (values % U(n)).astype(np.int64), (values // U(n)) & U((1 << 40) - 1)


FREQUENCY_KINDS = (np.int64, np.uint32, np.uint8, np.uint32)


def _send_shingles(width: int, n: int):
    def run(table):
        db, seen, parts = table.column("db")[0].as_py(), set(), []
        for _, _, values, offsets in _text_chunks(table, width):
            new = _first_of_each(seen, *_signatures(values, offsets))
            parts.append(values[np.repeat(new, np.diff(offsets))])
        values, count = np.unique(np.concatenate(parts), return_counts=True)
        bucket, code = _code(values, n)
        keys, blocks = [], []
        for to, (c, k) in kn.split_rows(bucket, code, count):
            keys.append(to)
            blocks.append(kn.pack(np.array([db]), c.astype(np.uint32), (c >> U(32)).astype(np.uint8), k.astype(np.uint32)))
        return _table(keys, blocks)

    return run


def _count(table: pa.Table) -> pa.Table:
    """For each group that sent a shingle: those that several sets have, with their frequencies."""
    bucket = table.column("key")[0].as_py()
    parts = [kn.unpack(v.as_py(), *FREQUENCY_KINDS) for v in table.column("block")]
    source = np.concatenate([np.full(len(p[1]), i, np.int32) for i, p in enumerate(parts)])
    code = np.concatenate([p[1] for p in parts]).astype(U) | (np.concatenate([p[2] for p in parts]).astype(U) << U(32))
    count = np.concatenate([p[3] for p in parts]).astype(np.int64)
    order = np.argsort(code, kind="stable")
    first = kn.new_groups(code[order])
    group = np.empty(len(code), np.int64)
    group[order] = np.cumsum(first) - 1
    total = np.bincount(group, count, minlength=1).astype(np.int64)[group]
    several = total > 1
    keys, blocks = [], []
    for i, (c, k) in kn.split_rows(source[several], code[several], np.minimum(total[several], (1 << 32) - 1)):
        keys.append(int(parts[i][0][0]))
        blocks.append(kn.pack(np.array([bucket]), c.astype(np.uint32), (c >> U(32)).astype(np.uint8), k.astype(np.uint32)))
    return _table(keys, blocks)


def _frequencies(found: pa.Table, n: int):
    """A function from shingles to their frequencies, 1 where none was sent back."""
    parts = [kn.unpack(v.as_py(), *FREQUENCY_KINDS) for v in found.column("block")] if found.num_rows else []
    if not parts:
        return lambda values: np.ones(len(values), np.int64)
    join = lambda bucket, code: kn.mix64(bucket.astype(U) * U(0x9E3779B97F4A7C15) + code)
    known = np.concatenate([join(np.full(len(p[1]), p[0][0]), p[1].astype(U) | (p[2].astype(U) << U(32))) for p in parts])
    count = np.concatenate([p[3] for p in parts])
    order = np.argsort(known)
    known, count = known[order], count[order]

    def look_up(values):
        key = join(*_code(values, n))
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return np.where(known[at] == key, count[at], 1).astype(np.int64)

    return look_up


def _prefix_keys(values: np.ndarray, offsets: np.ndarray, frequency: np.ndarray, sign: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the shingles of each set's prefix that other sets have, once a band and pair of parts."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = frequency > 1
    # the shingles that no other set has come first; room is what they leave of the prefix
    room = prefix_length(sizes, percent) - (sizes - np.bincount(row[shared], minlength=len(sizes)))
    kept = np.flatnonzero(shared & (room > 0)[row])
    kept = kept[np.lexsort((values[kept], frequency[kept], row[kept]))]  # within a set: rarest first
    rank = np.arange(len(kept)) - np.searchsorted(row[kept], row[kept])
    kept = kept[rank < room[row[kept]]]
    row, value, often = row[kept], values[kept], frequency[kept]
    low, high = np.searchsorted(_LIMITS, sizes), np.searchsorted(_LIMITS, sizes * 100 // percent)
    each = (high - low + 1)[row]
    band = kn.ranges(low[row], each)
    row, value, often = np.repeat(row, each), np.repeat(value, each), np.repeat(often, each)
    key = kn.mix64(value + kn.mix64(band.astype(U) + U(1)))
    # all senders know the frequency, so they agree on the parts
    parts = -(-often // HOT)
    own = (kn.mix64(sign[row].view(U)) % parts.astype(U)).astype(np.int64)
    other = kn.ranges(np.zeros(len(row), np.int64), parts)
    row, key, own, often = (np.repeat(x, parts) for x in (row, key, own, parts))
    tile = np.minimum(own, other) * often + np.maximum(own, other)
    return row, np.where(often > 1, kn.mix64(key + kn.mix64(tile.astype(U) + U(3))), key)


def _points(values: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The counts by group of each set, one set after the other."""
    sizes = np.diff(offsets)
    start = np.r_[0, np.cumsum(groups)]
    at = np.repeat(start[:-1], sizes) + (values >> U(8)).astype(np.int64) % np.repeat(groups, sizes)
    return np.bincount(at, minlength=start[-1]).astype(np.uint32)


POINT_KINDS = (np.int64, np.uint32, np.uint16, np.uint32, np.uint32, np.uint64)
SET_KINDS = (np.int64, np.bool_, np.int64, np.int64, np.int64, np.int64)


def _send_points(width: int, percent: int, n: int):
    """Key -1 - db: what is known of each row; other keys: points and the keys that led them there."""

    def run(table, found):
        if not table.num_rows:
            return _table([], [])
        db, ids = table.column("db")[0].as_py(), table.column("doc_id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        has, doc = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)).astype(np.int64)
        frequency, seen = _frequencies(found, n), set()
        sizes, s1, s2 = (np.zeros(len(doc), np.int64) for _ in range(3))
        points, keys = [], []
        for a, b, values, offsets in _text_chunks(table, width):
            sizes[a:b] = np.diff(offsets)
            s1[a:b], s2[a:b] = _signatures(values, offsets)
            new = has[a:b] & (sizes[a:b] > 0)
            new[new] = _first_of_each(seen, s1[a:b][new], s2[a:b][new])
            values, offsets = values[np.repeat(new, sizes[a:b])], np.r_[0, np.cumsum(sizes[a:b][new])]
            row, key = _prefix_keys(values, offsets, frequency(values), s1[a:b][new], percent)
            used, row = np.unique(row, return_inverse=True)  # sets that share nothing go nowhere
            groups = np.array([groups_of(int(m), percent) for m in sizes[a:b][new][used]], np.int64)
            at = kn.ranges(offsets[:-1][used], np.diff(offsets)[used])
            counts = _points(values[at], np.r_[0, np.cumsum(np.diff(offsets)[used])], groups)
            points += zip(s1[a:b][new][used].tolist(), sizes[a:b][new][used].tolist(), np.split(counts, np.cumsum(groups)[:-1])[: len(used)], strict=True)
            keys.append((row + len(points) - len(used), key))
        out_keys, blocks = [-1 - db], [kn.pack(doc, has, sizes, s1, s2, np.asarray(table.column("th")).astype(np.int64))]
        row, key = (np.concatenate(x) for x in zip(*keys, strict=True))
        for to, (r, k) in kn.split_rows((key % U(max(1, n // MEET))).astype(np.int64), row, key):
            order = np.argsort(r, kind="stable")
            r, k = r[order], k[order]
            cuts = np.flatnonzero(kn.new_groups(r))
            some = [points[i] for i in r[cuts].tolist()]
            sent = kn.pack(
                np.array([p[0] for p in some], np.int64), np.array([p[1] for p in some], np.uint32), np.array([len(p[2]) for p in some], np.uint16),
                np.concatenate([p[2] for p in some]), np.diff(np.r_[cuts, len(r)]).astype(np.uint32), k,
            )
            out_keys.append(to)
            blocks.append(sent)
        return _table(out_keys, blocks)

    return run


def _sets(batches):
    """The rows of what _send_points knows."""
    for batch in batches:
        for key, block in zip(batch.column("key").to_pylist(), batch.column("block"), strict=True):
            doc, has, n, s1, s2, th = kn.unpack(block.as_py(), *SET_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=~has), pa.array(np.full(len(doc), -1 - key)), *map(pa.array, (n, s1, s2, th))], ["doc_id", "db", "n_shingles", "s1", "s2", "th"])


class CountTree:
    """An R-tree over count vectors, packed by size and then by the vectors' leading coordinates."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((counts[:, 1], counts[:, 0], sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels = []
        high, least, most = self.counts, self.sizes, self.sizes
        fan = LEAF
        while True:
            cuts = np.arange(0, len(high), fan)
            high = np.maximum.reduceat(high, cuts, axis=0)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((high, least, most, fan))
            if len(high) == 1:
                break
            fan = FANOUT

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions (in packed order) whose overlap bound admits the similarity."""
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most, fan = self.levels[depth]
            bound = np.minimum(high[nodes], point).sum(axis=1)
            fits = (bound * (100 + percent) >= percent * (size + least[nodes])) & (most[nodes] * 100 >= percent * size) & (least[nodes] * percent <= 100 * size)
            nodes = nodes[fits]
            below = len(self.levels[depth - 1][0]) if depth else len(self.sizes)
            nodes = kn.ranges(nodes * fan, np.minimum((nodes + 1) * fan, below) - nodes * fan)
            if not len(nodes):
                return nodes
        bound = np.minimum(self.counts[nodes], point).sum(axis=1)
        return nodes[bound * (100 + percent) >= percent * (size + self.sizes[nodes])]


def reached(counts: np.ndarray, sizes: np.ndarray, percent: int, verified=None) -> np.ndarray:
    """A label for each point, equal for points that surviving pairs connect.

    verified(i, others): which of the others i links with; without it, the bounds decide.  From each
    point only those not yet reached are looked at: a dense cluster takes a search or two.
    """
    m = len(sizes)
    label, left = np.full(m, -1, np.int64), m
    tree = CountTree(counts, sizes)
    for seed in range(m):
        if label[seed] >= 0:
            continue
        label[seed], left, todo = seed, left - 1, [seed]
        while todo and left:
            i = todo.pop()
            near = tree.order[tree.search(counts[i], int(sizes[i]), percent)]
            near = near[label[near] < 0]
            if verified is not None and len(near):
                near = verified(i, near)
            label[near] = seed
            left -= len(near)
            todo += near.tolist()
    return label


class Forest:
    """Disjoint sets of numbers."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _folded(counts: np.ndarray, start: np.ndarray, groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The points of some rows in the groups of the coarsest of them."""
    least = int(groups[rows].min())
    out = np.zeros((len(rows), least), np.int32)
    for g in np.unique(groups[rows]).tolist():
        some = np.flatnonzero(groups[rows] == g)
        out[some] = counts[start[rows[some]][:, None] + np.arange(g)].reshape(len(some), g // least, least).sum(axis=1)
    return out


def _meet(percent: int):
    """(a, b): a spanning forest of the pairs of sets, by their first sums, that the R-trees let survive."""

    def run(table):
        parts = [kn.unpack(v.as_py(), *POINT_KINDS) for v in table.column("block")]
        sign, sizes, groups, counts, number, key = (np.concatenate([p[i] for p in parts]) for i in range(6))
        sizes, groups = sizes.astype(np.int64), groups.astype(np.int64)
        start = np.r_[0, np.cumsum(groups)[:-1]]
        # equal sets of several groups are one point
        _, first, same = np.unique(sign, return_index=True, return_inverse=True)
        point = first[same][np.repeat(np.arange(len(sign)), number)]
        order = np.lexsort((point, key))
        key, point = key[order], point[order]
        once = kn.new_groups(key, point)
        key, point = key[once], point[once]
        cuts = np.flatnonzero(kn.new_groups(key))
        ends = np.r_[cuts[1:], len(key)]
        several = ends - cuts > 1
        # near copies meet under many shingles: the same company is joined once
        names = [np.add.reduceat(kn.mix64(sign[point].view(U) ^ U(x)), cuts) for x in (5, 11)] if len(cuts) else [np.zeros(0, U)] * 2
        _, chosen = np.unique(np.stack([*names, several.astype(U)]), axis=1, return_index=True)
        forest = Forest()
        for g in chosen[several[chosen]].tolist():
            rows = point[cuts[g] : ends[g]]
            if len({forest.top(r) for r in rows.tolist()}) > 1:
                for r, x in zip(rows.tolist(), rows[reached(_folded(counts, start, groups, rows), sizes[rows], percent)].tolist(), strict=True):
                    forest.join(r, x)
        edges = [(x, r) for x in forest.parent if (r := forest.top(x)) != x]
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.Table.from_arrays([pa.array(sign[a]), pa.array(sign[b])], ["a", "b"])

    return run


def link(values: np.ndarray, offsets: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """A label for each set, equal for sets that links connect.

    side: 0 or 1 for each set; only pairs across the sides are compared then.
    """
    sizes = np.diff(offsets)
    m = len(sizes)
    if m < 2:
        return np.arange(m)
    groups = GROUPS
    while groups < MOST_GROUPS and groups * DENSITY < np.median(sizes):
        groups *= 2

    def verified(i: int, near: np.ndarray) -> np.ndarray:
        if side is not None:
            near = near[side[near] != side[i]]
        own = values[offsets[i] : offsets[i + 1]]
        linked = []
        for some in np.array_split(near, len(near) // 256 + 1):
            v = values[kn.ranges(offsets[some], sizes[some])]
            spot = np.minimum(np.searchsorted(own, v), len(own) - 1)
            common = np.bincount(np.repeat(np.arange(len(some)), sizes[some]), own[spot] == v, minlength=len(some)).astype(np.int64)
            linked.append(some[100 * common >= percent * (sizes[some] + sizes[i] - common)])
        return np.concatenate(linked)

    return reached(_points(values, offsets, np.full(m, groups)).reshape(m, groups).astype(np.int32), sizes, percent, verified)


TILE_ROWS = "block long, x int, y int, side int, doc_id long, s1 long, s2 long, text string"


def _deal(table: pa.Table, members: pa.Table) -> pa.Table:
    """The text of each member set of a block, a row for each tile that compares it."""
    out = []
    if table.num_rows and members.num_rows:
        texts = table.column("text")
        place = {pair: i for i, pair in enumerate(zip(table.column("doc_id").to_pylist(), table.column("th").to_pylist(), strict=True))}
        for m in members.to_pylist():
            text = texts[place[m["doc_id"], m["th"]]].as_py()
            for other in range(m["parts"]):
                x, y = min(m["part"], other), max(m["part"], other)
                out.append((m["block"], x, y, -1 if x == y else int(m["part"] > other), m["doc_id"], m["s1"], m["s2"], text))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    cols = list(zip(*out, strict=True)) or [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in TILE_ROWS.split(", ")])


def _compare(width: int, percent: int):
    """(a, b): a spanning forest of the verified links of a tile, by the names of sets."""

    def run(table):
        parts, lens = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for _, _, values, offsets in _text_chunks(table, width):
            lens.append(np.diff(offsets))
            parts.append(values)
        side = np.asarray(table.column("side"))
        label = link(np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(lens))], percent, side if (side >= 0).any() else None)
        doc, s1, s2 = (np.asarray(table.column(c)) for c in ("doc_id", "s1", "s2"))
        rows = np.stack([doc.view(U) ^ U(1 << 63), s1.view(U), s2.view(U)], axis=1).astype(">u8").tobytes()
        names = [rows[24 * i : 24 * i + 24] for i in range(len(doc))]
        edges = [(names[i], names[j]) for i, j in enumerate(label.tolist()) if i != j]
        return pa.Table.from_arrays([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], ["a", "b"])

    return run


def _name(doc: Column) -> Column:
    """A set's name: its least doc_id, so that names sort by it, and both sums."""
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.unhex(F.concat(digits(doc.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), digits(F.col("s1")), digits(F.col("s2"))))


def _doc_of(name: Column) -> Column:
    return (F.conv(F.hex(F.substring(name, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, and th, xxhash64 of the text.

    Two documents link when 100 * intersection >= percent * union of their shingle sets;
    component_id is the least doc_id that links reach.

    Defined cases: null, empty or wordless texts have an empty set and link with nothing; a row
    with a null doc_id links with nothing and has a null component_id; rows that share a doc_id
    are judged each by its own text; an empty table gives an empty result; other columns of docs
    are ignored, whatever their names.  percent must be 50 to 100.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    n = next_prime(text_buckets(docs))
    # one exchange of the texts for all steps; neither an id nor a text that many rows have makes a bucket heavy
    dealt = docs.withColumn("db", F.pmod(F.xxhash64("doc_id", "th"), F.lit(n)).cast("long")).groupBy("db")
    counted = dealt.applyInArrow(_send_shingles(width, n), BLOCKS).groupBy("key").applyInArrow(_count, BLOCKS)
    sent = cut(dealt.cogroup(counted.withColumnRenamed("key", "db").groupBy("db")).applyInArrow(_send_points(width, percent, n), BLOCKS))
    rows = sent.where("key < 0").mapInArrow(_sets, "doc_id long, db long, n_shingles long, s1 long, s2 long, th long")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "s1", "s2"]
    sets = full.groupBy(*same).agg(F.min(F.struct("doc_id", "db", "th")).alias("least"), (F.count("*") > 1).alias("several"))

    blocks = components(sent.where("key >= 0").groupBy("key").applyInArrow(_meet(percent), "a long, b long"))
    nodes = blocks.select(F.col("a").alias("s1"), F.col("b").alias("block")).unionByName(blocks.select(F.col("b").alias("s1"), F.col("b").alias("block")).distinct())
    members = sets.join(nodes, "s1").withColumn("salt", F.pmod("s2", F.lit(SALT)).cast("int"))
    # a tile compares the two parts of a large block that it is named by; all others are one tile
    parts = F.ceil(F.greatest(F.col("size") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int")
    sized = members.groupBy("block").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).select("block", parts.alias("parts"))
    sized = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    members = members.join(sized, ["block", "salt"])
    members = members.select("least.db", "least.doc_id", "least.th", "s1", "s2", "block", "parts", F.pmod(F.xxhash64("s1", "s2"), "parts").cast("int").alias("part"))
    tiles = dealt.cogroup(members.groupBy("db")).applyInArrow(_deal, TILE_ROWS)
    links = tiles.groupBy("block", "x", "y").applyInArrow(_compare(width, percent), "a binary, b binary")
    classes = components(links)

    found = sets.withColumn("a", _name(F.col("least.doc_id"))).join(classes, "a", "left").where("several or b is not null")
    found = found.select(*same, F.coalesce(_doc_of(F.col("b")), F.col("least.doc_id")).alias("component_id"))
    # a set that many rows have is answered once a group
    answers = full.select("db", *same).distinct().join(found, same)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(answers, ["db", *same], "left").select("doc_id", "n_shingles", own.alias("component_id"), "th")
