"""Nearest neighbours of a query set: block matrix join with int8 product tiles.

Candidates and queries are dealt into blocks, and each pair of blocks is one tile, found by an
equi-join on the tile's name.  In a tile, vectors are quantised to int8 with a scale of their own;
one matrix product of the int8 values (exact in float32 for up to 1,000 components, in float64
beyond) gives every approximate distance.  With r the norm of a vector's quantisation error, the
true distance is within r(query) + r(candidate) of it.  Candidates whose lower bound exceeds the
k-th smallest upper bound are out; the others are recomputed in double precision.  Each tile gives
k rows a query in order, and heaps merge these lists, LISTS of them at a time, in a tree.  Nothing is
lost: recall is 1.

Block sizes bound what a task holds; their number follows the tables.  A vector travels once for each
block of the other side: with n candidates and m queries, m / QUERIES copies of each candidate and
n / CANDIDATES of each query.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as kn
from ._session import ship, shuffle_partitions

CANDIDATES = QUERIES = 65_536
#: A table that is smaller than a block for each partition is dealt into blocks of this size.
SMALL = 2_048
#: Queries whose products with a block of candidates are held at once.
AT_ONCE = 64
#: Queries of a merging task, and lists that it merges for each.
MERGED, LISTS = 256, 64
SCHEMA = "x long, query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null, not all zero, every component present and finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and norms of what they miss (rounded up)."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return q, scale, lost


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed component by component."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - y[:, j]
        total += d * d
    return np.sqrt(total)


def tile(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int):
    """Rows (query, candidate, distance): the k nearest of the tile for each query."""
    kind = np.float32 if vectors.shape[1] <= 1000 else np.float64
    cq, cs, cl = quantise(vectors)
    qq, qs, ql = quantise(queries)
    cn = (cq.astype(np.int64) ** 2).sum(axis=1) * cs**2
    qn = (qq.astype(np.int64) ** 2).sum(axis=1) * qs**2
    right = cq.astype(kind).T
    for a in range(0, len(qids), AT_ONCE):
        b = slice(a, a + AT_ONCE)
        product = qq[b].astype(kind) @ right
        near = np.sqrt(np.maximum(qn[b, None] + cn - 2 * qs[b, None] * cs * product.astype(np.float64), 0))
        slack = (ql[b, None] + cl) * (1 + 1e-9) + 1e-9 * (1 + near)
        slack += np.sqrt(1e-13 * (qn[b, None] + cn))  # cancellation in the sum above
        high = near + slack
        low = near - slack
        own = qids[b][:, None] == ids[None, :]
        high[own] = low[own] = np.inf
        if len(ids) > k:
            limit = np.partition(high, k - 1, axis=1)[:, k - 1 : k]
        else:
            limit = np.full((len(high), 1), np.inf)
        row, col = np.nonzero((low <= limit) & ~own)
        score = exact(queries[a + row], vectors[col])
        order = np.lexsort((ids[col], score, row))
        row, col, score = row[order], col[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        top = rank < k
        yield qids[b][row[top]], ids[col[top]], score[top]


def _matrix(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors by number of components."""
    ids = np.asarray(table.column("vec_id"))
    lists = table.column("vector").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lens = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten()).astype(np.float64)
    ends = np.cumsum(lens)
    out = {}
    for n in np.unique(lens):
        pick = np.flatnonzero(lens == n)
        out[int(n)] = ids[pick], flat[(ends[pick] - n)[:, None] + np.arange(n)]
    return out


def _tiles(k: int):
    def run(candidates, queries):
        parts = []
        if candidates.num_rows and queries.num_rows:
            have = _matrix(candidates)
            for n, (qids, vectors) in _matrix(queries).items():
                if n in have:
                    parts += tile(*have[n], qids, vectors, k)
        cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        x = candidates.column("x")[0].as_py() if parts else 0
        return pa.Table.from_arrays([pa.array(np.full(len(cols[0]), x)), *map(pa.array, cols)], ["x", "query_id", "vec_id", "score"])

    return run


def _merge(k: int):
    """Of each query, the first k of the merged lists of all x of the group."""

    def run(table):
        x, q, v, s = (np.asarray(table.column(c)) for c in ("x", "query_id", "vec_id", "score"))
        order = np.lexsort((v, s, x, q))
        x, q, v, s = x[order], q[order], v[order].tolist(), s[order].tolist()
        cuts = np.flatnonzero(kn.new_groups(q, x))
        lists: dict[int, list] = {}
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(q)], strict=True):
            lists.setdefault(int(q[a]), []).append(zip(s[a:b], v[a:b], strict=True))
        group = int(x[0]) // LISTS if len(x) else 0
        rows = [(group, a, c, b, i + 1) for a, found in lists.items() for i, (b, c) in enumerate(islice(heapq.merge(*found), k))]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["x", "query_id", "vec_id", "score", "rank"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of vectors (vec_id, vector) to each of queries (vec_id, vector): query_id, rank, vec_id, score.

    Euclidean distance in double precision on the vectors as given, nearest first, ties to the
    smaller vec_id.  A query's own vec_id is no candidate of it.

    Defined cases: vectors that are null, all zero or hold null or non-finite components, and rows
    with a null vec_id, take no part on either side; vectors of another length are no candidates; with fewer than k
    candidates all are returned; of rows that share a vec_id each counts as a candidate, and as
    queries equal ones count once and others together; an empty side gives an empty result; other
    columns are ignored.
    """
    ship(vectors.sparkSession)
    pick = [F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")]
    vectors, queries = (df.select(*pick).where(usable(F.col("vector")) & F.col("vec_id").isNotNull()) for df in (vectors, queries))
    queries = queries.distinct()
    count = vectors.count()
    across = max(1, -(-count // CANDIDATES), min(shuffle_partitions(vectors.sparkSession), -(-count // SMALL)))
    down = max(1, -(-queries.count() // QUERIES))
    deal = lambda salt, n: F.pmod(F.xxhash64("vec_id", "vector", F.lit(salt)), F.lit(n)).cast("long")
    named = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = vectors.select("*", deal(1, across).alias("x"), named(down).alias("y"))
    right = queries.select("*", named(across).alias("x"), deal(2, down).alias("y"))
    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(_tiles(k), SCHEMA)
    found = found.withColumn("rank", F.lit(0))
    while True:
        group = F.expr(f"x div {LISTS}"), F.pmod(F.xxhash64("query_id"), F.lit(max(1, down * QUERIES // MERGED)))
        found = found.groupBy(*group).applyInArrow(_merge(k), SCHEMA + ", rank int")
        across = -(-across // LISTS)
        if across == 1:
            return found.select("query_id", "rank", "vec_id", "score")
