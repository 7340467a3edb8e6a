"""Suffix-array dedup: bytes covered by a 50-byte string of an earlier document are removed.

Method: hash-compared suffix sort.  The suffixes that start at shared anchors (see _repeats) are
sorted, in each bucket, by a merge sort whose comparisons find the longest common extension of two
suffixes with prefix polynomial hashes and binary search: log2(50) hash tests a comparison.  The
sorted order is verified byte by byte (adjacent common extensions); on a collision the bucket is
sorted anew by the bytes.  A window t bytes before an anchor is known by its range of the sorted
suffixes (common extension of 50-t or more) and its t bytes to the left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _kernels as kn
from . import _repeats as rp

U = np.uint64
WINDOW = 50
GRAM = 24
REACH = WINDOW - GRAM


class SuffixSort:
    """Suffixes of the rows of a byte matrix, each from one column on, `size` bytes long."""

    def __init__(self, matrix: np.ndarray, prefix: np.ndarray, column: int, size: np.ndarray):
        self.matrix, self.column, self.size = matrix, column, size.astype(np.int64)
        self.prefix, self.width = prefix.ravel(), prefix.shape[1]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes x and y: binary search over equal hashes."""
        bx, by = x * self.width + self.column, y * self.width + self.column
        hx, hy = self.prefix[bx], self.prefix[by]
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            equal = self.prefix[bx + mid] - hx == self.prefix[by + mid] - hy
            lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
        return lo

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.common(x, y)
        at = self.column + n
        last = self.matrix.shape[1] - 1
        cx = np.where(n < self.size[x], self.matrix[x, np.minimum(at, last)].astype(np.int16), -1)
        cy = np.where(n < self.size[y], self.matrix[y, np.minimum(at, last)].astype(np.int16), -1)
        return cx <= cy if or_equal else cx < cy

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by (group, suffix), and the common extension with the one before, 0 in a new group."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        begins = np.flatnonzero(kn.new_groups(g))
        ends = np.r_[begins[1:], len(g)]
        which = np.repeat(np.arange(len(begins)), ends - begins)
        width, largest = 1, int((ends - begins).max(initial=0))
        while width < largest:
            # within each group, runs of `width` are sorted; merge them two by two
            rank = np.arange(len(g)) - begins[which]
            run = rank // width
            own = begins[which] + run * width
            sibling = begins[which] + (run ^ 1) * width
            move = np.flatnonzero(sibling < ends[which])
            lo, top = sibling[move], np.minimum(sibling[move] + width, ends[which[move]])
            left = (run[move] & 1) == 0
            base = lo.copy()
            hi = top.copy()
            x = order[move]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                y = order[mid]
                # how many of the sibling go before x: ties keep the left run first
                goes = np.where(left[open_], self.before(y, x[open_], False), self.before(y, x[open_], True))
                lo[open_[goes]] = mid[goes] + 1
                hi[open_[~goes]] = mid[~goes]
            pair = np.minimum(own[move], sibling[move])
            place = pair + (move - own[move]) + (lo - base)
            out = order.copy()
            out[place] = x
            order = out
            width *= 2
        return self.verified(order, group)

    def verified(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lcp, sound = self._adjacent(order, group)
        if not sound:
            cols = [np.where(np.arange(self.matrix.shape[1] - self.column) < self.size[:, None], self.matrix[:, self.column :].astype(np.int16), -1)[:, i] for i in range(self.matrix.shape[1] - self.column)]
            order = np.lexsort((*cols[::-1], group))
            lcp, _ = self._adjacent(order, group)
        return order, lcp

    def _adjacent(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common extensions by the bytes, and whether neighbours are in order."""
        lcp = np.zeros(len(order), np.int64)
        if len(order) < 2:
            return lcp, True
        a, b = order[:-1], order[1:]
        span = self.matrix.shape[1] - self.column
        cols = np.arange(span)
        x = np.where(cols < self.size[a][:, None], self.matrix[a, self.column :].astype(np.int16), -1)
        y = np.where(cols < self.size[b][:, None], self.matrix[b, self.column :].astype(np.int16), -1)
        differ = x != y
        some = differ.any(axis=1)
        at = np.where(some, differ.argmax(axis=1), span)
        at = np.minimum(at, np.minimum(self.size[a], self.size[b]))
        inside = group[a] == group[b]
        lcp[1:] = np.where(inside, at, 0)
        pick = np.minimum(at, span - 1)
        rows = np.arange(len(a))
        sound = ~(inside & some) | (x[rows, pick] <= y[rows, pick])
        return lcp, bool(sound.all())


class ByteResolver:
    """Windows by suffix sort; the spans go back."""

    window, gram = WINDOW, GRAM

    def reported(self, n, stretches, flat):
        return rp.spans_of(n, stretches.doc, stretches.tag, stretches.begin, stretches.end)

    def bytes_of(self, flat, start, length, begin, end):
        return start + begin, start + end

    def located(self, texts, found, copy):
        return rp.covered(texts, found)

    def __call__(self, group, doc, left, right, flat, start, length):
        m = len(doc)
        offset = np.arange(REACH + WINDOW, dtype=np.int32)[None, :] - (REACH - left)[:, None].astype(np.int32)
        outside = (offset < 0) | (offset >= length[:, None])
        matrix = flat[np.minimum(start[:, None] + np.maximum(offset, 0), len(flat) - 1)]
        matrix[outside] = 0
        prefix = rp.row_prefix(kn.BYTE_VALUE[matrix])
        order, lcp = SuffixSort(matrix, prefix, REACH, right).sort(group)
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)

        def ranges_at(t):
            return np.cumsum(lcp < WINDOW - t)[place]

        return rp.windows_seen(matrix, prefix, REACH, WINDOW, doc, left, right, ranges_at, lambda t: prefix[:, REACH] - prefix[:, REACH - t])


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPAN)])


def _result(text: memoryview, spans, copy: bool):
    n, removed, at, pairs, digest = len(text), 0, 0, [], hashlib.sha256()
    if copy and n >= WINDOW:
        spans = np.array([0]), np.array([n])
    if spans is not None:
        for s, e in zip(*(x.tolist() for x in spans), strict=True):
            digest.update(text[at:s])
            at = e
            removed += e - s
            pairs.append({"start": s, "end": e})
    digest.update(text[at:])
    return n, removed, len(pairs), digest.hexdigest(), pairs


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): what a 50-byte repeat of an earlier document removes.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans.

    Defined cases: null text counts as empty; texts under 50 bytes lose nothing; a row with a null
    doc_id is neither earlier nor later than any other and keeps all; rows that repeat a doc_id are
    judged each, against smaller ids only; an empty table gives an empty result; other columns of
    docs are ignored, whatever their names.
    """
    return rp.remove_repeats(docs, "bytes", ByteResolver(), _result, SCHEMA, ARROW)
