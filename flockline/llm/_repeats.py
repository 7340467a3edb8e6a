"""Repeated windows across documents: the distributed frame of suffix_dedup and phrase_dedup.

A window is N consecutive units (bytes or words) of one document.  A unit goes when some window
that covers it also starts in a document with a smaller id.  Steps, all in one lazy plan:

0. *Copies.*  Of equal texts the one with the least id stands for all in steps 1 to 4; texts are
   equal where their SHA-256 is.
1. *Anchors.*  Each document's windows choose their least K-gram (winnowing).  Equal windows
   choose equal anchors, so a repeated window is always seen through a shared anchor.
2. *Shared anchors.*  Anchor hashes meet by bucket; those of two documents or more are reported
   back.  Of an anchor that a group already holds twice, only the least document travels, so a
   passage of a third of all documents arrives once a group and not once a document.
3. *Contexts.*  Each document sends the N-K units before and N units after its shared anchors,
   again once a group for equal contexts; the others are settled there and then.
4. *Resolution*, by the operator's own method: which windows of a context start in a smaller
   document.  What goes back to a group is the operator's choice, too: spans, or the passages.
5. *Application* to the documents.

Rows travel as compressed blocks a bucket.  The number of buckets follows the bytes of text, so a
group of a grouped step stays near GROUP_BYTES.  The documents are dealt by id in one exchange
that steps 1, 3 and 5 share; rows without an id by their text.  Hashes only propose: every removal
but that of a copy compares the units themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as kn
from ._session import cut, ship, text_buckets

U = np.uint64
BLOCKS = "key long, block binary"
_KNOWN = np.uint32(1 << 31)
#: Contexts that a resolver gets at once; those of one phrase stay together.
CONTEXTS = 16_384
SPAN_KINDS = (np.int64, np.uint32, np.uint32, np.uint32)


def _blocks(keys: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], ["key", "block"])


def _table(keys: list[int], blocks: list[bytes]) -> pa.Table:
    return pa.Table.from_batches([_blocks(keys, blocks)])


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    """pmod(doc, n), as the plan deals the documents; n is a prime, so regular ids spread too."""
    return np.mod(doc, n)


def next_prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _row_key(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return kn.mix64(doc.view(U)) + tag.astype(U) * U(0x9E3779B97F4A7C15)


class Units:
    """Bytes or words of one chunk of texts."""

    def __init__(self, kind: str, data: np.ndarray, offsets: np.ndarray):
        self.data, self.kind = data, kind
        if kind == "bytes":
            self.starts = self.ends = None
            self.offsets = offsets
            self.values = kn.BYTE_VALUE[data]
        else:
            self.starts, self.ends, self.offsets = kn.words(data, offsets)
            self.values = kn.word_hashes(data, self.starts, self.ends)

    def slices(self, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes from unit `first` to before unit `after`."""
        if self.kind == "bytes":
            return first, after
        return self.starts[first], self.ends[after - 1]


class Texts:
    """The rows of a group: ids, texts, and what tells apart rows that share an id."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
        self.has = np.asarray(ids.is_valid())
        self.doc = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.data, self.offsets = kn.flat_text(table.column("text"))
        view, offsets = memoryview(np.ascontiguousarray(self.data)), self.offsets.tolist()
        self.crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint32, len(self.doc))
        _, same, count = np.unique(self.doc, return_inverse=True, return_counts=True)
        # a group holds all rows of an id; the digest is named only where it is needed
        self.tag = np.where(count[same] > 1, self.crc, 0).astype(np.uint32)

    def __len__(self):
        return len(self.doc)

    def copies(self, found: pa.Table) -> np.ndarray:
        """Rows that are exact copies of a document with a smaller id."""
        if not found.num_rows:
            return np.zeros(len(self), bool)
        known = _row_key(np.asarray(found.column("copy")).astype(np.int64), np.asarray(found.column("crc")))
        return self.has & np.isin(_row_key(self.doc, self.crc), known)

    def units(self, kind: str):
        for a, b in kn.chunks(self.offsets):
            o = self.offsets[a : b + 1]
            yield a, b, Units(kind, self.data[o[0] : o[-1]], o - o[0])


def _anchors(kind: str, window: int, k: int, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs, copies):
        if not docs.num_rows:
            return _table([], [])
        texts = Texts(docs)
        searched = texts.has & ~texts.copies(copies)
        doc = texts.doc
        rows, grams, places = [], [], []
        for a, _, units in texts.units(kind):
            at, h = kn.winnow(units.values, units.offsets, window, k)
            row = np.searchsorted(units.offsets, at, "right") - 1
            keep = searched[row + a]
            row, at = row[keep], at[keep]
            rows.append((row + a).astype(np.int32))
            grams.append(h[keep])
            places.append((at - units.offsets[row]).astype(np.uint32))
        row, h, at = np.concatenate(rows), np.concatenate(grams), np.concatenate(places)
        order = np.lexsort((doc[row], h))
        row, h, at = row[order], h[order], at[order]
        first = kn.new_groups(h)
        group = np.cumsum(first) - 1
        least = doc[row][first]
        twice = (np.bincount(group, doc[row] != least[group], minlength=len(least)) > 0)[group]
        keys, blocks = [], []
        for key, (d, p) in kn.split_rows(doc_bucket(doc[row[twice]], n), doc[row[twice]], at[twice]):
            keys.append(-key - 1)
            blocks.append(kn.pack(d, p))
        sent = ~twice | first
        row, h, at = row[sent], h[sent], np.where(twice[sent], at[sent] | _KNOWN, at[sent])
        order = np.argsort(row, kind="stable")
        row, h, at = row[order], h[order], at[order]
        for key, (r, g, p) in kn.split_rows((h % U(n)).astype(np.int64), row, h // U(n), at):
            cut = np.flatnonzero(kn.new_groups(r))
            keys.append(key)
            blocks.append(kn.pack(doc[r[cut]], np.diff(np.r_[cut, len(r)]).astype(np.uint32), g.astype(np.uint32), (g >> U(32)).astype(np.uint16), p))
        return _table(keys, blocks)

    return run


def _shared(n: int) -> Callable[[pa.Table], pa.Table]:
    def run(table):
        key = table.column("key")[0].as_py()
        if key < 0:
            return table
        parts = [kn.unpack(v.as_py(), np.int64, np.uint32, np.uint32, np.uint16, np.uint32) for v in table.column("block")]
        doc = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        low, high, at = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        h = low.astype(U) | (high.astype(U) << U(32))
        order = np.argsort(h, kind="stable")
        h, doc, at = h[order], doc[order], at[order]
        first = kn.new_groups(h)
        group = np.cumsum(first) - 1
        many = (np.bincount(group, doc != doc[first][group]) > 0)[group]
        many &= at < _KNOWN
        keys, blocks = [], []
        for db, (d, p) in kn.split_rows(doc_bucket(doc[many], n), doc[many], at[many]):
            keys.append(-db - 1)
            blocks.append(kn.pack(d, p))
        return _table(keys, blocks)

    return run


def settle_equal(key: np.ndarray, doc: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts with equal keys and, compared byte by byte, equal bytes: (settled mask, head).

    Settled: an equal context, the head, has a smaller document.
    """
    order = np.lexsort((doc, key))
    first = kn.new_groups(key[order])
    head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    rep = np.empty(len(key), np.int64)
    rep[order] = head
    later = np.flatnonzero((doc > doc[rep]) & (length == length[rep]))
    settled = np.zeros(len(key), bool)
    for part in np.array_split(later, max(1, int(length[later].sum() >> 20))):
        same = flat[kn.ranges(start[part], length[part])] == flat[kn.ranges(start[rep[part]], length[part])]
        if len(part):
            settled[part] = np.logical_and.reduceat(same, np.r_[0, np.cumsum(length[part])[:-1]])
    return settled, rep


def spans_of(n: int, doc, tag, start, end) -> tuple[list[int], list[bytes]]:
    keys, blocks = [], []
    for db, cols in kn.split_rows(doc_bucket(doc, n), doc, tag, start.astype(np.uint32), end.astype(np.uint32)):
        keys.append(-db - 1)
        blocks.append(kn.pack(*cols))
    return keys, blocks


CONTEXT_KINDS = (np.int64, np.uint32, np.uint32, np.uint16, np.uint32, np.uint8)


@dataclass
class Stretches:
    """Repeated stretches of documents: units [begin, end), bytes [first, last) of some array, and
    the greatest `after` of which it is known that all their windows start in it or in smaller ones."""

    doc: np.ndarray
    tag: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    after: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def of(self, rows: np.ndarray) -> Stretches:
        return Stretches(*(getattr(self, f.name)[rows] for f in fields(self)))

    @staticmethod
    def joined(parts: list[Stretches]) -> Stretches:
        return Stretches(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Stretches)))


def _contexts(kind: str, n: int, resolver) -> Callable[[pa.Table, pa.Table], pa.Table]:
    window, k = resolver.window, resolver.gram
    reach = window - k

    def run(docs, found):
        if not docs.num_rows or not found.num_rows:
            return _table([], [])
        d, p = kn.unpack_all(found.column("block"), np.int64, np.uint32)
        order = np.lexsort((p, d))
        d, p = d[order], p[order].astype(np.int64)
        once = kn.new_groups(d, p)
        d, p = d[once], p[once]
        texts = Texts(docs)
        lo, hi = np.searchsorted(d, texts.doc, "left"), np.searchsorted(d, texts.doc, "right")
        hi[~texts.has] = lo[~texts.has]
        parts = []
        for a, b, units in texts.units(kind):
            count = hi[a:b] - lo[a:b]
            row = np.repeat(np.arange(b - a), count)
            base, limit = units.offsets[row], units.offsets[row + 1]
            at = p[kn.ranges(lo[a:b], count)] + base
            first, after = np.maximum(base, at - reach), np.minimum(limit, at + window)
            # rows that share an id get each other's anchors: some lie beyond their end
            ok = (at + k <= limit) & (after - first >= window)
            row, at, base, first, after = row[ok], at[ok], base[ok], first[ok], after[ok]
            if not len(at):
                continue
            prefix = kn.prefix_hash(units.values)
            gram = kn.mix64(kn.span_hash(prefix, at, at + k))
            start, end = units.slices(first, after)
            raw = prefix if kind == "bytes" else kn.prefix_hash(kn.BYTE_VALUE[units.data])
            whole = kn.mix64(kn.span_hash(raw, start, end)) + (at - first).astype(U)
            parts.append(((row + a).astype(np.int32), (at - base).astype(np.uint32), gram % U(n), (at - first).astype(np.uint16), (after - at).astype(np.uint16), start + texts.offsets[a], (end - start).astype(np.int32), whole))
        if not parts:
            return _table([], [])
        row, at, bucket, left, right, start, length, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        settled, head = settle_equal(whole, texts.doc[row], texts.data, start, length)
        stretch = Stretches(texts.doc[row], texts.tag[row], (at - left).astype(np.int64), (at + right).astype(np.int64), texts.doc[row[head]], start, start + length)
        keys, blocks = resolver.reported(n, stretch.of(settled), texts.data)
        for to, (i,) in kn.split_rows(bucket[~settled].astype(np.int64), np.flatnonzero(~settled)):
            body = texts.data[kn.ranges(start[i], length[i].astype(np.int64))]
            keys.append(to)
            blocks.append(kn.pack(texts.doc[row[i]], texts.tag[row[i]], at[i], left[i], length[i].astype(np.uint32), body))
        return _table(keys, blocks)

    return run


def _resolved(kind: str, n: int, resolver) -> Callable[[pa.Table], pa.Table]:
    def run(table):
        key = table.column("key")[0].as_py()
        if key < 0:
            return table
        doc, tag, at, left, length, flat = kn.unpack_all(table.column("block"), *CONTEXT_KINDS)
        at, left, length = at.astype(np.int64), left.astype(np.int64), length.astype(np.int64)
        start = np.r_[0, np.cumsum(length)[:-1]]
        whole = np.empty(len(doc), U)
        gram = np.empty(len(doc), U)
        right = np.empty(len(doc), np.int64)
        cuts = np.r_[start, length.sum()]
        for a, b in kn.chunks(cuts):
            units = Units(kind, flat[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            prefix = kn.prefix_hash(units.values)
            o = units.offsets[:-1]
            whole[a:b] = kn.mix64(kn.span_hash(prefix, o, units.offsets[1:])) + left[a:b].astype(U)
            gram[a:b] = kn.span_hash(prefix, o + left[a:b], o + left[a:b] + resolver.gram)
            right[a:b] = np.diff(units.offsets) - left[a:b]
        settled, head = settle_equal(whole, doc, flat, start, length)
        lone = ~settled
        _, group = np.unique(gram, return_inverse=True)
        least = np.full(len(doc), np.iinfo(np.int64).max)
        np.minimum.at(least, group[lone], doc[lone])
        several = np.bincount(group[lone], doc[lone] != least[group[lone]], minlength=len(doc)) > 0
        todo = np.flatnonzero(lone & several[group])
        todo = todo[np.argsort(group[todo], kind="stable")]
        out = [Stretches(doc, tag, at - left, at + right, doc[head], start, start + length).of(settled)]
        begins = np.r_[np.flatnonzero(kn.new_groups(group[todo])), len(todo)]
        a = 0
        while a < len(begins) - 1:
            b = max(a + 1, int(np.searchsorted(begins, begins[a] + CONTEXTS, "right")) - 1)
            rows = todo[begins[a] : begins[b]]
            low, high, after = resolver(group[rows], doc[rows], left[rows], right[rows], flat, start[rows], length[rows])
            hit = low >= 0
            rows, low, high, after = rows[hit], low[hit], high[hit], after[hit]
            # the bytes of a stretch within its context
            first, last = resolver.bytes_of(flat, start[rows], length[rows], left[rows] - high, left[rows] - low + resolver.window)
            out.append(Stretches(doc[rows], tag[rows], at[rows] - high, at[rows] - low + resolver.window, after, first, last))
            a = b
        return _table(*resolver.reported(n, Stretches.joined(out), flat))

    return run


def classes(group: np.ndarray, key: np.ndarray, doc: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows that share (group, key) with a smaller document, and that row of the least one."""
    rows = np.flatnonzero(usable)
    order = rows[np.lexsort((doc[rows], key[rows], group[rows]))]
    if not len(order):
        return order, order
    first = kn.new_groups(group[order], key[order])
    rep = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = doc[order] > doc[rep]
    return order[later], rep[later]


def windows_seen(matrix: np.ndarray, prefix: np.ndarray, reach: int, window: int, doc, left, right, group_at, key_at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context, the least and greatest t so that its window t units before the anchor repeats,
    and the greater of the least documents that those two windows start in.

    group_at(t) and key_at(t) give what equal windows share.  Every match is compared unit by unit;
    where a hash has misled, that t is decided anew by the units alone.  All windows of a context
    hold its anchor, so the repeated ones cover one stretch.
    """
    low, high = np.full(len(doc), -1, np.int64), np.full(len(doc), -1, np.int64)
    lowest, highest = doc.copy(), doc.copy()
    for t in range(reach + 1):
        usable = (left >= t) & (right >= window - t)
        if np.count_nonzero(usable) < 2:
            continue
        cols = slice(reach - t, reach - t + window)
        later, rep = classes(group_at(t), key_at(t), doc, usable)
        if len(later) and not np.array_equal(matrix[later, cols], matrix[rep, cols]):
            _, exact = np.unique(matrix[:, cols], axis=0, return_inverse=True)
            later, rep = classes(np.zeros(len(doc), np.int64), exact.ravel(), doc, usable)
        new = low[later] < 0
        low[later[new]], lowest[later[new]] = t, doc[rep[new]]
        high[later], highest[later] = t, doc[rep]
    return low, high, np.maximum(lowest, highest)


def row_prefix(values: np.ndarray) -> np.ndarray:
    """Prefix hashes along each row; spans over the same columns compare without shifting."""
    up, _ = kn.powers(values.shape[1])
    out = np.zeros((values.shape[0], values.shape[1] + 1), U)
    np.cumsum(values * up[: values.shape[1]], axis=1, out=out[:, 1:], dtype=U)
    return out


def covered(texts: Texts, found: pa.Table):
    """For each row, its merged spans (starts, ends) or None; unit positions."""
    d, t, s, e = kn.unpack_all(found.column("block"), *SPAN_KINDS) if found.num_rows else (np.zeros(0, k) for k in SPAN_KINDS)
    key = _row_key(d, t)
    order = np.lexsort((s, key))
    key, s, e = key[order], s[order].astype(np.int64), e[order].astype(np.int64)
    own = _row_key(texts.doc, texts.tag)
    lo, hi = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
    hi[~texts.has] = lo[~texts.has]
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if a == b:
            yield None
            continue
        top = np.maximum.accumulate(e[a:b])
        new = np.r_[True, s[a + 1 : b] > top[:-1]]
        yield s[a:b][new], top[np.r_[np.flatnonzero(new)[1:] - 1, b - a - 1]]


def _applied(resolver, result, schema: pa.Schema):
    """result(bytes of a text, spans or None, whether it is a copy) gives the columns after doc_id."""

    def run(docs, found):
        rows = []
        if docs.num_rows:
            texts = Texts(docs)
            copy = texts.copies(found.filter(found.column("crc").is_valid()))
            spans = resolver.located(texts, found.filter(found.column("block").is_valid()), copy)
            view, offsets = memoryview(np.ascontiguousarray(texts.data)), texts.offsets.tolist()
            rows = [(d if h else None, *result(view[a:b], s, c)) for d, h, a, b, s, c in zip(texts.doc.tolist(), texts.has.tolist(), offsets[:-1], offsets[1:], spans, copy.tolist(), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def copies_of(docs: DataFrame) -> DataFrame:
    """db, copy and crc of the rows of docs (doc_id, text, db) whose text has a smaller id, too."""
    names = cut(docs.where("doc_id is not null and text is not null").select("db", "doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), F.unhex(F.sha2("text", 256)).alias("name")))
    # a text that many documents have meets once a group
    led = names.groupBy("db", "name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    first = led.groupBy("name").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").drop("last")
    known = led.join(first, "name").select("db", "name", "first")
    return names.join(known, ["db", "name"]).where("doc_id > first").select("db", F.col("doc_id").alias("copy"), "crc")


def remove_repeats(docs: DataFrame, kind: str, resolver, result, schema: str, arrow_schema: pa.Schema) -> DataFrame:
    """docs (doc_id, text) through the five steps; result() makes each document's columns."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = next_prime(text_buckets(docs))
    docs = docs.withColumn("db", F.coalesce(F.pmod("doc_id", F.lit(n)), F.pmod(F.xxhash64("text"), F.lit(n))).cast("long"))
    copies = copies_of(docs)
    dealt = docs.groupBy("db")
    back = lambda df: df.withColumn("db", -F.col("key") - 1)
    anchors = dealt.cogroup(copies.groupBy("db")).applyInArrow(_anchors(kind, resolver.window, resolver.gram, n), BLOCKS)
    shared = anchors.groupBy("key").applyInArrow(_shared(n), BLOCKS)
    contexts = dealt.cogroup(back(shared).groupBy("db")).applyInArrow(_contexts(kind, n, resolver), BLOCKS)
    reports = contexts.groupBy("key").applyInArrow(_resolved(kind, n, resolver), BLOCKS)
    found = back(reports).select("db", "block", F.lit(None).cast("long").alias("copy"), F.lit(None).cast("long").alias("crc"))
    found = found.unionByName(copies.withColumn("block", F.lit(None).cast("binary")))
    return dealt.cogroup(found.groupBy("db")).applyInArrow(_applied(resolver, result, arrow_schema), schema)
