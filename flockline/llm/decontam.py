"""Benchmark decontamination: BM25 inverted index of test items, searched with block-max WAND.

An item's question (the first two thirds) and answer (the rest) must both be found in the document:
of the distinct word 5-grams of each, VERIFIED at least, anywhere in it.

The index is over the benchmark, which is small: ITEM_WORDS bounds what is broadcast (arrays of about
64 bytes a word), and a larger benchmark is dealt into parts of that size, each searched by all
documents.  What is found does not depend on the parts: weights decide only what is looked at.  Questions and answers
are entered as sections of their own; terms are their 5-grams.  A section's threshold is the sum of
its least scores, of as many terms as VERIFIED asks for: no document that holds so many of them
scores less, so retrieval loses nothing that verification would accept, whatever the weights.
Sections are numbered by their thresholds and cut into blocks, so that those of a block have like
thresholds; for each term and block, the greatest score that a posting there can give is kept.

Every document is a query.  For all documents of a chunk at once, the block maxima of each one's
distinct terms are summed, block by block; a block whose sum does not reach its least threshold is
skipped.  In the others, WAND moves a pivot over the block's postings and returns every section that
reaches its own threshold.  Last, items all of whose sections were returned are verified.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as kn
from ._session import ship

U = np.uint64
K1, B = 1.2, 0.75
BLOCK, BLOCKS = 4, 64
GRAM = 5
VERIFIED = 0.6
ITEM_WORDS = 1_000_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, and word offsets: letters, digits and bytes beyond ASCII, lower case."""
    from .toxicity import TOKEN_BYTES

    data = TOKEN_BYTES[data]
    starts, ends, woff = kn.words(data, offsets)
    return kn.word_hashes(data, starts, ends), woff


class Index:
    """BM25 over the questions and answers of items.  Inputs: item ids and their words' hashes."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [i for i, w in items if len(w)]
        texts = [w for _, w in items if len(w)]
        halves = [self.split(w) for w in texts]
        self.questions, self.answers = [grams(q) for q, _ in halves], [grams(a) for _, a in halves]
        # of an item too short to be split, question and answer are one section
        sections = [(n, runs(h)) for n, (w, pair) in enumerate(zip(texts, halves, strict=True)) for h in (pair if len(w) >= 2 * GRAM else pair[:1])]
        self.parts = Counter(n for n, _ in sections)
        count = len(sections)
        mean = sum(len(g) for _, g in sections) / max(1, count)
        lengths = np.array([len(g) for _, g in sections], np.int64)
        every = np.concatenate([g for _, g in sections]) if sections else np.zeros(0, U)
        self.terms, term = np.unique(every, return_inverse=True)
        # a posting for each distinct term of a section, by section
        number, tf = np.unique(np.repeat(np.arange(count), lengths) * max(1, len(self.terms)) + term, return_counts=True)
        section, term = number // max(1, len(self.terms)), number % max(1, len(self.terms))
        held = np.bincount(term, minlength=len(self.terms))
        # a positive form of the inverse document frequency
        idf = np.log(1 + (count - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * lengths / mean) if count else lengths
        score = idf[term] * tf * (K1 + 1) / (tf + norm[section])
        own = np.zeros(count)
        cuts = np.searchsorted(section, np.arange(count + 1))
        for i in range(count):
            some = np.sort(score[cuts[i] : cuts[i + 1]])
            own[i] = some[: math.ceil(VERIFIED * len(some) - 1e-9)].sum()
        order = np.lexsort((np.arange(count), own))
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        self.owner = [sections[i][0] for i in order.tolist()]
        self.threshold = own[order]
        self.size = max(BLOCK, -(-count // BLOCKS))
        self.least = self.threshold[:: self.size]
        # postings by term and place
        order = np.lexsort((place[section], term))
        term, self.places, self.scores = term[order], place[section][order], score[order]
        self.begin = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # the greatest score of each pair of a term and a block that has postings, by term
        pair = term * len(self.least) + self.places // self.size
        first = np.flatnonzero(kn.new_groups(pair))
        self.pairs, self.best = pair[first], np.maximum.reduceat(self.scores, first) if len(first) else self.scores
        self.from_ = first  # each pair's first posting
        self.first = np.searchsorted(self.pairs, np.arange(len(self.terms) + 1) * len(self.least))

    @staticmethod
    def split(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Question and answer: the first two thirds and the rest, each of a gram at least if there is one."""
        if len(w) < 2 * GRAM:
            return w, w
        at = min(max(GRAM, -(-2 * len(w) // 3)), len(w) - GRAM)
        return w[:at], w[at:]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each gram, -1 for none."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, terms: list[int], block: int) -> list[int]:
        """The block's sections whose score over distinct terms reaches their threshold, by WAND."""
        least = self.least[block] * (1 - 1e-6)
        pairs = np.array(terms, np.int64) * len(self.least) + block
        places = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        # of each term with postings in the block: those postings, the place in them, the greatest score
        cursors = []
        for p in places[self.pairs[places] == pairs].tolist():
            a, b = int(self.from_[p]), int(self.from_[p + 1]) if p + 1 < len(self.from_) else len(self.places)
            ids = self.places[a:b].tolist()
            cursors.append([ids[0], 0, len(cursors), float(self.best[p]), ids, self.scores[a:b].tolist()])
        out = []
        while cursors:
            cursors.sort()
            # the pivot: the first section that the terms up to it could lift to the least threshold
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            section = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == section:
                pivot += 1
            if cursors[0][0] == section:
                if sum(c[5][c[1]] for c in cursors[: pivot + 1]) >= self.threshold[section] * (1 - 1e-6):
                    out.append(section)
                to = section + 1
            else:
                to = section
            alive = cursors[pivot + 1 :]
            for c in cursors[: pivot + 1]:
                at = bisect.bisect_left(c[4], to, c[1])
                if at < len(c[4]):
                    alive.append([c[4][at], at, *c[2:]])
            cursors = alive
        return out

    def held(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, term): the distinct known terms of some documents, by document."""
        length = np.diff(offsets)
        hashes = kn.gram_hashes(words, GRAM)
        at = np.flatnonzero(self.lookup(hashes) >= 0)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + GRAM <= offsets[doc + 1]
        found = [(doc[inside], self.lookup(hashes[at[inside]]))]
        for d in np.flatnonzero((length > 0) & (length < GRAM)):
            term = self.lookup(grams(words[offsets[d] : offsets[d + 1]]))
            found.append((np.full(len(term), d)[term >= 0], term[term >= 0]))
        doc, term = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = np.unique(doc * len(self.terms) + term)
        return pair // max(1, len(self.terms)), pair % max(1, len(self.terms))

    def candidates(self, words: np.ndarray, offsets: np.ndarray) -> dict[int, set[int]]:
        """The items all of whose sections each document scores above their thresholds."""
        out: dict[int, set[int]] = {}
        if not len(self.terms):
            return out
        doc, term = self.held(words, offsets)
        if not len(doc):
            return out
        number = self.first[term + 1] - self.first[term]
        block = self.pairs[kn.ranges(self.first[term], number)] % len(self.least)
        top = self.best[kn.ranges(self.first[term], number)]
        doc, term = np.repeat(doc, number), np.repeat(term, number)
        order = np.lexsort((block, doc))
        doc, term, block, top = doc[order], term[order], block[order], top[order]
        begins = np.flatnonzero(kn.new_groups(doc, block))
        ends = np.r_[begins[1:], len(doc)]
        bounds = np.add.reduceat(top, begins)
        returned: dict[int, Counter] = {}
        for i in np.flatnonzero(bounds >= self.least[block[begins]] * (1 - 1e-6)):
            b, e = begins[i], ends[i]
            for s in self.search(term[b:e].tolist(), int(block[b])):
                returned.setdefault(int(doc[b]), Counter())[self.owner[s]] += 1
        for d, items in returned.items():
            if whole := {n for n, k in items.items() if k == self.parts[n]}:
                out[d] = whole
        return out

    def verified(self, items: set[int], words: np.ndarray) -> list[tuple[int, float, float]]:
        """(item, question share, answer share) of the items whose question and answer a document holds."""
        have = grams(words)
        out = []
        for i in sorted(items):
            q, a = (float(np.isin(g, have).mean()) for g in (self.questions[i], self.answers[i]))
            if q >= VERIFIED and a >= VERIFIED:
                out.append((self.items[i], q, a))
        return out


def runs(words: np.ndarray) -> np.ndarray:
    """Hashes of GRAM words in a row; of fewer words, of all of them."""
    return kn.gram_hashes(words, min(GRAM, len(words))) if len(words) else np.zeros(0, U)


def grams(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of GRAM words in a row; of fewer words, of all of them."""
    return np.unique(runs(words))


def _indexes(benchmark: DataFrame):
    """Parts of the benchmark, each an index of ITEM_WORDS words at most or of one item."""
    items, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        data = np.frombuffer(r.text.encode(), np.uint8)
        w, _ = tokens(data, np.array([0, len(data)]))
        if items and size + len(w) > ITEM_WORDS:
            yield Index(items)
            items, size = [], 0
        items.append((r.item_id, w))
        size += len(w)
    yield Index(items)


def _find(batch, index: Index):
    """(row, findings) of the rows of a batch that hold an item."""
    data, offsets = kn.flat_text(batch.column("text"))
    for a, b in kn.chunks(offsets):
        words, woff = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i, items in sorted(index.candidates(words, woff).items()):
            if found := index.verified(items, words[woff[i] : woff[i + 1]]):
                yield a + i, found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each item (item_id, text) found in a row of docs: doc_id, item_id, question_share, answer_share.

    Defined cases: null, empty and wordless texts or items match nothing; null item_ids are left
    out; documents with a null doc_id are searched and reported with it; rows that share a doc_id
    or an item_id are judged each; an empty side gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                rows = [(i, *f) for i, found in _find(batch, shared.value) for f in found]
                at, items, q, a = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items, pa.int64()), pa.array(q, pa.float64()), pa.array(a, pa.float64())], ["doc_id", "item_id", "question_share", "answer_share"])

        part = slim.mapInArrow(run, "doc_id long, item_id long, question_share double, answer_share double")
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    ship(docs.sparkSession)
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[i for i, _ in _find(batch, shared.value)]] = False
                yield batch.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
