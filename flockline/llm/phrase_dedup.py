"""Substring dedup: words covered by a 50-word window of an earlier document are removed.

Method: repeated-phrase automata, in two passes over the documents.

*Confirm.*  Passages that may recur meet in shards by a 24-word anchor (see _repeats: equal windows
hold equal anchors); there their 50-word windows are compared word by word.  What is confirmed is a
phrase: a stretch of 50 to 76 words with the id `after` which all documents that hold it repeat an
earlier one.  A phrase goes once to each group of documents that asked about it, without any place.

*Locate.*  Each group compiles its phrases with pyahocorasick into automata whose letters are SPELL
words in a row, PHRASES at most in each, and streams all its documents past them; runs of letters that
no phrase has are passed over.  What the occurrences in documents
later than `after` cover is removed; as many of them as cover it are compared with the phrase's own
words, and all where that fails.

A group's phrases are no more than its anchors, so an automaton's memory and the number of automata
follow the bytes of a group, which are bounded, and not the corpus.  Whole copies of an earlier text
need no phrase.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _kernels as kn
from . import _repeats as rp

U = np.uint64
WINDOW = 50
GRAM = 24
REACH = WINDOW - GRAM
PHRASES = 8_000
#: A letter is as many words in a row, so that letters of phrases are rare elsewhere.
SPELL = 3
#: Letters are code points from here on: the first for what no phrase has.  There is room for 2**20.
LETTER = 0x10000


def letters(codes: np.ndarray) -> str:
    return (codes + LETTER).astype("<u4").tobytes().decode("utf-32-le")


class Phrases:
    """An automaton over phrases.  Inputs: the words of each, and its `after`."""

    def __init__(self, phrases: list[tuple[list[bytes], int]]):
        data = b"".join(b" ".join(ws) + b" " for ws, _ in phrases)
        flat = np.frombuffer(data, np.uint8)
        starts, ends, _ = kn.words(flat, np.array([0, len(flat)]))
        hashes = kn.gram_hashes(kn.word_hashes(flat, starts, ends), SPELL)
        self.known = np.unique(hashes)  # with some that cross from one phrase to the next: harmless
        codes = letters(np.searchsorted(self.known, hashes) + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # phrases of equal letters: several only where hashes of different words are alike
        self.phrases: list[list[tuple[list[bytes], int]]] = []
        at = 0
        for ws, after in phrases:
            key = codes[at : at + len(ws) - SPELL + 1]
            at += len(ws)
            place = self.automaton.get(key, None)
            if place is None:
                self.automaton.add_word(key, place := len(self.phrases))
                self.phrases.append([])
            self.phrases[place].append((ws, after))
        self.automaton.make_automaton()
        self.length = np.array([len(some[0][0]) for some in self.phrases], np.int64)
        self.after = np.array([min(a for _, a in some) for some in self.phrases], np.int64)

    def read(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
        """Texts as letters (hashes of SPELL words in a row), and where (begin, end) they could hold a phrase.

        Offsets are those of the words of the texts.  A run of letters that some phrase has ends
        with its text, and is not shorter than a phrase.
        """
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        known = self.known[place] == hashes
        text = letters(np.where(known, place + 1, 0))
        for k in range(1, SPELL):  # what crosses from one text to the next
            last = offsets[1:] - k
            known[last[(last >= 0) & (last < len(known))]] = False
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        long = end - begin > WINDOW - SPELL
        return text, begin[long], end[long]

    def occurrences(self, text: str, doc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the automaton finds phrases that may go from a document: first word, end, phrase."""
        found = np.array(list(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, phrase = found[self.after[found[:, 1]] < doc].T
        return end + SPELL - self.length[phrase], end + SPELL, phrase

    def confirmed(self, phrase: int, doc: int, words: list[bytes]) -> bool:
        return any(after < doc and words == ws for ws, after in self.phrases[phrase])


def fewest(begin: np.ndarray, end: np.ndarray) -> list[int]:
    """Of spans, a few that cover all that they cover together."""
    order = np.lexsort((-end, begin))
    top = np.maximum.accumulate(end[order])
    order = order[np.r_[True, end[order][1:] > top[:-1]]]  # those inside an earlier one are out
    chosen: list[int] = []
    starts, ends = begin[order].tolist(), end[order].tolist()
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        # the last one is not needed if this one meets the one before it
        if len(chosen) > 1 and s <= ends[chosen[-2]] and e > ends[chosen[-1]]:
            chosen.pop()
        chosen.append(i)
    return order[chosen].tolist()


class WordResolver:
    """Windows word by word; phrases go back, and automata locate them."""

    window, gram = WINDOW, GRAM

    def __call__(self, gram, doc, left, right, flat, start, length):
        m = len(doc)
        tokens: dict[bytes, int] = {}
        matrix = np.full((m, REACH + WINDOW), -1, np.int64)
        anchors: dict[bytes, int] = {}
        group = np.empty(m, np.int64)
        whole = flat.tobytes()
        for i in range(m):
            ws = whole[start[i] : start[i] + length[i]].split()
            ln = int(left[i])
            matrix[i, REACH - ln : REACH - ln + len(ws)] = [tokens.setdefault(w, len(tokens)) for w in ws]
            group[i] = anchors.setdefault(b" ".join(ws[ln : ln + GRAM]), len(anchors))
        prefix = rp.row_prefix(kn.mix64((matrix + 1).astype(U) + U(1)))
        return rp.windows_seen(matrix, prefix, REACH, WINDOW, doc, left, right, lambda t: group, lambda t: prefix[:, REACH - t + WINDOW] - prefix[:, REACH - t])

    def bytes_of(self, flat, start, length, begin, end):
        """The bytes of words [begin, end) of each context."""
        first, last = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        cuts = np.r_[0, np.cumsum(length)]
        for a, b in kn.chunks(cuts):
            s, e, woff = kn.words(flat[kn.ranges(start[a:b], length[a:b])], cuts[a : b + 1] - cuts[a])
            shift = start[a:b] - (cuts[a:b] - cuts[a])
            first[a:b] = s[woff[:-1] + begin[a:b]] + shift
            last[a:b] = e[woff[:-1] + end[a:b] - 1] + shift
        return first, last

    def reported(self, n, stretches, flat):
        """Each phrase once a group: `after`, and the bytes."""
        to = rp.doc_bucket(stretches.doc, n)
        whole = flat.tobytes()
        sent: dict[tuple[int, bytes], int] = {}
        for db, a, b, after in zip(to.tolist(), stretches.first.tolist(), stretches.last.tolist(), stretches.after.tolist(), strict=True):
            phrase = (db, whole[a:b])
            sent[phrase] = min(after, sent.get(phrase, after))
        by: dict[int, list[tuple[bytes, int]]] = {}
        for (db, body), after in sent.items():
            by.setdefault(db, []).append((body, after))
        blocks = [kn.pack(np.array([a for _, a in some], np.int64), np.array([len(t) for t, _ in some], np.uint32), np.frombuffer(b"".join(t for t, _ in some), np.uint8)) for some in by.values()]
        return [-db - 1 for db in by], blocks

    def located(self, texts, found, copy):
        after, length, flat = kn.unpack_all(found.column("block"), np.int64, np.uint32, np.uint8) if found.num_rows else (np.zeros(0, np.int64),) * 3
        ends, whole = np.cumsum(length).tolist(), flat.tobytes()
        held: dict[bytes, tuple[list[bytes], int]] = {}
        for a, b, x in zip([0, *ends], ends, after.tolist(), strict=False):
            ws = whole[a:b].split()
            name = b" ".join(ws)
            held[name] = (ws, min(x, held[name][1]) if name in held else x)
        phrases = list(held.values())
        del held, flat, whole
        spans: dict[int, list[tuple[int, int]]] = {}
        searched = texts.has & ~copy
        chunks = [(a, kn.gram_hashes(u.values, SPELL), u) for a, _, u in texts.units("words")] if phrases else []
        for p in range(0, len(phrases), PHRASES):
            automaton = Phrases(phrases[p : p + PHRASES])
            for a, hashes, units in chunks:
                text, runs, ends = automaton.read(hashes, units.offsets)
                rows = np.searchsorted(units.offsets, runs, "right") - 1
                for i, r, z in zip(rows.tolist(), runs.tolist(), ends.tolist(), strict=True):
                    if not searched[a + i]:
                        continue
                    doc = int(texts.doc[a + i])
                    begin, end, phrase = automaton.occurrences(text[r:z], doc)
                    if not len(begin):
                        continue
                    words = lambda j: units.data[units.starts[r + begin[j]] : units.ends[r + end[j] - 1]].tobytes().split()  # noqa: B023, E731
                    held = lambda j: automaton.confirmed(int(phrase[j]), doc, words(j))  # noqa: B023, E731
                    few = fewest(begin, end)
                    if not all(map(held, few)):  # letters have misled: each is looked at
                        few = list(filter(held, range(len(begin))))
                    at = r - int(units.offsets[i])
                    spans.setdefault(a + i, []).extend((at + int(begin[j]), at + int(end[j])) for j in few)
        return [merged(spans[i]) if i in spans else None for i in range(len(texts))]


def merged(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return np.array([s for s, _ in out]), np.array([e for _, e in out])


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPAN)])


def _result(text: memoryview, spans, copy: bool):
    ws = bytes(text).split()
    n, removed, pairs = len(ws), 0, []
    if copy and n >= WINDOW:
        spans = np.array([0]), np.array([n])
    if spans is not None:
        kept, at = [], 0
        for s, e in zip(*(x.tolist() for x in spans), strict=True):
            kept += ws[at:s]
            at = e
            removed += e - s
            pairs.append({"start": s, "end": e})
        ws = kept + ws[at:]
    return n, removed, hashlib.sha256(b" ".join(ws)).hexdigest(), pairs


def phrase_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): what a 50-word repeat of an earlier document removes.

    Words are runs of anything but the six ASCII separators, unchanged.  Columns: doc_id, n_words,
    n_removed, kept_sha256 (kept words joined by one space) and the removed word spans.

    Defined cases: null or wordless text has no words; texts under 50 words lose nothing; a row
    with a null doc_id is neither earlier nor later than any other and keeps all; rows that repeat
    a doc_id are judged each, against smaller ids only; an empty table gives an empty result; other
    columns of docs are ignored, whatever their names.
    """
    return rp.remove_repeats(docs, "words", WordResolver(), _result, SCHEMA, ARROW)
