"""op4 and op8 over a whole table of documents, held against sorted window hashes."""

import hashlib

import numpy as np
import pytest

from flockline.llm.phrase_dedup import phrase_dedup
from flockline.llm.suffix_dedup import suffix_dedup

DOCS = "/root/testdata/sf0.01/documents.parquet"
WINDOW = 50


def covered(units, lengths):
    """Of units (numbers) of documents by ascending id: those in a window that an earlier document holds."""
    offsets = np.r_[0, np.cumsum(lengths)]
    value = np.random.default_rng(3).integers(1, 2**63, int(units.max()) + 1, dtype=np.uint64)[units]
    windows = np.zeros(len(units) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + value[k : k + len(windows)]
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(windows)]
    at = np.flatnonzero(np.arange(len(windows)) + WINDOW <= offsets[1:][doc])
    at = at[np.argsort(windows[at], kind="stable")]
    first = np.r_[True, windows[at][1:] != windows[at][:-1]]
    least = doc[at][first][np.cumsum(first) - 1]
    change = np.zeros(len(units) + 1, np.int64)
    again = at[doc[at] > least]
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return np.split(np.cumsum(change)[:-1] > 0, offsets[1:-1])


@pytest.mark.parametrize("of_words", [False, True])
def test_whole_table_equals_window_hashes(spark, of_words):
    docs = spark.read.parquet(DOCS)
    texts = [((r.text or "").encode(), r.doc_id) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    assert len({i for _, i in texts}) == len(texts)
    names = {}
    units = [t.split() if of_words else t for t, _ in texts]
    numbers = np.array([names.setdefault(w, len(names)) for u in units for w in u])
    gone = covered(numbers, [len(u) for u in units])
    want = {}
    for (_, i), u, g in zip(texts, units, gone, strict=True):
        kept = b" ".join(w for w, x in zip(u, g, strict=True) if not x) if of_words else bytes(w for w, x in zip(u, g, strict=True) if not x)
        want[i] = (len(u), int(g.sum()), hashlib.sha256(kept).hexdigest())
    found = phrase_dedup(docs) if of_words else suffix_dedup(docs)
    size = "n_words" if of_words else "n_bytes"
    assert {r.doc_id: (r[size], r.n_removed, r.kept_sha256) for r in found.select("doc_id", size, "n_removed", "kept_sha256").collect()} == want
    assert sum(r for _, r, _ in want.values()) > 0
