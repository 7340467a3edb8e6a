"""What the operators must return, by the plainest means."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remove_repeats(rows, of_words, window=50):
    """[(doc_id, text)] -> per row (doc_id, units, removed, spans, digest of what stays)."""
    texts = [(i, (t or "").encode().split() if of_words else (t or "").encode()) for i, t in rows]
    first = {}
    for i, u in texts:
        if i is not None:
            for a in range(len(u) - window + 1):
                w = tuple(u[a : a + window]) if of_words else u[a : a + window]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, u in texts:
        gone = [False] * len(u)
        if i is not None:
            for a in range(len(u) - window + 1):
                w = tuple(u[a : a + window]) if of_words else u[a : a + window]
                if first[w] < i:
                    gone[a : a + window] = [True] * window
        kept = b" ".join(x for x, g in zip(u, gone, strict=True) if not g) if of_words else bytes(x for x, g in zip(u, gone, strict=True) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, width):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    if len(ws) < width:
        return frozenset([tuple(ws)])
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))


def classes(rows, width, percent):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= percent * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), v in zip(sets, label, strict=True):
        if i is not None:
            least[v] = min(least.get(v, i), i)
    return [(i, len(s), None if i is None else least[v]) for (i, s), v in zip(sets, label, strict=True)]
