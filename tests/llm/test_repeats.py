import random
import zlib
from collections import namedtuple

import numpy as np
import pyarrow as pa
import pytest

from flockline.llm import _kernels as kn
from flockline.llm import _repeats as rp
from flockline.llm import jaccard_join as jj
from flockline.llm import phrase_dedup as ph
from flockline.llm import suffix_dedup as sd
from flockline.llm.jaccard_join import bands, jaccard_join, link, prefix_length
from flockline.llm.phrase_dedup import phrase_dedup
from flockline.llm.suffix_dedup import SuffixSort, suffix_dedup
from tests.llm import brute


def corpus(seed, n=60, vocabulary=40):
    """Texts with shared passages, copies, near copies, low entropy, and the odd cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    words = [word() for _ in range(vocabulary)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.choice([8, 20, 55, 70, 120]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice(passages))
            parts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))))
        rows.append((i * 3 - 20, rng.choice([" ", "\n", "  \t"]).join(parts)))
    texts = [t for _, t in rows]
    for i, t in enumerate(texts[:12]):
        ws = t.split(" ")
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = word()
        rows.append((500 + i, " ".join(ws)))
    rows += [(700, texts[3]), (701, texts[3]), (702, "a" * 400), (703, "ab" * 90 + "a" * 60), (704, "x " * 200), (705, "x " * 120), (706, ""), (707, None), (708, "   \n"), (709, "short"), (710, "A-Z a-z " * 30)]
    rows += [(None, texts[5]), (None, None), (33, passages[4] + " other text"), (33, "again " + passages[4]), (33, "again " + passages[4])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("of_words", [False, True])
def test_repeats_equal_brute_force(spark, docs_of, seed, of_words):
    rows = corpus(seed)
    got = (phrase_dedup if of_words else suffix_dedup)(docs_of(rows).repartition(3)).collect()
    have = sorted((str(r.doc_id), r[1], r.n_removed, len(r.spans), r.kept_sha256) for r in got)
    assert have == sorted((str(i), *rest) for i, *rest in brute.remove_repeats(rows, of_words))


@pytest.mark.parametrize("run", [suffix_dedup, phrase_dedup])
def test_empty_table(docs_of, run):
    assert run(docs_of([(1, "a")]).where("false")).collect() == []


def test_hash_order_is_verified_against_collisions():
    rng = np.random.default_rng(0)
    m = 300
    matrix = rng.integers(97, 100, (m, 76)).astype(np.uint8)
    size = rng.integers(24, 51, m)
    group = rng.integers(0, 5, m)
    prefix = rp.row_prefix(kn.BYTE_VALUE[matrix])
    for broken in (prefix, np.zeros_like(prefix)):  # with no hash telling rows apart, the bytes decide
        order, lcp = SuffixSort(matrix, broken, 26, size).sort(group)
        keys = [(group[i], bytes(matrix[i, 26 : 26 + size[i]])) for i in order]
        assert keys == sorted(keys)
        for a, b, n in zip(keys, keys[1:], lcp[1:], strict=False):
            common = 0
            while a[0] == b[0] and common < min(len(a[1]), len(b[1])) and a[1][common] == b[1][common]:
                common += 1
            assert n == common


def test_misleading_window_hashes_are_found_out():
    rng = np.random.default_rng(1)
    matrix = rng.integers(97, 123, (40, 76)).astype(np.uint8)
    matrix[20:30] = matrix[:10]
    doc = np.arange(40)
    full = np.full(40, 50)
    low, high, after = rp.windows_seen(matrix, None, 26, 50, doc, np.full(40, 26), full, lambda t: np.zeros(40, np.int64), lambda t: np.zeros(40, np.uint64))
    assert (high[20:30] == 26).all() and (low[20:30] == 0).all() and (high[:20] == -1).all() and (high[30:] == -1).all()
    assert (after[20:30] == np.arange(10)).all()


def read(phrases, *texts):
    data, woff = [b"".join(texts)], np.r_[0, np.cumsum([len(t) for t in texts])]
    flat = np.frombuffer(data[0], np.uint8)
    starts, ends, offsets = kn.words(flat, woff)
    return phrases.read(kn.gram_hashes(kn.word_hashes(flat, starts, ends), ph.SPELL), offsets)


def test_automaton_finds_phrases_at_their_place(monkeypatch):
    monkeypatch.setattr(ph, "WINDOW", 4)
    abcd, bcde, cdef = (list(map(bytes, zip(x))) for x in (b"abcd", b"bcde", b"cdef"))
    phrases = ph.Phrases([(abcd, 1), (bcde, 2), (cdef, 3)])
    text, begin, end = read(phrases, b"x a  b c d y a b c", b" d a\tb\nc d e")
    assert (begin.tolist(), end.tolist()) == ([1, 10], [3, 13])  # not from one text to the next
    assert [x.tolist() for x in phrases.occurrences(text[10:13], 9)] == [[0, 1], [4, 5], [0, 1]]
    assert [x.tolist() for x in phrases.occurrences(text[10:13], 2)] == [[0], [4], [0]]


def test_fewest_spans_cover_the_same():
    rng = random.Random(2)
    for _ in range(300):
        spans = [(b, b + rng.randint(1, 12)) for b in (rng.randrange(60) for _ in range(rng.randint(1, 25)))]
        few = ph.fewest(*(np.array(x) for x in zip(*spans, strict=True)))
        cover = lambda some: {i for s, e in some for i in range(s, e)}
        assert cover(spans[j] for j in few) == cover(spans) and len(set(few)) == len(few)
    assert len(ph.fewest(np.arange(100), np.arange(100) + 50)) < 6


def test_words_of_equal_hashes_are_told_apart(docs_of, monkeypatch):
    """All words of one length are one letter: the words themselves decide."""
    monkeypatch.setattr(kn, "word_hashes", lambda data, starts, ends: kn.mix64((ends - starts).astype(np.uint64)))
    words = [[bytes([97 + (i * j) % 26]) for i in range(60)] for j in (1, 3)]
    phrases = ph.Phrases([(words[0], 1), (words[1], 5)])
    _, _, found = phrases.occurrences(read(phrases, b" ".join(words[1]))[0], 9)
    assert found.tolist() == [0] and phrases.confirmed(0, 9, words[1]) and phrases.confirmed(0, 3, words[0]) and not phrases.confirmed(0, 3, words[1])


def test_automata_decide(docs_of, monkeypatch):
    """Without an automaton no occurrence has a place; with many small ones all have."""
    rows = corpus(1)
    want = sorted((str(i), *rest) for i, *rest in brute.remove_repeats(rows, True))
    run = lambda: [(str(r.doc_id), r[1], r.n_removed, len(r.spans), r.kept_sha256) for r in local_groups(rows)]
    monkeypatch.setattr(ph, "PHRASES", 3)
    assert sorted(run()) == want
    monkeypatch.setattr(ph.Phrases, "occurrences", lambda self, text, doc: (np.zeros(0, np.int64),) * 3)
    copies = {t for _, t in rows if t and sum(t == u for _, u in rows) > 1}
    assert {r.n_removed for r, (_, t) in zip(local_groups(rows), rows, strict=True) if t not in copies} == {0}


Row = namedtuple("Row", [f.name for f in ph.ARROW])


def local_groups(rows):
    """phrase_dedup's rows in the order of `rows`, by its own steps in this process."""
    n = 7
    resolver = ph.WordResolver()
    db = [(i if i is not None else 0) % n for i, _ in rows]
    first = {}
    for i, t in rows:
        if i is not None and t is not None:
            first[t] = min(first.get(t, i), i)
    table = lambda cols, schema: pa.table(dict(zip([f.name for f in schema], cols, strict=True)), schema=schema)
    docs_schema, found_schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), pa.schema([("block", pa.binary()), ("copy", pa.int64()), ("crc", pa.int64())])
    groups = {g: [j for j in range(len(rows)) if db[j] == g] for g in range(n)}
    docs = {g: table([[rows[j][0] for j in js], [rows[j][1] for j in js]], docs_schema) for g, js in groups.items()}
    copy = {g: [(rows[j][0], zlib.crc32(rows[j][1].encode())) for j in js if rows[j][0] is not None and rows[j][1] is not None and first[rows[j][1]] < rows[j][0]] for g, js in groups.items()}
    copies = {g: table([[None] * len(c), [x for x, _ in c], [y for _, y in c]], found_schema) for g, c in copy.items()}

    def grouped(tables):
        out = {}
        for t in tables:
            for k, b in zip(t.column("key").to_pylist(), t.column("block").to_pylist(), strict=True):
                out.setdefault(k, []).append(b)
        return {k: pa.table({"key": pa.array([k] * len(b), pa.int64()), "block": pa.array(b, pa.binary())}) for k, b in out.items()}

    back = lambda shuffled, g: shuffled.get(-g - 1, pa.table({"key": pa.array([], pa.int64()), "block": pa.array([], pa.binary())}))
    anchors = grouped(rp._anchors("words", ph.WINDOW, ph.GRAM, n)(docs[g], copies[g]) for g in range(n))
    shared = grouped(map(rp._shared(n), anchors.values()))
    contexts = grouped(rp._contexts("words", n, resolver)(docs[g], back(shared, g)) for g in range(n))
    reports = grouped(map(rp._resolved("words", n, resolver), contexts.values()))
    out = {}
    for g in range(n):
        blocks = back(reports, g).column("block").to_pylist()
        found = pa.concat_tables([table([blocks, [None] * len(blocks), [None] * len(blocks)], found_schema), copies[g]])
        result = rp._applied(resolver, ph._result, ph.ARROW)(docs[g], found)
        result = [tuple(r.values()) for r in result.to_pylist()]
        for j, r in zip(groups[g], result, strict=True):
            out[j] = r

    return [Row(*out[j]) for j in range(len(rows))]


def test_anchors_never_miss_a_repeat():
    rng = np.random.default_rng(3)
    for _ in range(200):
        shared = rng.integers(97, 100, 50).astype(np.uint8)
        docs = [np.concatenate([rng.integers(97, 100, rng.integers(0, 90)).astype(np.uint8), shared, rng.integers(97, 100, rng.integers(0, 90)).astype(np.uint8)]) for _ in range(2)]
        seen = []
        for d in docs:
            at, h = kn.winnow(kn.BYTE_VALUE[d], np.array([0, len(d)]), 50, sd.GRAM)
            seen.append(set(h.tolist()))
        assert seen[0] & seen[1]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("seed", [4, 5])
def test_jaccard_equals_brute_force(docs_of, seed, width, percent):
    rng = random.Random(seed)
    rows = corpus(seed, 40, 400)
    for i, (_, t) in enumerate(rows[:25]):  # near copies at all distances
        ws = (t or "").split()
        for _ in range(rng.randint(0, 3)):
            if ws:
                ws[rng.randrange(len(ws))] = f"w{rng.randrange(99)}"
        rows.append((2000 + i, " ".join(ws).upper()))
    rows += [(3000 + i, " ".join(f"q{j}" for j in range(i % 4))) for i in range(8)]
    got = jaccard_join(docs_of(rows).repartition(3), width, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == sorted(((str(i), n, c) for i, n, c in brute.classes(rows, width, percent)), key=lambda r: (r[0], r[1], r[2]))


def test_jaccard_large_block_in_tiles(docs_of, monkeypatch):
    monkeypatch.setattr(jj, "TILE", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(50):
        ws = list(base)
        for _ in range(rng.randint(0, 6)):
            ws[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = jaccard_join(docs_of(rows), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute.classes(rows, 3, 90))


def test_jaccard_hot_shingles_in_parts(docs_of, monkeypatch):
    monkeypatch.setattr(jj, "HOT", 4)
    rows = near_copies(random.Random(10), 40, 120)
    got = jaccard_join(docs_of(rows), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute.classes(rows, 3, 90))


def near_copies(rng, n, words):
    rows = []
    for i in range(n):
        ws = [f"w{i}" for i in range(words)]
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    return rows


@pytest.mark.parametrize("words", [40, 400, 4000])
def test_shared_passages_tie_no_blocks(docs_of, monkeypatch, words):
    """A ring of documents, each half shared with one neighbour: none link, and none get to verification."""
    passage = lambda i: " ".join(f"p{i}w{j}" for j in range(words // 2))
    n = 30
    rows = [(i, f"{passage(i)} {passage((i + 1) % n)}") for i in range(n)]
    seen = []
    monkeypatch.setattr(jj, "components", lambda edges, real=jj.components: (seen.append(edges.count()), real(edges))[1])
    for width, percent in ((3, 90), (5, 80)):
        assert all(r.component_id == r.doc_id for r in jaccard_join(docs_of(rows), width, percent).collect())
    assert seen == [0, 0, 0, 0]


def test_rows_of_one_id_are_judged_each(docs_of):
    """Two texts of one id, each with a near copy of another id; equal rows; texts of one set."""
    a, b, c = ([f"{x}{j}" for j in range(60)] for x in "abc")
    near = lambda ws: " ".join([*ws[:59], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (3, near(b)), (9, " ".join(c)), (9, " ".join(c)), (8, "  ".join(c).upper()), (-4, near(c))]
    got = jaccard_join(docs_of(rows), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute.classes(rows, 3, 90))
    assert sorted(r.component_id for r in got) == [-4, -4, -4, -4, 3, 3, 5, 5]


def test_jaccard_empty_table(docs_of):
    assert jaccard_join(docs_of([(1, "a")]).where("false")).collect() == []


def test_prefixes_and_bands_lose_no_pair():
    """The least overlap that still links leaves fewer shingles outside than a prefix has."""
    for percent in (50, 80, 90):
        for n in (1, 5, 10, 19, 100, 1000):
            for m in range(1, n + 1):
                if 100 * m >= percent * n:
                    least = -(-percent * (n + m) // (100 + percent))
                    p, q = prefix_length(np.array([n, m]), percent)
                    assert p > n - least and q > m - least
                    assert set(bands(n, percent)) & set(bands(m, percent))


def test_link_by_tree_equals_all_pairs():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 90):
        base = rng.integers(0, 2**63, 120).astype(np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(60, 120), replace=False), rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)]) for _ in range(80)]
        offsets = np.r_[0, np.cumsum([len(s) for s in sets])]
        label = link(np.concatenate(sets), offsets, percent)
        want = list(range(80))
        for a in range(80):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    want = [want[b] if v == want[a] else v for v in want]
        assert len(set(zip(label.tolist(), want, strict=True))) == len(set(want)) == len(set(label.tolist()))
