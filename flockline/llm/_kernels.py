"""NumPy kernels that the text operators of this subpackage share.

Texts are handled as one flat byte array with document offsets, in chunks of a few MB, so that a
worker's memory does not follow the size of an Arrow batch.  Substring hashes are prefix
polynomials modulo 2**64 over randomised byte values: ``hash(s, e) = (H[e] - H[s]) * B**-s``.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

# Large arrays are given back to the system when they are freed, so that a worker, which lives on
# for other tasks, does not keep the most it ever used (glibc's default threshold grows to 32 MB).
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

_pow = np.ones(1, U)
_inv = np.ones(1, U)

BYTE_VALUE = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
#: The separators of the word pattern [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n at least."""
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, _BASE, U), np.full(n, _BASE_INV, U)
        up[0] = down[0] = 1
        _pow, _inv = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _pow, _inv


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of values[j] * B**j for j < i."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:], dtype=U)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of each span [start, end)."""
    _, inv = powers(len(prefix))
    return (prefix[end] - prefix[start]) * inv[start]


def flat_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges [a, b) of at most `most` bytes; a longer text makes a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the word offsets of the documents."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = np.zeros(n + 2, bool)
    np.logical_not(IS_SPACE[data], out=solid[1:-1])
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = solid[inner + 1]
    last[inner - 1] = solid[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64(span_hash(prefix_hash(BYTE_VALUE[data]), starts, ends))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; len(values) - k + 1 of them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    _, inv = powers(len(values) + 1)
    prefix = prefix_hash(values)
    return mix64((prefix[k:] - prefix[:-k]) * inv[:n])


def _sliding(a: np.ndarray, w: int, best) -> np.ndarray:
    span = 1
    while span < w:
        step = min(span, w - span)
        a = best(a[:-step], a[step:])
        span += step
    return a


def winnow(values: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of every document: positions of k-grams that are the least of some window.

    A window is `window` consecutive values of one document.  Which of its k-grams are least
    depends on its content alone, so equal windows hold equal anchors at equal places: no window
    that repeats is missed.  Returns positions and gram hashes.
    """
    n = len(values)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = gram_hashes(values, k) | U(1)
    w = window - k + 1
    least = _sliding(h, w, np.minimum)
    room = np.full(n, 0, np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    np.subtract(ends, np.arange(n), out=room)
    least[room[: len(least)] < window] = 0
    padded = np.zeros(len(h) + w - 1, U)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
    return at, h[at]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = np.array([len(arrays), len(body), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return head + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpack(value: bytes, *kinds) -> list[np.ndarray]:
    n, size = np.frombuffer(value, np.int64, 2)
    lens = np.frombuffer(value, np.int64, n, 16)
    body = pa.decompress(value[16 + 8 * int(n) :], decompressed_size=int(size), codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for ln, kind in zip(lens.tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, kind, ln // np.dtype(kind).itemsize, at))
        at += ln
    return out


def unpack_all(column, *kinds) -> list[np.ndarray]:
    """Each array of all the values of a binary column, one after the other."""
    parts = [unpack(v.as_py(), *kinds) for v in column]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i in range(len(kinds))]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    return first + np.arange(total)


def new_groups(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, which begin a group."""
    n = len(keys[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def split_rows(key: np.ndarray, *arrays: np.ndarray):
    """(key value, arrays) of each group of equal keys."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(new_groups(key))
    for a, b in zip(cuts, np.r_[cuts[1:], len(key)], strict=True):
        rows = order[a:b]
        yield int(key[a]), tuple(x[rows] for x in arrays)
