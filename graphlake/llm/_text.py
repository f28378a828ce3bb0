"""Vectorised text primitives over Arrow string buffers: word bounds, word hashes, shingle sets.

Everything works on slices of about ``CHUNK`` bytes, so a task's memory follows the longest single
document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 5)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pows: tuple[np.ndarray, np.ndarray] | None = None


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, grown on demand."""
    global _pows
    if _pows is None or len(_pows[0]) < n:
        size = max(n, 2 * CHUNK)
        up, down = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        up[0] = down[0] = 1
        _pows = np.cumprod(up), np.cumprod(down)
    return _pows


#: One random 64-bit value a byte; A-Z share the values of a-z.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
FOLDED = BYTE_VALUES.copy()
FOLDED[65:91] = BYTE_VALUES[97:123]

#: Bytes that end a word: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes outside [0-9a-zA-Z] and UTF-8 sequences: [\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False
NOT_ALNUM[128:] = False


def string_slices(col: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte offsets) of consecutive slices; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, obuf, dbuf = col.buffers()
    offsets = np.frombuffer(obuf, np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = np.frombuffer(dbuf, np.uint8) if dbuf is not None and dbuf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1
        hi = min(len(col), max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the words' offsets by document (one more than documents)."""
    keep = np.zeros(len(data) + 1, bool)
    np.logical_not(ends_word[data], out=keep[:-1])
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = keep[:-1]
    before[offsets] = False  # a document's first byte starts a word whatever stands before it
    starts = np.flatnonzero(keep & ~before)
    after = keep.copy()
    after[offsets] = False
    ends = np.flatnonzero(keep[:-1] & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial by prefix sums, then mixed."""
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    v = values[data]
    v *= up[: len(data)]
    np.cumsum(v, out=sums[1:])
    h = sums[ends]
    h -= sums[starts]
    h *= down[starts]
    return mix64(h)


_Q = mix64(np.arange(11, 75, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _q(k: int) -> np.ndarray:
    return _Q[:k] if k <= len(_Q) else mix64(np.arange(11, 11 + k, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of ``words[i:i+k]`` for each i for which it lies inside."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = _q(k)
    out = words[:n] * q[0]
    for j in range(1, k):
        out += words[j : j + n] * q[j]
    return mix64(out ^ np.uint64(k))


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """By document: the sorted distinct hashes of its k-word shingles over [^\\x20\\x09-\\x0D]+ words, A-Z
    lower-cased; of fewer words the whole sequence as one, of none an empty set."""
    starts, ends, at = word_bounds(data, offsets, SPACE)
    words = word_hashes(data, starts, ends)
    windows = window_hashes(words, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield sorted_distinct(windows[a : b - k + 1])
        elif b > a:
            yield window_hashes(words[a:b], b - a)
        else:
            yield windows[:0]
