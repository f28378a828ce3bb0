"""Hashed byte n-grams of slices of texts, and the split into learnable and held-out rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlake.llm._text import BYTE_VALUES

_M = np.uint64(0x9E3779B97F4A7C15)

#: Lower-cased letters and UTF-8 bytes; everything else is a blank.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
#: The bytes as they are, but for digits (all 0) and line ends (blanks).
SURFACE = np.arange(256, dtype=np.uint8)
SURFACE[48:58] = 48
SURFACE[[9, 10, 11, 12, 13]] = 32


def ngram_buckets(data: np.ndarray, fold: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """By n-gram size: the bucket of the n-gram that starts at each byte (as far as one fits in the slice)."""
    v = BYTE_VALUES[fold][data]
    out, h = [], np.zeros(len(v), np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(v) < n:
            out.append(np.zeros(0, np.int32))
            continue
        h = v.copy() if n == 1 else h[:-1] * _M + v[n - 1 :]
        if n in sizes:
            x = h ^ (h >> np.uint64(29))
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out.append((x >> np.uint64(64 - bits)).astype(np.int32))
    return out


def held_out(record_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0; rows without an id are never learned from either."""
    return F.coalesce(F.crc32(record_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def drawn(record_id: Column, rate: Column) -> Column:
    """True for a fixed share ``rate`` of the ids, by their hash."""
    return (F.pmod(F.xxhash64(record_id.cast("string"), F.lit(17)), F.lit(1 << 40)) / float(1 << 40)) < rate
