"""Hashed character n-grams of whole texts, for the linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of a long text that are taken at once.
PART = 1 << 20

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint32)


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its lower case, if that is one character; whether it is a letter."""
    chars = [chr(i) for i in range(0x110000)]
    return np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32), np.array([c.isalpha() for c in chars])


def characters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of UTF-8 rows, the rows' offsets in them, and which are letters."""
    lower, letter = _tables()
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(points) != len(raw):
        heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        at = heads[at]
    points = lower[points]
    return points, at, letter[points]


def hashed(points: np.ndarray, at: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram at every place, 1 << bits where a row's end is nearer than n, and n-grams by row."""
    h = points * _FACTORS[0]
    for k in range(1, n):
        h[:-k] += points[k:] * _FACTORS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D) + np.uint32(2 * n)
    h >>= np.uint32(32 - bits)
    length = np.diff(at)
    ends = at[1:][length > 0]
    for k in range(1, n):
        late = ends - k
        h[late[late >= 0]] = 1 << bits
    return h, np.maximum(length - n + 1, 0)


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], zero for empty rows."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), np.float64)
    full = at[:-1] < at[1:]
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0)
    return out


def by_parts(raw: np.ndarray, orders: tuple[int, ...], bits: int, part: int = PART) -> Iterator[tuple[int, np.ndarray, int]]:
    """Order, buckets of its n-grams and letters of successive parts of one text, all but letters taken as spaces; each n-gram comes once."""
    carry, a = np.zeros(0, np.uint32), 0
    while a < len(raw):
        b = min(a + part, len(raw))
        while b < len(raw) and raw[b] & 0xC0 == 0x80:  # between characters
            b += 1
        points, rows, letter = characters(raw[a:b], np.array([0, b - a]))
        joined = np.concatenate([carry, np.where(letter, points, np.uint32(32))])
        for n in orders:
            own = joined[max(len(carry) - n + 1, 0) :]
            h, _ = hashed(own, np.array([0, len(own)]), n, bits)
            yield n, h[h < 1 << bits], int(letter.sum())
        carry, a = joined[-(max(orders) - 1) :] if max(orders) > 1 else joined[:0], b
