"""Vectorised kernels over UTF-8 text held in Arrow buffers.

Every kernel works on many documents at once: ``data`` is a byte buffer, ``offs`` the n + 1 offsets of
n documents in it. Nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)), offs


def blocks(offs: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes each, so that temporaries stay in cache."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def table(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64) | U64(1)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n of the base modulo 2**64, or of its inverse."""
    key = "inv" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) <= n:
        factors = np.full(max(n + 1, 1 << 16), _INV if inverse else _BASE, np.uint64)
        factors[0] = 1
        have = _POWERS[key] = np.multiply.accumulate(factors)
    return have[: n + 1]


@dataclass
class Words:
    """Words of some documents: byte spans, 64-bit identities, and where each document's words begin."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, values: np.ndarray) -> Words:
    """Maximal runs of bytes that ``is_word`` marks, within each document; equal ``values`` make equal words."""
    lo, hi = int(offs[0]), int(offs[-1])
    part, bounds = data[lo:hi], offs - lo
    n = len(part)
    inside = np.zeros(n + 1, np.bool_)
    inside[:n] = is_word[part]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < n]
    fresh[edges] = inside[edges]
    over = np.zeros(n + 1, np.bool_)
    over[1:] = inside[:-1] & ~inside[1:]
    cut = bounds[1:][bounds[1:] > 0]
    over[cut] = inside[cut - 1]
    start, end = np.flatnonzero(fresh), np.flatnonzero(over)
    first = np.searchsorted(start, bounds)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[part] * powers(n)[:n], out=sums[1:])
    found = mix((sums[end] - sums[start]) * powers(n, True)[start] + (end - start).astype(np.uint64))
    return Words(start, end, first, found)


def by_doc(values: np.ndarray, first: np.ndarray, op: np.ufunc, empty) -> np.ndarray:
    """``op`` reduced over each document's values."""
    out = np.full(len(first) - 1, empty, values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = op.reduceat(values, first[:-1][some])
    return out


def grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document: positions of their first words, and hashes."""
    at = np.flatnonzero(found.left() >= k)
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = h * U64(0x9FB21C651E98DF25) + found.hash[at + i]
    return at, mix(h)


def code_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Running count of UTF-8 lead bytes: at ``i``, code points that begin before byte ``i`` of ``data[offs[0]:]``."""
    part = data[int(offs[0]) : int(offs[-1])]
    out = np.zeros(len(part) + 1, np.int64)
    np.cumsum((part & 0xC0) != 0x80, out=out[1:])
    return out


#: Words between ASCII white space.
SPACE = np.ones(256, np.bool_)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, ASCII letters without regard to case, and all that is not ASCII.
ALNUM = np.zeros(256, np.bool_)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def folded(values: np.ndarray) -> np.ndarray:
    """The same table with A-Z standing for a-z."""
    out = values.copy()
    out[0x41:0x5B] = values[0x61:0x7B]
    return out
