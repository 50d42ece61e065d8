"""Texts of an Arrow batch as numpy arrays: words, lines, and hashes of any span, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(20240229)
#: A fixed random 64-bit number for each byte; spans are hashed as polynomials over these, modulo 2**64.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z lower-cased.
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are worked on in pieces of about so many bytes (one longer text is a piece of its own): a piece's arrays take some 60 times as much.
PIECE = 1 << 18


def lut(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


IS_SPACE = lut(SPACES)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size > 4 * PIECE:
            return have
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows whose texts have about limit bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, places, data = column.buffers()
    offs = np.frombuffer(places, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Spans:
    """Hashes of spans of some bytes by one prefix sum."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[data] * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word, in order."""
    solid = ~IS_SPACE[data]
    n = len(data)
    first, last = solid.copy(), solid.copy()
    if n:
        edge = offs[(offs > 0) & (offs < n)]
        first[1:] &= ~solid[:-1]
        first[edge] = solid[edge]
        last[:-1] &= ~solid[1:]
        last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each line: the parts of a text between line feeds."""
    cuts = np.flatnonzero(data == 10)
    doc = np.searchsorted(offs, cuts, "right") - 1
    start = np.concatenate([offs[:-1], cuts + 1])
    end = np.concatenate([offs[1:], cuts])
    owner = np.concatenate([np.arange(len(offs) - 1), doc])
    order = np.lexsort((start, owner))
    start = start[order]
    owner = owner[order]
    order = np.lexsort((end, np.concatenate([np.arange(len(offs) - 1), doc])))
    return start, end[order], owner


def per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the flagged bytes each document has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def grams(word: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window of n words inside one document."""
    if len(word) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = len(word) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xA24BAED4963EE407) + word[k : k + size]
    at = np.flatnonzero(doc[:size] == doc[n - 1 :])
    return at, mix(total[at])


def seeded(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The hashes, told apart by document."""
    return mix(hashes + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal key anywhere, has an equal key before it) for each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    some, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    some[order[1:]] = same
    some[order[:-1]] |= same
    return some, later


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in a window of n words that starts at one of the places."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0
