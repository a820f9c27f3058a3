"""Numpy helpers for Arrow batches: hashes of words, shingles and byte strings.

Hashes are polynomials over 64-bit words taken from prefix sums, so every
stretch of a text is hashed at the cost of one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread each value over all 64 bits (a bijection)."""
    h = (h ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64), 0x5851F42D4C957F2D)


BYTES = _byte_values()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse for i < n, kept for the process up to one piece's length."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _PIECE + 4096)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, dtype=np.uint64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            made = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
        if n > _PIECE + 4096:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums H of a byte string, for ``stretch``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTES[data] * up[:len(data)], out=out[1:])
    return out


def stretch(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [lo, hi)."""
    _, down = powers(len(h))
    return mix((h[hi] - h[lo]) * down[lo], 0) ^ mix((hi - lo).astype(np.uint64), 0x9E37)


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Each value's bytes, without a copy; null as empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    for i in range(len(column)):
        yield raw[at[i]:at[i + 1]]


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches of about a megabyte that end between words."""
    lo = 0
    while len(data) - lo > _PIECE:
        gap = np.flatnonzero(data[lo:lo + _PIECE] == 32)
        if len(gap):
            hi = lo + int(gap[-1]) + 1
        else:                               # one word longer than a piece
            rest = np.flatnonzero(data[lo + _PIECE:] == 32)
            hi = lo + _PIECE + (int(rest[0]) + 1 if len(rest) else len(data))
        yield data[lo:hi]
        lo = min(hi, len(data))
    yield data[lo:]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash per word of a text whose words are parted by single blanks."""
    found = []
    for piece in _pieces(data):
        ends = np.flatnonzero(piece == 32)
        starts = np.concatenate(([0], ends + 1))
        ends = np.concatenate((ends, [len(piece)]))
        real = ends > starts
        found.append(stretch(prefix(piece), starts[real], ends[real]))
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash per run of ``k`` words, in order; none for fewer words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += words[j:j + n] * np.uint64(pow(_BASE, j + 1, 1 << 64))
    return mix(out, k)


class Bloom:
    """A set of 64-bit values in a fixed number of bits; may say yes for a value not in it."""

    def __init__(self, words: dict[int, int], bits: int):
        self.bits = bits
        self.table = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for i, w in words.items():
            self.table[i] = np.uint64(w & ((1 << 64) - 1))

    def holds(self, values: np.ndarray) -> np.ndarray:
        a = values & np.uint64((1 << self.bits) - 1)
        b = (values >> np.uint64(32)) & np.uint64((1 << self.bits) - 1)
        one, low = np.uint64(1), np.uint64(63)
        at = lambda x: (self.table[(x >> np.uint64(6)).astype(np.int64)] >> (x & low)) & one
        return (at(a) & at(b)) == one


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Batches sorted by an integer ``column``, cut anew so that no group spans two tables."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(column).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(g[1:] != g[:-1]) + 1
        if rest and rest[-1].column(column)[rest[-1].num_rows - 1].as_py() != g[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def starts_of(g: np.ndarray) -> np.ndarray:
    """Where each group of a sorted column begins, and its end."""
    return np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))


def roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first member of each row's component."""
    n = len(linked)
    reach = linked | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        low = np.where(reach, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def lots(column: pa.Array, most: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """A column's texts in lots of about ``most`` bytes (one text at least)."""
    lot, held = [], 0
    for data in texts(column):
        lot.append(data)
        held += len(data)
        if held >= most:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot
