"""Words, lines and windows of many texts at once, as numpy arrays over their UTF-8 bytes.

Texts arrive as Arrow string columns, whose bytes lie one after another; the functions
here work on a slice of a few megabytes at a time, so memory does not depend on the
number of texts.  Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a one-to-one map)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _power_table(n: int, base: int) -> np.ndarray:
    size = 1 << max(16, int(n - 1).bit_length())
    return _powers(size, base)[:n]


class Texts:
    """A slice of texts: ``data`` bytes and ``offsets`` of each text (one more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.count = data, offsets, len(offsets) - 1

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def prefix_hash(self) -> np.ndarray:
        """Running sums from which ``span_hash`` takes the hash of any span."""
        n = len(self.data)
        out = np.zeros(n + 1, dtype=U)
        if n:
            np.cumsum((self.data.astype(U) + U(1)) * _power_table(n, _BASE), out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (prefix[end] - prefix[start]) * _power_table(len(prefix), _INVERSE)[start]
        return mix(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def equal_span_hash(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """A hash of the ``size`` bytes at every place that has as many, for one size only; its lower bits are not spread."""
        raw = prefix[size:] - prefix[:-size]
        raw *= _power_table(len(prefix), _INVERSE)[: len(raw)]
        raw *= U(0xD6E8FEB86659FD93)
        return raw

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the number of words of each text."""
        data = self.data if data is None else data
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        return self.runs(inside)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every run of marked bytes within one text, and runs per text."""
        n = len(inside)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, self.offsets))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every line (texts cut at line feeds), and the text each belongs to."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        # a line feed that ends a text opens an empty last line at the start of the next text
        owner = np.concatenate([np.arange(self.count), np.searchsorted(self.offsets, breaks, "right") - 1])
        key = np.concatenate([self.offsets[:-1], breaks + 1])
        order = np.lexsort((key, owner))
        start, owner = key[order], owner[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last = np.ones(len(start), dtype=bool)
        last[:-1] = owner[1:] != owner[:-1]
        end[last] = self.offsets[owner[last] + 1]
        return start, end, owner


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cut a string column into slices of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(raw, raw[low] + limit, "right")) - 1)
        yield low, high, Texts(data[raw[low] : raw[high]], raw[low : high + 1] - raw[low])
        low = high


def owners(counts: np.ndarray) -> np.ndarray:
    """The text of each item, given how many items each text has."""
    return np.repeat(np.arange(len(counts)), counts)


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` consecutive words of one text, and the index of its first word."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    owner = owners(counts)
    at = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
    total = np.zeros(n - size + 1, dtype=U)
    for k in range(size):
        total += hashes[k : n - size + 1 + k] * U(pow(_BASE, k + 2, 1 << 64))
    return mix(total[at]), at
