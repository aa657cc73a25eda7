"""Byte and word codes of Arrow text columns, with numpy and without Python strings.

A span's code is a polynomial over its bytes modulo 2**64, read off one cumulative sum, then mixed. Equal spans have equal codes; two
different ones agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once, if a single text isn't longer.
BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit codes, another one for each seed."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


VALUES = mix(np.arange(256, dtype=np.uint64), 7)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        m = max(n, BLOCK + 1)
        _POWERS["up"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, _BASE)]))
        down = np.uint64(pow(int(_BASE), -1, 2**64))
        _POWERS["down"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, down)]))
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Codes:
    """Codes of any span of a byte array."""

    def __init__(self, data: np.ndarray, values: np.ndarray = VALUES) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[:-1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Unmixed; spans of different lengths need their length mixed in."""
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]

    def every(self, length: int) -> np.ndarray:
        """Of all spans of one length, by their start."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets within them): runs of rows of at most ``most`` bytes, or one longer row."""
    data, offsets = raw(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row offsets): the byte span of each word, and where each row's words begin among them. ``space``: bytes between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~space[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = ink[cut]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = ink[cut]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    return lo, hi, np.searchsorted(lo, offsets)


def word_codes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, lower: bool = True) -> np.ndarray:
    c = Codes(data, VALUES[LOWER] if lower else VALUES)
    return mix(c.of(lo, hi) + (hi - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of runs of ``size`` words, by the first; they run on over row ends, which the caller has to leave out."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(0x9FB21C651E98DF25) + codes[k : k + n]
    return mix(out, size)


def window_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values, by doubling."""
    if len(x) < size:
        return x[:0]
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = size - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
