"""Grids as blocks, for operators that work along one axis after the other.

Pixels enter once: a strip of whole lines meets in one group, is transformed along the lines and cut across them into blocks. A block is a row with
the offsets and sizes of its place and its values as one binary; regrouping blocks by the other axis transposes the grid. So between
two passes a grid moves as blocks of many values, not as pixels, and all fields of a pass move together. Real fields are carried as half
spectra. A group holds about ``STRIP`` values a field, whatever the size of the grid (lines of up to ``STRIP`` pixels).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of one field in a group, about.
STRIP = 1 << 18

#: (fields, ...) and the offset of each axis -> the same shape but for the axis worked along.
BlockFn = Callable[[np.ndarray, dict[str, int]], np.ndarray]
#: index of the first axis, index of the second -> the factor of each output field at those modes.
FactorFn = Callable[[np.ndarray, np.ndarray], Sequence[np.ndarray]]


def _typed(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)


def _shape(axes: Sequence[str]) -> list[str]:
    return [*(f"o_{a}" for a in axes), *(f"s_{a}" for a in axes)]


def _blocks_schema(df: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> str:
    return _typed(df, keys) + "".join(f"{c} int, " for c in _shape(axes)) + "complex boolean, data binary"


def _cut(values: np.ndarray, key: tuple, keys: Sequence[str], axes: Sequence[str], at: dict[str, int], along: str, size: int) -> pd.DataFrame:
    """``values`` as rows of blocks of ``size`` along one axis."""
    axis, out = 1 + list(axes).index(along), []
    for s in range(0, values.shape[axis], size):
        part = np.ascontiguousarray(values.take(range(s, min(s + size, values.shape[axis])), axis=axis))
        out.append((*key, *((at | {along: s})[a] for a in axes), *part.shape[1:], np.iscomplexobj(part), part.tobytes()))
    return pd.DataFrame(out, columns=[*keys, *_shape(axes), "complex", "data"])


def _joined(pdf: pd.DataFrame, axes: Sequence[str], along: str) -> tuple[np.ndarray, dict[str, int]]:
    """A group's blocks side by side along one axis."""
    pdf = pdf.sort_values(f"o_{along}")
    parts = []
    for row in pdf.itertuples(index=False):
        shape = [getattr(row, f"s_{a}") for a in axes]
        parts.append(np.frombuffer(row.data, complex if row.complex else float).reshape(-1, *shape))
    return np.concatenate(parts, axis=1 + list(axes).index(along)), {a: int(pdf[f"o_{a}"].iloc[0]) for a in axes} | {along: 0}


def from_pixels(pixels: DataFrame, keys: Sequence[str], axes: Sequence[str], n: int, values: Sequence[str], fn: BlockFn, width: int) -> DataFrame:
    """The pass along the last axis: pixels (absent ones are zero) to blocks of ``width`` along it."""
    keys, axes, values = list(keys), list(axes), list(values)
    *others, along = axes
    high = {a: 1 for a in others} | {others[-1]: max(1, STRIP // n)}

    def strip(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, start = key[: len(keys)], dict(zip(others, (int(x) for x in key[len(keys) :]), strict=True))
        field = np.zeros((len(values), *(min(high[a], n - start[a]) for a in others), n))
        place = tuple(pdf[a].to_numpy(np.int64) - start.get(a, 0) for a in axes)
        for c, v in enumerate(values):
            field[(c, *place)] = pdf[v].to_numpy(float)
        return _cut(fn(field, start | {along: 0}), own, keys, axes, start, along, width)

    starts = [(F.floor(F.col(a) / high[a]) * high[a]).cast("int").alias(f"o_{a}") for a in others]
    rows = pixels.select(*keys, *axes, *[F.col(v).cast("double").alias(v) for v in values])
    return rows.groupBy(*keys, *starts).applyInPandas(strip, _blocks_schema(pixels, keys, axes))


def along(blocks: DataFrame, keys: Sequence[str], axes: Sequence[str], axis: str, fn: BlockFn, width: int) -> DataFrame:
    """A pass along another axis: blocks to blocks of ``width`` along it."""
    keys, axes = list(keys), list(axes)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        field, at = _joined(pdf, axes, axis)
        return _cut(fn(field, at), key[: len(keys)], keys, axes, at, axis, width)

    others = [f"o_{a}" for a in axes if a != axis]
    return blocks.groupBy(*keys, *others).applyInPandas(one, _blocks_schema(blocks, keys, axes))


def to_pixels(blocks: DataFrame, keys: Sequence[str], axes: Sequence[str], axis: str, fn: BlockFn, out: Sequence[str]) -> DataFrame:
    """The last pass: blocks to pixels with the columns ``out``."""
    keys, axes, out = list(keys), list(axes), list(out)

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        field, at = _joined(pdf, axes, axis)
        done = fn(field, at)
        places = np.indices(done.shape[1:]).reshape(len(axes), -1)
        columns = dict(zip(keys, key[: len(keys)], strict=True)) | {a: (p + at[a]).astype(np.int32) for a, p in zip(axes, places, strict=True)}
        return pd.DataFrame(columns | {c: done[k].ravel() for k, c in enumerate(out)}, columns=[*keys, *axes, *out])

    others = [f"o_{a}" for a in axes if a != axis]
    shape = _typed(blocks, keys) + "".join(f"`{a}` int, " for a in axes) + ", ".join(f"`{c}` double" for c in out)
    return blocks.groupBy(*keys, *others).applyInPandas(last, shape)


def signed(index: np.ndarray, n: int) -> np.ndarray:
    """Integer frequencies of transform indices, -n/2 .. n/2-1."""
    return np.where(index < (n + 1) // 2, index, index - n).astype(float)


def mode_powers(pixels: DataFrame, keys: Sequence[str], axes: Sequence[str], n: int, value: str) -> DataFrame:
    """|FFT|^2 of a real field over its half spectrum: axes, ``power``, ``m2`` (squared length of the integer mode) and ``weight``, the number of
    modes (one, or two with the mirrored one) that a row stands for."""
    axes = list(axes)
    *others, half = axes
    width = max(1, STRIP // n)

    def spectrum(axis: str) -> BlockFn:
        return lambda field, at: np.fft.fft(field, axis=1 + axes.index(axis))

    def powers(field: np.ndarray, at: dict[str, int]) -> np.ndarray:
        f = np.fft.fft(field, axis=1)[0]
        m2 = sum(signed(k + at[a], n) ** 2 for a, k in zip(axes, np.indices(f.shape), strict=True))
        j = np.arange(f.shape[-1]) + at[half]
        weight = np.broadcast_to(np.where((j == 0) | (2 * j == n), 1.0, 2.0), f.shape)
        return np.stack([f.real**2 + f.imag**2, m2, weight])

    blocks = from_pixels(pixels, keys, axes, n, [value], lambda field, at: np.fft.rfft(field, axis=-1), width)
    for a in reversed(others[1:]):
        blocks = along(blocks, keys, axes, a, spectrum(a), max(1, STRIP // (n * width)))
    return to_pixels(blocks, keys, axes, others[0], powers, ["power", "m2", "weight"])


def filtered(pixels: DataFrame, keys: Sequence[str], n: int, values: Sequence[str], out: Sequence[str], factors: FactorFn, axes: Sequence[str] = ("i", "j")) -> DataFrame:
    """Real fields of multiples of a spectrum: one forward and one inverse pair of passes for all of them.

    ``factors`` gives a factor for each pair of an output and an input field, outputs first; an output is the real part of the inverse
    transform of the sum of its inputs times their factors.
    """
    axes, (i, j) = list(axes), axes

    def multiply(field: np.ndarray, at: dict[str, int]) -> np.ndarray:
        ki, kj = np.arange(n), at[j] + np.arange(field.shape[2])
        here, mirrored = factors(ki, kj), factors(-ki % n, -kj % n)
        # the part of a factor that keeps fields real: at the highest frequency a mode is its own mirror image
        both = np.stack([(a + np.conj(b)) / 2 for a, b in zip(here, mirrored, strict=True)]).reshape(len(out), len(values), n, len(kj))
        return np.fft.ifft((both * np.fft.fft(field, axis=1)).sum(axis=1), axis=1)

    strip = max(1, STRIP // n)
    blocks = from_pixels(pixels, keys, axes, n, values, lambda field, at: np.fft.rfft(field, axis=-1), strip)
    blocks = along(blocks, keys, axes, i, multiply, strip)
    return to_pixels(blocks, keys, axes, j, lambda field, at: np.fft.irfft(field, n, axis=-1), out)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights out to ``truncate`` sigmas."""
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return [float(v) for v in w / w.sum()]


def convolved(field: np.ndarray, weights: Sequence[float], axis: int, mode: str) -> np.ndarray:
    """``field`` convolved along one axis; beyond its edge it wraps or is reflected about the pixel edge."""
    field = np.moveaxis(field, axis, -1)
    n, r = field.shape[-1], len(weights) // 2
    at = np.arange(-r, n + r) % (n if mode == "wrap" else 2 * n)
    padded = field[..., np.where(at < n, at, 2 * n - 1 - at)]
    done = sum(w * padded[..., k : k + n] for k, w in enumerate(weights))
    return np.moveaxis(done, -1, axis)


def smooth(
    pixels: DataFrame, keys: Sequence[str], n: int, sigma: float, mode: str = "reflect", value: str = "v", axes: Sequence[str] = ("i", "j")
) -> DataFrame:
    """Separable Gaussian smoothing, cut at four sigmas; mode reflect or wrap."""
    if sigma <= 0:
        return pixels.select(*keys, *axes, value)
    weights, strip = gaussian_kernel(sigma), max(1, STRIP // n)
    blocks = from_pixels(pixels, keys, axes, n, [value], lambda field, at: convolved(field, weights, 2, mode), strip)
    return to_pixels(blocks, keys, axes, axes[0], lambda field, at: convolved(field, weights, 1, mode), [value])


def kernel_factors(taps: Sequence[tuple[int, int, float]], n: int) -> FactorFn:
    """The spectrum of a small kernel (di, dj, weight), line by line, so that no whole grid of it is held."""
    lines: dict[int, np.ndarray] = {}
    for di, dj, w in taps:
        lines.setdefault(di % n, np.zeros(n))[dj % n] += w

    def of(ki: np.ndarray, kj: np.ndarray) -> list[np.ndarray]:
        column = np.zeros((n, len(kj)), complex)
        for di, line in lines.items():
            column[di] = np.fft.fft(line)[kj]
        return [np.fft.fft(column, axis=0)[ki]]

    return of
