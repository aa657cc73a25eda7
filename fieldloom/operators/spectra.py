"""Power spectra: transform by passes over blocks, then radial averages in SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BOX_SIZE, FIELD_SIZE_DEG, logspace, linspace
from ..functions.bins import with_bin
from . import blocks
from .gridding import assign, overdensity

ELL_EDGES = logspace(math.log10(100), math.log10(20000), 30)


def mode_power(pixels: DataFrame, keys: Sequence[str], n: int, value: str = "v", axes: Sequence[str] = ("i", "j")) -> DataFrame:
    """|FFT|^2 of a real field over its half spectrum, with ``m2``, the squared length of the integer mode, and ``weight``, its multiplicity."""
    return blocks.mode_powers(pixels, keys, axes, n, value)


def radial_average(modes: DataFrame, keys: Sequence[str], unit: float, edges: Sequence[float], norm: float) -> DataFrame:
    """Mean power per half-open shell of |k| = unit * |mode|; only shells that hold modes."""
    binned = with_bin(modes.withColumn("k_abs", F.sqrt("m2") * F.lit(unit)), "k_abs", edges, "left")
    return binned.groupBy(*keys, "bin").agg(
        (F.sum(F.col("power") * F.col("weight")) / F.sum("weight") * F.lit(norm)).alias("power"), F.sum("weight").cast("long").alias("n_modes")
    )


def centred(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Field minus its mean."""
    mean = pixels.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return pixels.join(mean, list(keys)).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def contrast(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """v / mean - 1 for a positive mean, v - mean otherwise."""
    mean = pixels.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    v = F.when(F.col("_mean") > 0, F.col(value) / F.col("_mean") - 1).otherwise(F.col(value) - F.col("_mean"))
    return pixels.join(mean, list(keys)).withColumn(value, v).drop("_mean")


def angular_spectrum(pixels: DataFrame, keys: Sequence[str], n: int, field_deg: float = FIELD_SIZE_DEG, edges: Sequence[float] = ELL_EDGES, value: str = "v") -> DataFrame:
    """C_ell of a square map, log bins, normalised by the squared pixel size."""
    side = math.radians(field_deg)
    modes = mode_power(centred(pixels, keys, value), keys, n, value)
    return radial_average(modes, keys, 2 * math.pi / side, edges, (side / n) ** 2)


def plane_spectrum(pixels: DataFrame, keys: Sequence[str], n: int, box: float = BOX_SIZE, n_bins: int = 30, value: str = "v") -> DataFrame:
    """P(k) of the overdensity of a square field, log bins between fundamental and Nyquist."""
    edges = logspace(math.log10(2 * math.pi / box), math.log10(math.pi * n / box), n_bins + 1)
    modes = mode_power(contrast(pixels, keys, value), keys, n, value)
    return radial_average(modes, keys, 2 * math.pi / box, edges, (box / n) ** 2)


def spectrum_linear_ell(pixels: DataFrame, keys: Sequence[str], n: int, pixel_arcmin: float, n_bins: int = 50, value: str = "v") -> DataFrame:
    """C_ell with equal bins up to the largest mode; power over n^2, times pixel solid angle."""
    to_ell = 2 * math.pi * 180 * 60 / math.pi
    unit = to_ell / (n * pixel_arcmin)
    top = math.sqrt(2.0) * (n // 2) * unit
    pixel = math.radians(pixel_arcmin / 60)
    modes = mode_power(pixels, keys, n, value)
    return radial_average(modes, keys, unit, linspace(0, top, n_bins + 1), pixel * pixel / (n * n))


def spectrum_linear_k(pixels: DataFrame, keys: Sequence[str], n: int, box: float = BOX_SIZE, n_edges: int = 50, value: str = "v") -> DataFrame:
    """P(k) of the raw field, equal bins in k from zero to the largest positive frequency."""
    modes = mode_power(pixels, keys, n, value)
    return radial_average(modes, keys, 1.0, linspace(0, (n - 1) // 2, n_edges), (box / n) ** 2)


def particle_spectrum_3d(points: DataFrame, keys: Sequence[str], n: int, rule: str = "cic", box: float = BOX_SIZE) -> DataFrame:
    """3-D P(k), bin b holding modes of length [b+1, b+2) fundamentals: gridding, overdensity, three passes.

    Empty cells have overdensity -1; adding one everywhere leaves all modes but k=0 unchanged,
    so only occupied cells are carried.
    """
    cells = assign(points, ("x", "y", "z"), n, rule, keys, box)
    d = overdensity(cells, n**3, keys).withColumn("v", F.col("delta") + F.lit(1.0))
    modes = mode_power(d, keys, n, "v", ("i", "j", "k"))
    shells = math.ceil(math.sqrt(3.0) * (n // 2)) - 1
    return radial_average(modes, keys, 1.0, [float(m) for m in range(1, shells + 1)], (box / n) ** 3)


def jackknife_spectrum(pixels: DataFrame, keys: Sequence[str], n: int, patches: int = 4, box: float = BOX_SIZE, value: str = "v") -> DataFrame:
    """Spread of P(k) when each of patches^2 squares in turn is set to the map mean."""
    mean = pixels.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    width = n // patches
    row, column = F.floor(F.col("i") / width), F.floor(F.col("j") / width)
    # columns and rows left over by the division belong to no patch and are never masked
    home = F.when((row < patches) & (column < patches), row * patches + column).otherwise(-1)
    masked = (
        pixels.join(mean, list(keys))
        .withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(patches * patches - 1))))
        .withColumn(value, F.when(home == F.col("patch"), F.col("_mean")).otherwise(F.col(value)))
        .drop("_mean")
    )
    per = plane_spectrum(masked, [*keys, "patch"], n, box, value=value)
    m = patches * patches
    spread = per.groupBy(*keys, "bin").agg(F.sqrt(F.var_pop("power") * F.lit(float(m - 1))).alias("error"))
    return plane_spectrum(pixels, keys, n, box, value=value).join(spread, [*keys, "bin"])
