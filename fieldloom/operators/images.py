"""Map statistics on pixel tables (map keys, i, j, v)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_index, bin_table, with_bin, with_spine
from .blocks import STRIP, smooth
from .regions import region_counts
from .stats import density, histogram


def valid_maps(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Maps whose pixels are all finite and not constant."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = (
        pixels.groupBy(*keys)
        .agg(F.max(bad.cast("int")).alias("_bad"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .where((F.col("_bad") == 0) & (F.col("_hi") > F.col("_lo")))
    )
    return pixels.join(good.select(*keys), list(keys), "left_semi")


#: Why a map takes no part, in the order in which reasons are given.
FAULTS = ("incomplete", "not finite", "constant")


def map_faults(pixels: DataFrame, keys: Sequence[str], n: int, value: str = "v") -> DataFrame:
    """(keys, fault) for every map: one of ``FAULTS``, or NULL for a good map of n x n pixels."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    seen = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(bad.cast("int")).alias("_bad"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    fault = F.when(F.col("_n") < n * n, FAULTS[0]).when(F.col("_bad") == 1, FAULTS[1]).when(F.col("_hi") <= F.col("_lo"), FAULTS[2])
    return seen.select(*keys, fault.alias("fault"))


def ensemble(values: DataFrame, faults: DataFrame, model: str = "model") -> DataFrame:
    """(model, statistic, bin, mean, std, n_success, n_failed and a count for each fault) over the maps of each model.

    ``values`` (model, statistic, bin, value) has a row for each good map and bin of each statistic; all statistics are summed in one
    aggregation. ``faults`` (model, fault) has a row for each map. A model without a good map keeps one row, with NULLs.
    """
    of = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias("n_" + f.replace(" ", "_"))
    runs = faults.groupBy(model).agg(F.count(F.when(F.col("fault").isNull(), 1)).alias("n_success"), F.count("fault").alias("n_failed"), *[of(f) for f in FAULTS])
    sums = values.groupBy(model, "statistic", "bin").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return runs.join(sums, model, "left")


def standardise(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Adds ``snr`` = (v - mean) / population std of the map."""
    st = pixels.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    return (
        pixels.join(st, list(keys))
        .withColumn("snr", F.try_divide(F.col(value) - F.col("_mean"), F.col("_std")))
        .drop("_mean", "_std")
    )


def neighbourhood(pixels: DataFrame, keys: Sequence[str], value: str, fn: str = "max", out: str = "ext") -> DataFrame:
    """3x3 extreme around each pixel by two passes over grid lines; off-map pixels do not count."""
    agg = F.max if fn == "max" else F.min
    along_i = Window.partitionBy(*keys, "j").orderBy("i").rangeBetween(-1, 1)
    along_j = Window.partitionBy(*keys, "i").orderBy("j").rangeBetween(-1, 1)
    return pixels.withColumn(out, agg(value).over(along_i)).withColumn(out, agg(out).over(along_j))


def interior(n: int, border: int) -> Column:
    i, j = F.col("i"), F.col("j")
    return (i >= border) & (i < n - border) & (j >= border) & (j < n - border)


def extrema(pixels: DataFrame, keys: Sequence[str], n: int, value: str = "v", kind: str = "max", border: int = 0, where: Column | None = None) -> DataFrame:
    """Pixels equal to the extreme of their 3x3 surroundings; plateau pixels all count."""
    ext = neighbourhood(pixels, keys, value, kind)
    hit = F.col(value) == F.col("ext")
    if border:
        hit = hit & interior(n, border)
    if where is not None:
        hit = hit & where
    return ext.where(hit).drop("ext")


def peak_counts_snr(pixels: DataFrame, keys: Sequence[str], n: int, edges: Sequence[float], sigma: float, rms: float, kind: str = "max", border: int = 2) -> DataFrame:
    """Smoothed extrema binned by v/rms; maxima need v > 0, minima v < 0."""
    sm = smooth(pixels, keys, n, sigma)
    sign = F.col("v") > 0 if kind == "max" else F.col("v") < 0
    found = extrema(sm, keys, n, "v", kind, border, sign).withColumn("snr", F.col("v") / F.lit(rms))
    return on_all_maps(pixels, found, keys, "snr", edges)


def peak_counts_value(pixels: DataFrame, keys: Sequence[str], n: int, edges: Sequence[float], sigma: float, kind: str = "max", border: int = 2) -> DataFrame:
    """Smoothed extrema binned by value."""
    sm = smooth(pixels, keys, n, sigma)
    v = F.col("v")
    limit = v > F.lit(edges[0]) if kind == "max" else (v >= F.lit(edges[0])) & (v <= F.lit(edges[-1]))
    return on_all_maps(pixels, extrema(sm, keys, n, "v", kind, border, limit), keys, "v", edges)


def on_all_maps(pixels: DataFrame, found: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Counts per bin for every map, also for maps without any extremum."""
    counts = with_bin(found, value, edges, "hist")
    counts = counts.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = with_spine(pixels.select(*keys).distinct(), len(edges) - 1)
    return spine.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def library_peaks(pixels: DataFrame, keys: Sequence[str], n: int, threshold: float = 0.0, sigma: float = 0.0, border: int = 10) -> DataFrame:
    """Peak catalogue with snr from the map's own mean and std."""
    sm = standardise(smooth(pixels, keys, n, sigma), keys)
    return extrema(sm, keys, n, "snr", "max", border, F.col("snr") >= F.lit(threshold))


def count_errors(counts: DataFrame, edges: Sequence[float], area: float | None = None) -> DataFrame:
    """Poisson errors, and densities per area and bin width when an area is given."""
    bins = bin_table(counts.sparkSession, edges)
    out = counts.join(F.broadcast(bins), "bin")
    scale = F.lit(1.0) if area is None else F.lit(1.0) / (F.lit(area) * (F.col("hi") - F.col("lo")))
    return out.withColumn("counts", F.col("n") * scale).withColumn("errors", F.sqrt(F.col("n").cast("double")) * scale).drop("lo", "hi")


def count_ratio(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("bin",)) -> DataFrame:
    """N1/N2 with Poisson errors in quadrature; NULL where either count is zero."""
    j = a.select(*keys, F.col("n").alias("n1")).join(b.select(*keys, F.col("n").alias("n2")), list(keys))
    ratio = F.try_divide(F.col("n1").cast("double"), F.col("n2"))
    rel = F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))
    return j.withColumn("ratio", ratio).withColumn("errors", ratio * F.sqrt(rel))


def value_pdf(pixels: DataFrame, keys: Sequence[str], n: int, edges: Sequence[float], sigma: float, border: int = 5) -> DataFrame:
    """PDF of the smoothed interior; normalised by all interior pixels."""
    inner = smooth(pixels, keys, n, sigma).where(interior(n, border))
    return density(histogram(inner, keys, "v", edges), keys, edges, in_range=False)


# --- morphology ------------------------------------------------------------------


def area_and_perimeter(pixels: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Fraction of pixels above each threshold and boundary length per pixel.

    An edge between neighbours a and b counts for every threshold in [min(a,b), max(a,b)), so
    each pixel pair is reduced to a range of threshold numbers: +1 at the lower end, -1 past the
    upper one, and running sums over the thresholds. Pixels are not repeated per threshold.
    """
    th = [float(t) for t in thresholds]
    edges = [-math.inf, *th, math.inf]
    above = lambda c: bin_index(c, edges, "right")  # number of thresholds strictly below the value
    right = F.lead("v").over(Window.partitionBy(*keys, "i").orderBy("j"))
    down = F.lead("v").over(Window.partitionBy(*keys, "j").orderBy("i"))
    p = pixels.withColumn("_r", right).withColumn("_d", down)
    p = p.select(*keys, above(F.col("v")).alias("_a"), above(F.col("_r")).alias("_b"), above(F.col("_d")).alias("_c"))
    step = lambda at, area, edge: F.struct(at.alias("k"), F.lit(area).alias("da"), F.lit(edge).alias("de"))
    marks = F.array(
        step(F.lit(0), 1, 0),
        step(F.col("_a"), -1, 0),
        step(F.least("_a", "_b"), 0, 1),
        step(F.greatest("_a", "_b"), 0, -1),
        step(F.least("_a", "_c"), 0, 1),
        step(F.greatest("_a", "_c"), 0, -1),
    )
    # a missing neighbour gives least = greatest, which cancels
    deltas = p.select(*keys, F.explode(marks).alias("_m")).groupBy(*keys, F.col("_m.k").alias("k")).agg(
        F.sum("_m.da").alias("da"), F.sum("_m.de").alias("de")
    )
    n_pix = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = F.array(*[F.lit(t) for t in th])
    spine = with_spine(n_pix, len(th), "k")
    return (
        spine.join(deltas, [*keys, "k"], "left")
        .withColumn("_a", F.sum(F.coalesce("da", F.lit(0))).over(run))
        .withColumn("_e", F.sum(F.coalesce("de", F.lit(0))).over(run))
        .select(
            *keys,
            F.col("k").alias("threshold_index"),
            F.element_at(table, F.col("k") + 1).alias("threshold"),
            (F.col("_a") / F.col("_n")).alias("V0"),
            (F.col("_e") / F.col("_n")).alias("V1"),
        )
    )


def minkowski(pixels: DataFrame, keys: Sequence[str], n: int, thresholds: Sequence[float], sigma: float, border: int = 5) -> DataFrame:
    """V0 area, V1 perimeter, V2 regions minus holes, each per pixel, on the smoothed interior."""
    inner = smooth(pixels, keys, n, sigma).where(interior(n, border))
    n_pix = float((n - 2 * border) ** 2)
    v01 = area_and_perimeter(inner, keys, thresholds)
    v2 = region_counts(inner, keys, thresholds, max(1, STRIP // n), n)
    euler = F.when(F.col("n_below") > 0, F.col("n_above") - (F.col("n_below") - 1)).otherwise(F.col("n_above"))
    return v01.join(v2, [*keys, "threshold_index"]).withColumn("V2", euler / F.lit(n_pix)).drop("n_above", "n_below")


def fill_missing_with_mean(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """NaN and NULL pixels take the mean of the others."""
    ok = F.when(~F.isnan(value), F.col(value))
    mean = pixels.groupBy(*keys).agg(F.avg(ok).alias("_mean"))
    return pixels.join(mean, list(keys)).withColumn(value, F.coalesce(ok, F.col("_mean"))).drop("_mean")


_P = 2147483647  # 2**31 - 1


def add_noise(pixels: DataFrame, keys: Sequence[str], sigma: float, seed: int = 0, value: str = "v") -> DataFrame:
    """Gaussian shape noise from the pixel address (integer keys, i, j): the same after any retry and on any engine."""

    def unit(s: int) -> Column:
        h = F.lit(s % _P).cast("long")
        for c in [*keys, "i", "j"]:
            # both halves of the address part; no product passes 62 bits
            part = F.pmod(F.col(c).cast("long"), F.lit(_P)) + F.pmod(F.floor(F.col(c) / F.lit(_P)), F.lit(_P)) * 40692
            h = F.pmod(h * 48271 + F.pmod(part, F.lit(_P)) * 16807 + 12345, F.lit(_P))
            h = F.pmod(h * F.pmod(h + 69621, F.lit(_P)), F.lit(_P))
        return (F.pmod(h * F.pmod(h + 40692, F.lit(_P)), F.lit(_P)) + F.lit(0.5)) / F.lit(float(_P))

    normal = F.sqrt(F.lit(-2.0) * F.log(unit(seed))) * F.cos(F.lit(2 * math.pi) * unit(seed + 1_000_003))
    return pixels.withColumn(value, F.col(value) + F.lit(sigma) * normal)


def summary(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    return pixels.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")
    )
