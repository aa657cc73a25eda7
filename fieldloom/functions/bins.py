"""Bin rules. Four edge conventions occur; each is a named ``side``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _edge_tree(x: Column, edges: Sequence[float], lo: int, hi: int, strict: bool) -> Column:
    """log2(n) comparisons per row, all inside generated code."""
    if hi - lo == 1:
        return F.lit(lo)
    mid = (lo + hi) // 2
    below = (x <= F.lit(edges[mid])) if strict else (x < F.lit(edges[mid]))
    return F.when(below, _edge_tree(x, edges, lo, mid, strict)).otherwise(_edge_tree(x, edges, mid, hi, strict))


def in_range(x: Column, edges: Sequence[float], side: str) -> Column:
    first, last = F.lit(float(edges[0])), F.lit(float(edges[-1]))
    return {
        "hist": (x >= first) & (x <= last),
        "left": (x >= first) & (x < last),
        "right": (x > first) & (x <= last),
        "below": x <= last,
    }[side]


def bin_index(x: Column, edges: Sequence[float], side: str = "hist") -> Column:
    """0-based bin of ``x``; NULL outside the edges.

    hist:  [lo, hi), the last bin closed.   left:  [lo, hi) throughout.
    right: (lo, hi].                        below: (lo, hi], values under the first edge in bin 0.
    """
    strict = side in ("right", "below")
    tree = _edge_tree(x, [float(e) for e in edges], 0, len(edges) - 1, strict)
    return F.when(in_range(x, edges, side), tree)


def with_bin(df: DataFrame, x: str, edges: Sequence[float], side: str = "hist", name: str = "bin") -> DataFrame:
    """Rows inside the edges with their bin.

    The range test is a filter on ``x`` itself. A filter on the bin number would be pushed below
    the column's definition and copy it into every comparison of the tree.
    """
    strict = side in ("right", "below")
    tree = _edge_tree(F.col(x), [float(e) for e in edges], 0, len(edges) - 1, strict)
    return df.where(in_range(F.col(x), edges, side)).withColumn(name, tree)


def uniform_bin_index(x: Column, lo: float, hi: float, n: int) -> Column:
    """Equal bins with the last one closed; exact against the edges lo + k*(hi-lo)/n."""
    return bin_index(x, [lo + k * (hi - lo) / n for k in range(n)] + [hi], "hist")


def bin_table(spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    """(bin, lo, hi): a fixed table with one row per bin."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    return spark.range(len(edges) - 1).select(
        F.col("id").cast("int").alias("bin"),
        F.element_at(arr, F.col("id").cast("int") + 1).alias("lo"),
        F.element_at(arr, F.col("id").cast("int") + 2).alias("hi"),
    )


def with_spine(df: DataFrame, n_bins: int, bin_col: str = "bin") -> DataFrame:
    """Every row of ``df`` once per bin 0..n-1 (an empty histogram skeleton)."""
    return df.withColumn(bin_col, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))


def overlapping_bins(x: Column, bins: Sequence[tuple[float, float, str]]) -> Column:
    """Labels of all half-open bins that contain ``x`` (cumulative bins overlap)."""
    tests = [
        F.when((x >= F.lit(float(lo))) & (x < F.lit(hi if math.isinf(hi) else float(hi))), F.lit(label))
        for lo, hi, label in bins
    ]
    return F.filter(F.array(*tests), lambda v: v.isNotNull())
