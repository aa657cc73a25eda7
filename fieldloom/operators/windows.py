"""Ordered operators over short axes: bins, mass thresholds, radii."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, reverse: bool = False) -> DataFrame:
    """Running sum along a bin axis; reversed gives N(>= bin)."""
    w = Window.partitionBy(*keys).orderBy(order)
    w = w.rowsBetween(0, Window.unboundedFollowing) if reverse else w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def forward_difference(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, last: Column | None = None) -> DataFrame:
    """value - next value along ``order``; the last row gets value - ``last`` or NULL."""
    w = Window.partitionBy(*keys).orderBy(order)
    nxt = F.lead(value).over(w)
    return df.withColumn(out, F.col(value) - (nxt if last is None else F.coalesce(nxt, last)))


def backward_difference(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, first: Column | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    return df.withColumn(out, F.col(value) - (prev if first is None else F.coalesce(prev, first)))


def mixed_difference(df: DataFrame, keys: Sequence[str], mass: str, alpha: str, value: str) -> DataFrame:
    """Second difference of a cumulative F(M_min, alpha): one tile per mass bin and radius shell."""
    by_mass = forward_difference(df, [*keys, alpha], mass, value, "_dm")
    out = backward_difference(by_mass, [*keys, mass], alpha, "_dm", "tile")
    return out.where(F.col("tile").isNotNull()).drop("_dm")


def slope(df: DataFrame, keys: Sequence[str], x: str, value: str, out: str = "slope") -> DataFrame:
    """Forward derivative d value / d x; NULL on the last row."""
    w = Window.partitionBy(*keys).orderBy(x)
    return df.withColumn(out, F.try_divide(F.lead(value).over(w) - F.col(value), F.lead(x).over(w) - F.col(x)))


def percent_contributions(df: DataFrame, keys: Sequence[str], mass: str, value: str) -> DataFrame:
    """100 * (F(M) - F(next M)), the highest mass against zero."""
    out = forward_difference(df, keys, mass, value, "_d", F.lit(0.0))
    return out.withColumn("percent", F.col("_d") * 100.0).drop("_d")


def top_k(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.col(value).desc(), F.col(tie)).limit(k)


def interpolate(curve: DataFrame, keys: Sequence[str], x: str, y: str, points: Sequence[float], log: bool = False) -> DataFrame:
    """np.interp per group (ends clamp), optionally in log-log; (keys, x_at, y_at).

    The two nearest knots of each point are found by max and min, not by sorting.
    """
    aggs = []
    for k, p in enumerate(points):
        knot = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        aggs.append(F.max(F.when(F.col(x) <= F.lit(float(p)), knot)).alias(f"a{k}"))
        aggs.append(F.min(F.when(F.col(x) >= F.lit(float(p)), knot)).alias(f"b{k}"))
    wide = curve.groupBy(*keys).agg(*aggs)
    t = F.log10 if log else (lambda c: c)
    back = (lambda c: F.pow(F.lit(10.0), c)) if log else (lambda c: c)

    def value(k: int, p: float) -> Column:
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        w = F.try_divide(t(F.lit(float(p))) - t(a["x"]), t(b["x"]) - t(a["x"]))
        inside = back(t(a["y"]) + (t(b["y"]) - t(a["y"])) * w)
        return F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).when(a["x"] == b["x"], a["y"]).otherwise(inside)

    rows = F.array(*[F.struct(F.lit(float(p)).alias("x_at"), value(k, p).alias("y_at")) for k, p in enumerate(points)])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.x_at", "_r.y_at")


def nearest(table: DataFrame, keys: Sequence[str], x: str, target: float, payload: Sequence[str]) -> DataFrame:
    """Row whose x is closest to ``target``; the lowest payload on ties."""
    best = table.groupBy(*keys).agg(
        F.min(F.struct(F.abs(F.col(x) - F.lit(target)).alias("_d"), *[F.col(c) for c in payload])).alias("_b")
    )
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in payload])
