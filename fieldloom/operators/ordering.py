"""Order statistics that never put one whole group into one task.

Rows of a group are first counted per distinct value, cut into slices, and ranked inside each
slice with the slice's exact offset added. A value is a cut point when its hash is a multiple of
``SLICE_ROWS``: the number of slices grows with the group, a slice holds that many values in the
mean, and any run of the plan finds the same ones. They only steer how the work is spread; every
rank and quantile is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that a slice holds in the mean, and so the rows that one window task ranks.
SLICE_ROWS = 1 << 18
#: Slices of one coarse slice. Rows meet the coarse cut points of their group, then the fine ones of their coarse slice, so the
#: arrays they are joined to stay short: of a trillion rows, some 8,000 and 512 points.
_STEP = 512


def sliced(df: DataFrame, keys: Sequence[str], order: Column, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with the coarse slice ``_hi`` and the slice ``_lo`` inside it; equal ``order`` gives equal slices, and slices ascend with it."""
    keys = list(keys)
    multiple_of = lambda n: F.pmod(F.xxhash64("_o"), F.lit(n)) == 0
    below = lambda points: F.size(F.filter(F.coalesce(points, F.array()), lambda c: c < F.col("_o")))
    rows = df.withColumn("_o", order)
    cuts = rows.select(*keys, "_o").where(multiple_of(slice_rows)).distinct()
    # the cut points of a group, one row in SLICE_ROWS, are few enough for one window
    earlier = Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("_is", multiple_of(slice_rows * _STEP)).withColumn("_hi", F.count_if("_is").over(earlier).cast("int"))
    points = lambda chosen: F.array_sort(F.collect_list(F.when(chosen, F.col("_o")))).alias("_points")
    coarse = cuts.groupBy(*keys).agg(points(F.col("_is")))
    rows = (rows.join(coarse, keys, "left") if keys else rows.crossJoin(F.broadcast(coarse))).withColumn("_hi", below(F.col("_points"))).drop("_points")
    fine = cuts.groupBy(*keys, "_hi").agg(points(F.lit(True)))
    return rows.join(fine, [*keys, "_hi"], "left").withColumn("_lo", below(F.col("_points"))).drop("_points", "_o")


def before_slices(totals: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """(keys, _hi, _lo, _off, _total): the sum of ``amount`` in the slices before, and in all; coarse slices first, so no window takes all slices of a group."""
    keys = list(keys)
    at = lambda by, last: Window.partitionBy(*by).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.groupBy(*keys, "_hi").agg(F.sum(amount).alias("_all"))
    heads = sums.select(*keys, "_hi", F.coalesce(F.sum("_all").over(at(keys, "_hi")), F.lit(0)).alias("_head"), F.sum("_all").over(Window.partitionBy(*keys)).alias("_total"))
    inner = totals.withColumn("_in", F.coalesce(F.sum(amount).over(at([*keys, "_hi"], "_lo")), F.lit(0)))
    return inner.join(heads, [*keys, "_hi"]).select(*keys, "_hi", "_lo", (F.col("_head") + F.col("_in")).alias("_off"), "_total")


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(keys, value, n, before, total): how many rows of the group lie strictly below ``value``.

    The cut points and the group size come from the same counts the rows come from, so all
    sides of the joins read one shuffle.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    rows = sliced(counts, keys, F.col(value), slice_rows)
    totals = rows.groupBy(*keys, "_hi", "_lo").agg(F.sum("_n").alias("_t"))
    offsets = before_slices(totals, keys, "_t")
    inside = Window.partitionBy(*keys, "_hi", "_lo").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, [*keys, "_hi", "_lo"])
    return ranked.select(*keys, value, F.col("_n").alias("n"), (F.col("_off") + F.col("_in")).alias("before"), F.col("_total").alias("total"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Linear-interpolation quantiles per group; NULLs are skipped."""
    keys = list(keys)
    aggs: list[Column] = []
    for p, name in zip(probs, names):
        pos = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
        frac = F.max(pos - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return ranked_values(df, keys, value, slice_rows).groupBy(*keys).agg(*aggs)


def row_ranks(df: DataFrame, order: str, tie: str, slice_rows: int = SLICE_ROWS, name: str = "rank") -> DataFrame:
    """0-based position of every row in the order (order, tie), without a single global sort task.

    Cut points are pairs of both columns, so a very common value of ``order`` is cut by ``tie``.
    """
    rows = sliced(df, [], F.struct(F.col(order).alias("a"), F.col(tie).alias("b")), slice_rows)
    offsets = before_slices(rows.groupBy("_hi", "_lo").agg(F.count(F.lit(1)).alias("_t")), [], "_t")
    inside = Window.partitionBy("_hi", "_lo").orderBy(order, tie)
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(offsets, ["_hi", "_lo"])
        .withColumn(name, F.col("_off") + F.col("_in"))
        .drop("_hi", "_lo", "_off", "_in", "_total")
    )


def rolling(df: DataFrame, x: str, y: str, tie: str, window: int, statistic: str = "mean", chunk: int = 4096) -> DataFrame:
    """Mean or median of ``y`` over ``window`` consecutive rows in x order, full windows only.

    Ranks are cut into chunks; the first window-1 rows of a chunk are also sent to the chunk
    before it, so that each window is complete inside one chunk.
    """
    chunk = max(chunk, window)
    ranked = row_ranks(df.select(x, y, tie), x, tie)
    home = F.floor(F.col("rank") / chunk)
    spread = ranked.withColumn(
        "_chunk",
        F.explode(
            F.when((F.col("rank") % chunk < window - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
        ),
    )
    ahead = Window.partitionBy("_chunk").orderBy("rank").rowsBetween(0, window - 1)
    stat = F.avg(y).over(ahead) if statistic == "mean" else F.percentile(y, F.lit(0.5)).over(ahead)
    return (
        spread.select(
            "rank",
            "_chunk",
            F.avg(x).over(ahead).alias("x_out"),
            stat.alias("y_out"),
            F.count(F.lit(1)).over(ahead).alias("_w"),
        )
        .where((F.col("_w") == window) & (F.floor(F.col("rank") / chunk) == F.col("_chunk")))
        .select("rank", "x_out", "y_out")
    )
