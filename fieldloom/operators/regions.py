"""Edge-connected regions of thresholded maps, strip by strip.

A strip of lines is labelled for all thresholds by itself: lines are cut into runs of one class, runs that touch in neighbouring lines are
linked, and links are contracted. What two strips have in common is the runs of the lines at their border. Their links join local regions
into larger ones, whose least labels are found by rounds of minimum and pointer steps over the links of all maps and thresholds
together. Regions = local ones - (linked ones - least labels). A task holds a strip, or two lines, and never a map.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Lines of a strip.
LINES = 256
#: Labels of a strip are its number times this, and on.
LABELS = 1 << 32
_MISSING = 2


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contracted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes, given links between them."""
    least = np.arange(n)
    while len(a):
        lo, hi = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        apart = lo != hi
        a, b = a[apart], b[apart]
        np.minimum.at(least, hi[apart], lo[apart])
        while (shorter := least[least]).tobytes() != least.tobytes():
            least = shorter
    return least


def labelled(classes: np.ndarray) -> np.ndarray:
    """Each pixel's region, as the number of its first run."""
    starts = np.ones(classes.shape, bool)
    starts[:, 1:] = classes[:, 1:] != classes[:, :-1]
    run = (np.cumsum(starts) - 1).reshape(classes.shape)
    touch = classes[1:] == classes[:-1]
    new = starts[1:] | starts[:-1]
    new[:, 1:] |= ~touch[:, :-1]
    new &= touch  # one link for each stretch along which two runs touch
    return contracted(run.max() + 1, run[:-1][new], run[1:][new])[run]


def _strips(keys: list[str], thresholds: Sequence[float], lines: int):
    def label(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        strip = int(key[-1])
        i, j, v = pdf["i"].to_numpy(np.int64) - strip * lines, pdf["j"].to_numpy(np.int64), pdf["v"].to_numpy(float)
        first, left = i.min(), j.min()
        shape = i.max() - first + 1, j.max() - left + 1
        out = []
        for t, threshold in enumerate(thresholds):
            classes = np.full(shape, _MISSING, np.int8)
            classes[i - first, j - left] = v > threshold
            region = labelled(classes)
            roots = classes.ravel()[np.unique(region, return_index=True)[1]]
            top, bottom = (None if row not in (0, lines - 1) else at for row, at in ((first, 0), (first + shape[0] - 1, -1)))
            edges = [None if at is None else (region[at] + strip * LABELS).tobytes() for at in (top, bottom)]
            kinds = [None if at is None else classes[at].tobytes() for at in (top, bottom)]
            out.append((*key[:-1], t, strip, int((roots == 1).sum()), int((roots == 0).sum()), int(left), edges[0], kinds[0], edges[1], kinds[1]))
        return pd.DataFrame(out, columns=[*keys, "threshold_index", "strip", "n_above", "n_below", "left", "top", "top_kind", "bottom", "bottom_kind"])

    return label


def _touching(keys: list[str]):
    """Links across one border: pixels of one class above each other."""

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = {side: (row.left, np.frombuffer(row.labels, np.int64), np.frombuffer(row.kinds, np.int8)) for side, row in zip(pdf["side"], pdf.itertuples(index=False), strict=True)}
        columns = [*keys, "threshold_index", "above", "a", "b"]
        if len(sides) < 2:
            return pd.DataFrame(columns=columns)
        (x, a, ka), (y, b, kb) = sides[0], sides[1]
        lo, hi = max(x, y), min(x + len(a), y + len(b))
        a, ka, b, kb = a[lo - x : hi - x], ka[lo - x : hi - x], b[lo - y : hi - y], kb[lo - y : hi - y]
        touch = (ka == kb) & (ka != _MISSING)
        pairs = pd.DataFrame({"above": ka[touch] == 1, "a": a[touch], "b": b[touch]}).drop_duplicates()
        for name, value in zip([*keys, "threshold_index"], key, strict=False):
            pairs[name] = value
        return pairs[columns]

    return link


def _least(links: DataFrame, within: list[str]) -> DataFrame:
    """(within, a, least): the least label that each linked label reaches."""
    both = links.select(*within, "a", "b").unionByName(links.select(*within, F.col("b").alias("a"), F.col("a").alias("b")))
    both = _written(both, "region-links")
    found = _written(both.groupBy(*within, "a").agg(F.least(F.min("b"), F.min("a")).alias("least")), "region-labels")
    while True:
        of_b = found.select(*within, F.col("a").alias("b"), F.col("least").alias("l"))
        near = both.join(of_b, [*within, "b"]).groupBy(*within, "a").agg(F.min("l").alias("l"))
        near = found.join(near, [*within, "a"]).select(*within, "a", F.least("least", "l").alias("next"), F.col("least").alias("was"))
        jump = found.select(*within, F.col("a").alias("next"), F.col("least").alias("far"))
        stepped = near.join(jump, [*within, "next"], "left").select(*within, "a", F.coalesce("far", "next").alias("least"), "was")
        stepped = _written(stepped, "region-labels")
        found = stepped.drop("was")
        if not stepped.where(F.col("least") != F.col("was")).limit(1).count():
            return found


def region_counts(pixels: DataFrame, keys: Sequence[str], thresholds: Sequence[float], lines: int = LINES, height: int | None = None) -> DataFrame:
    """n_above and n_below: the regions above and not above each threshold. ``height``: lines of a map, if known; maps of one strip have
    no borders to look at. Absent pixels belong to no region."""
    keys, within = list(keys), [*keys, "threshold_index"]
    typed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pixels.select(*keys).schema)
    shape = typed + "threshold_index int, strip long, n_above long, n_below long, left long, top binary, top_kind binary, bottom binary, bottom_kind binary"
    strips = pixels.select(*keys, "i", "j", "v", F.floor(F.col("i") / lines).alias("strip")).groupBy(*keys, "strip").applyInPandas(_strips(keys, thresholds, lines), shape)
    sums = lambda df: df.groupBy(*within).agg(F.sum("n_above").alias("n_above"), F.sum("n_below").alias("n_below"))
    if height is not None and height <= lines:
        return sums(strips)
    strips = _written(strips, "region-strips")
    side = lambda border, name, k: strips.where(F.col(name).isNotNull()).select(*within, border.alias("border"), F.lit(k).alias("side"), "left", F.col(name).alias("labels"), F.col(f"{name}_kind").alias("kinds"))
    borders = side(F.col("strip"), "bottom", 0).unionByName(side(F.col("strip") - 1, "top", 1))
    links = _written(borders.groupBy(*within, "border").applyInPandas(_touching(keys), typed + "threshold_index int, above boolean, a long, b long"), "region-borders")
    within_class = [*within, "above"]
    merged = _least(links, within_class).groupBy(*within_class).agg((F.count("*") - F.sum((F.col("a") == F.col("least")).cast("long"))).alias("fewer"))
    fewer = merged.groupBy(*within).agg(*[F.sum(F.when(F.col("above") == (k == "above"), F.col("fewer")).otherwise(0)).alias(f"fewer_{k}") for k in ("above", "below")])
    left = lambda k: (F.col(f"n_{k}") - F.coalesce(f"fewer_{k}", F.lit(0))).alias(f"n_{k}")
    return sums(strips).join(fewer, within, "left").select(*within, left("above"), left("below"))
