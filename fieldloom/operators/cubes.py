"""Shift and rotation of fields on three-dimensional grids.

A rotated cell pulls its value from the eight cells around the place that it comes from. Source cells are sent to cubic blocks, together with one
layer of the next blocks; each block fills the target cells whose place lies in it. So a grid is shuffled once, no target cell is a row
before it has its value, and a task holds blocks of (``WIDTH`` + 1)^3 cells, however large the grid is.

A grid is a table of keys, i, j, k and a value; absent cells and null values are zero, and repeated cells add up. Results hold the cells that are not zero.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a block along each axis.
WIDTH = 32
AXES = ("i", "j", "k")
Matrix = Sequence[Sequence[float]]


def roll(cells: DataFrame, n: int, offsets: Sequence[int]) -> DataFrame:
    """Cyclic shift of a cube by whole cells along each axis."""
    return cells.withColumns({a: F.pmod(F.col(a) + F.lit(d), F.lit(n)) for a, d in zip(AXES, offsets, strict=True)})


def about_axis(axis: int, degrees: float) -> list[list[float]]:
    """The pull matrix, from target to source, of a rotation in the plane of the two other axes, taken in ascending order."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    a, b = (x for x in range(3) if x != axis)
    out = [[float(r == q) for q in range(3)] for r in range(3)]
    out[a][a], out[a][b], out[b][a], out[b][b] = c, s, -s, c
    return out


def about_vector(direction: Sequence[float], degrees: float) -> list[list[float]]:
    """The pull matrix of a right-handed rotation about any direction."""
    x, y, z = (v / math.sqrt(sum(u * u for u in direction)) for v in direction)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    t = 1.0 - c
    return [
        [c + t * x * x, t * x * y + s * z, t * x * z - s * y],
        [t * x * y - s * z, c + t * y * y, t * y * z + s * x],
        [t * x * z + s * y, t * y * z - s * x, c + t * z * z],
    ]


def _blocks_of(c: Column, width: int) -> Column:
    """The blocks that read the cell ``c``: its own, and the one before if the cell is its first."""
    own = F.floor(c / width).cast("int")
    return F.when((F.pmod(c, F.lit(width)) == 0) & (c > 0), F.array(own - 1, own)).otherwise(F.array(own))


def _pulled(p: Sequence[np.ndarray], pull: np.ndarray, mid: float) -> list[np.ndarray]:
    x, y, z = (q - mid for q in p)
    return [m[0] * x + m[1] * y + m[2] * z + mid for m in pull]


def _fill(field: np.ndarray, start: Sequence[int], pull: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(i, j, k), values: the target cells whose place lies in the block at ``start``, not zero."""
    mid, width = (n - 1) / 2.0, field.shape[0] - 1
    corners = np.array(list(itertools.product(*((s, s + width) for s in start)))) - mid
    ends = corners @ pull + mid  # the transpose turns forward
    low, high = np.maximum(np.floor(ends.min(axis=0)), 0).astype(int), np.minimum(np.ceil(ends.max(axis=0)), n - 1).astype(int)
    p = [q.ravel() for q in np.meshgrid(*(np.arange(a, b + 1) for a, b in zip(low, high, strict=True)), indexing="ij")]
    a = _pulled(p, pull, mid)
    home = [np.floor(x).astype(int) for x in a]
    here = np.ones(len(p[0]), dtype=bool)
    for x, h, s in zip(a, home, start, strict=True):
        here &= (x >= 0) & (x <= n - 1) & (h >= s) & (h < s + width)
    p, part = [q[here] for q in p], [(x - h)[here] for x, h in zip(a, home, strict=True)]
    home = [h[here] - s for h, s in zip(home, start, strict=True)]
    out = np.zeros(len(p[0]))
    for tap in itertools.product((0, 1), repeat=3):
        weight = np.ones(len(out))
        for f, t in zip(part, tap, strict=True):
            weight = weight * (f if t else 1.0 - f)
        out += weight * field[tuple(h + t for h, t in zip(home, tap, strict=True))]
    some = out != 0
    return [q[some] for q in p], out[some]


def rotate(cells: DataFrame, n: int, pull: Matrix, keys: Sequence[str] = (), value: str = "mass", width: int = WIDTH) -> DataFrame:
    """Trilinear rotation of cubes of n^3 cells about their centre: keys, i, j, k and the value. ``pull`` leads from a target
    cell to its place in the source; cells whose place lies outside the grid are zero. The output shape is the input's."""
    keys, turn = list(keys), np.array(pull, dtype=float)
    homes = ["_bi", "_bj", "_bk"]

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, start = key[: len(keys)], [int(b) * width for b in key[len(keys) :]]
        field = np.zeros((width + 1,) * 3)
        np.add.at(field, tuple(pdf[a].to_numpy() - s for a, s in zip(AXES, start, strict=True)), pdf["_v"].to_numpy())
        p, v = _fill(field, start, turn, n)
        out = pd.DataFrame(dict(zip(AXES, p, strict=True)) | {value: v})
        for at, (name, x) in enumerate(zip(keys, own, strict=True)):
            out.insert(at, name, x)
        return out

    rows = cells.select(*keys, *[F.col(a).cast("int").alias(a) for a in AXES], F.col(value).cast("double").alias("_v")).where("_v <> 0")
    for a, b in zip(AXES, homes, strict=True):
        rows = rows.withColumn(b, F.explode(_blocks_of(F.col(a), width)))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cells.select(*keys).schema)
    return rows.groupBy(*keys, *homes).applyInPandas(block, f"{kinds}i int, j int, k int, `{value}` double")
