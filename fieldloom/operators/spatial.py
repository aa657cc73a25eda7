"""Periodic spherical range joins by grid cells.

A ball is expanded into the ids of the cells it can touch and joined to points on the cell
id, with the exact minimum-image test kept in the join condition. The side of a cell is tied
to the largest ball, so a ball expands to a bounded number of cells. The join is by sorting: Spark
reckons the ball side as if it were not expanded, and would broadcast it far beyond the size that it allows.

Where no largest radius is named, balls are classed by powers of two of their radius, and each class has cells of its own width: a
catalogue of very unequal balls is a union of equi-joins, in one join on class and cell. Points are repeated for the classes that occur, which a
subquery of the same plan finds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOX_SIZE
from ..functions.geometry import min_image, norm3, wrap

POINT = ("x", "y", "z")
CENTRE = ("hx", "hy", "hz")


#: Cells along one side where the points and balls of a cell meet as arrays.
CELLS = 10

#: Most halvings of the box: cell numbers then fit into 60 bits.
LEVELS = 20


def cells_per_side(max_radius: float, box: float = BOX_SIZE, per_radius: float = 2.0) -> int:
    """Cells along one side when a cell is ``max_radius / per_radius`` wide."""
    return max(1, min(1 << LEVELS, int(per_radius * box / max_radius)))


def radius_class(radius: Column, box: float = BOX_SIZE) -> Column:
    """The power of two of cells along one side whose width is between half the radius and the radius."""
    c = F.floor(F.log2(F.lit(2.0 * box) / F.greatest(radius, F.lit(box * 2.0**-LEVELS))))
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), c)).cast("int")


def largest_cells(balls: DataFrame, radius: Column, box: float) -> Column:
    """Cells along one side for the largest ball, as a subquery of the plan that uses it."""
    n = F.floor(F.lit(2.0 * box) / F.max(radius))
    return balls.agg(F.greatest(F.lit(1).cast("long"), F.least(F.lit(1 << LEVELS).cast("long"), F.coalesce(n, F.lit(1).cast("long")))).alias("n")).scalar()


def point_cell(cols: tuple[str, str, str], n: Column, box: float) -> Column:
    """Cell of a position in [0, box)."""
    top, c = n.cast("long") - 1, []
    for k in cols:
        c.append(F.greatest(F.lit(0).cast("long"), F.least(top, F.floor(F.col(k) / (F.lit(box) / n)))))
    return (c[0] * n + c[1]) * n + c[2]


def expand_balls(balls: DataFrame, radius: Column, n: Column, box: float, cols: tuple[str, str, str] = CENTRE) -> DataFrame:
    """One row per touched cell and image of the ball: ``_cell`` and the image's centre _c0, _c1, _c2.

    A cell left of the box sees the ball's image one box further right, and so on. The image is
    settled here, on the short side, so the pair test is a plain distance.
    """
    n = n.cast("long")
    side = F.lit(box) / n
    reach = F.least(radius, F.lit(box / 2))
    out = balls.withColumn("_pad", reach * F.lit(1.0 + 1e-9) + F.lit(1e-9))
    gaps, ids = [], []
    for k, c in enumerate(cols):
        pos = wrap(F.col(c), box)
        lo = F.floor((pos - F.col("_pad")) / side)
        hi = F.floor((pos + F.col("_pad")) / side)
        out = out.withColumn(f"_i{k}", F.explode(F.sequence(lo, hi)))
        i = F.col(f"_i{k}")
        out = out.withColumn(f"_c{k}", pos - F.floor(i / n) * F.lit(box))
        gaps.append(F.greatest(i * side - pos, pos - (i + 1) * side, F.lit(0.0)))
        ids.append(F.pmod(i, n))
    # a ball wider than the box also reaches the corners beyond half a box
    corner = F.when(radius >= F.lit(box / 2), F.lit(box)).otherwise(F.col("_pad"))
    out = out.where(norm3(*gaps) <= corner + F.lit(1e-6))
    out = out.withColumn("_cell", (ids[0] * n + ids[1]) * n + ids[2])
    return out.drop("_pad", "_i0", "_i1", "_i2")


def ball_join(
    points: DataFrame,
    balls: DataFrame,
    radius: Column,
    *,
    box: float = BOX_SIZE,
    max_radius: float | None = None,
    how: str = "inner",
    strict: bool = False,
    salt: int = 1,
    wrapped: bool = True,
    point_cols: tuple[str, str, str] = POINT,
    centre_cols: tuple[str, str, str] = CENTRE,
    extra: Column | None = None,
    distance: str = "d",
    offsets: bool = False,
) -> DataFrame:
    """Points within ``radius`` of ball centres (``how`` = inner, left, left_semi or left_anti).

    Point coordinates lie in [0, box), or are brought there with ``wrapped=False``. ``max_radius``
    sets the cell width; a larger radius is an error. Without it an inner join has a width for each class of radii, and the other kinds,
    which need each point once, take the width of the largest ball. ``salt`` > 1 spreads the points of a crowded
    cell over that many keys, the balls being repeated for each. ``offsets`` keeps the
    displacement from the centre as dx, dy, dz.
    """
    left, right = points, balls.withColumn("_radius", radius)
    if not wrapped:
        for c in point_cols:
            left = left.withColumn(c, wrap(F.col(c), box))
    keys, classed = F.lit(True), max_radius is None and how == "inner"
    if max_radius is not None:
        ok = F.col("_radius").isNull() | (F.col("_radius") <= F.lit(max_radius * (1 + 1e-9)))
        right = right.withColumn("_radius", F.when(ok, F.col("_radius")).otherwise(F.raise_error(F.lit("ball radius above max_radius"))))
        n_left = n_right = F.lit(cells_per_side(max_radius, box)).cast("long")
    elif classed:
        right = right.withColumn("_bclass", radius_class(F.col("_radius"), box))
        classes = balls.agg(F.sort_array(F.collect_set(radius_class(radius, box))).alias("c")).scalar()  # LEVELS + 1 at most
        left = left.withColumn("_class", F.explode(classes))
        keys = F.col("_class") == F.col("_bclass")
        n_left, n_right = (F.pow(F.lit(2.0), F.col(c)).cast("long") for c in ("_class", "_bclass"))
    else:
        left, right = left.withColumn("_n", largest_cells(balls, radius, box)), right.withColumn("_bn", largest_cells(balls, radius, box))
        n_left, n_right = F.col("_n"), F.col("_bn")
    left = left.withColumn("_cell", point_cell(point_cols, n_left, box))
    right = expand_balls(right, F.col("_radius"), n_right, box, centre_cols)
    right = right.withColumnRenamed("_cell", "_bcell")
    keys = (F.col("_cell") == F.col("_bcell")) & keys if classed else F.col("_cell") == F.col("_bcell")
    if salt > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*point_cols), F.lit(salt)))
        right = right.withColumn("_bsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        keys = keys & (F.col("_salt") == F.col("_bsalt"))
    d = [F.col(p) - F.col(f"_c{k}") for k, p in enumerate(point_cols)]
    dist = norm3(*d)
    cond = keys & ((dist < F.col("_radius")) if strict else (dist <= F.col("_radius")))
    if max_radius is None or max_radius >= box / 2:  # only then can two images of one ball hold the same point
        for c in d:
            cond = cond & (c >= F.lit(-box / 2)) & (c < F.lit(box / 2))
    if extra is not None:
        cond = cond & extra
    out = left.join(right.hint("merge"), cond, how)  # its size is reckoned before balls become cells, so the cells would be broadcast
    if how in ("inner", "left"):
        out = out.withColumn(distance, dist)
        if offsets:
            out = out.withColumns(dict(zip(("dx", "dy", "dz"), d)))
    return out.drop("_cell", "_bcell", "_radius", "_salt", "_bsalt", "_c0", "_c1", "_c2", "_class", "_bclass", "_n", "_bn")


def in_cells(
    points: DataFrame, balls: DataFrame, radius: Column, run: Callable[[pa.Table, pa.Table], pa.Table], shape: str,
    *, max_radius: float | None = None, box: float = BOX_SIZE, cells: int = CELLS, within: Sequence[str] = (),
) -> DataFrame:
    """``run(points, balls)`` for the points of each cell and the balls that touch it, as Arrow tables; ``shape`` is the schema of its rows.

    Balls have ``_radius`` and their image's centre _c0, _c1, _c2 besides their columns; points without a place take no part. So nothing is shuffled
    but a row per point and one per ball and touched cell. ``within`` names columns in which both have to agree.
    """
    n = F.lit(cells).cast("long")
    placed = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    sized = balls.withColumn("_radius", radius.cast("double")).where(F.col("_radius") >= 0)
    if max_radius is not None:
        ok = F.col("_radius") <= F.lit(max_radius * (1 + 1e-9))
        sized = sized.withColumn("_radius", F.when(ok, F.col("_radius")).otherwise(F.raise_error(F.lit("ball radius above max_radius"))))
    left = placed.withColumn("_cell", point_cell(POINT, n, box)).groupBy("_cell", *within)
    return left.cogroup(expand_balls(sized, F.col("_radius"), n, box).groupBy("_cell", *within)).applyInArrow(run, shape)


def columns(table: pa.Table, names: Sequence[str]) -> list[np.ndarray]:
    """Columns as arrays of doubles, NULLs as NaN."""
    return [table.column(c).to_numpy().astype(float) for c in names]


def each_ball(xyz: Sequence[np.ndarray], balls: pa.Table, box: float, strict: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(ball, points inside, distances, offsets) for each ball that holds a point; ``xyz`` is sorted by its first axis."""
    c0, c1, c2, radius = columns(balls, ("_c0", "_c1", "_c2", "_radius"))
    low, high = np.searchsorted(xyz[0], c0 - radius - 1e-6), np.searchsorted(xyz[0], c0 + radius + 1e-6)
    for j in np.flatnonzero(low < high).tolist():
        part = slice(low[j], high[j])
        d = [x[part] - c for x, c in zip(xyz, (c0[j], c1[j], c2[j]))]
        q = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        near = np.flatnonzero(q <= radius[j] * radius[j] * (1 + 1e-9))
        if not len(near):
            continue
        r = np.sqrt(q[near])
        inside = r < radius[j] if strict else r <= radius[j]
        if radius[j] >= box / 2:  # only then can two images of one ball hold the same point
            for v in d:
                inside &= (v[near] >= -box / 2) & (v[near] < box / 2)
        if not inside.all():
            near, r = near[inside], r[inside]
        if len(near):
            yield j, near + low[j], r, [v[near] for v in d]


def covered_cells(balls: DataFrame, radius: Column, n: int, box: float = BOX_SIZE) -> DataFrame:
    """(_cell) of the n^3 cells whose centre lies in a ball, once each; balls are reduced to cells where they are read."""
    side = box / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, found, held = (np.arange(n) + 0.5) * side, [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["_cell"])
        for batch in batches:
            for *at, reach in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)):
                axes, squares = [], []
                for c in at:
                    some = np.unique(np.arange(int((c - reach) // side) - 1, int((c + reach) // side) + 2) % n) if 2 * reach + 4 * side < box else np.arange(n)
                    d = centre[some] - c
                    d -= box * np.rint(d / box)
                    axes.append(some)
                    squares.append(d * d)
                q = squares[0][:, None, None] + squares[1][None, :, None] + squares[2][None, None, :]
                ids = (axes[0][:, None, None] * n + axes[1][None, :, None]) * n + axes[2][None, None, :]
                found.append(ids[np.sqrt(q) <= reach])
                held += len(found[-1])
                if held > 1 << 20:
                    yield out()
                    found, held = [], 0
        if found:
            yield out()

    sized = balls.select(*[F.col(c).cast("double") for c in CENTRE], radius.cast("double").alias("_radius"))
    whole = sized.where(F.col("hx").isNotNull() & F.col("hy").isNotNull() & F.col("hz").isNotNull() & (F.col("_radius") >= 0))
    return whole.mapInArrow(run, "_cell long").distinct()


def in_sphere(points: DataFrame, centre: tuple[float, float, float], radius: float, box: float = BOX_SIZE) -> DataFrame:
    """Points within one sphere; per-axis bounds come first so that sorted files can be skipped."""
    out = points
    for c, v in zip(POINT, centre):
        lo, hi = v - radius, v + radius
        if lo >= 0 and hi <= box:
            out = out.where((F.col(c) >= lo) & (F.col(c) <= hi))
    d = norm3(*[min_image(F.col(c) - F.lit(v), box) for c, v in zip(POINT, centre)])
    return out.withColumn("d", d).where(F.col("d") <= radius)


def spatial_match(
    first: DataFrame, second: DataFrame, *, reach: float = 1.0, ratio: tuple[float, float] = (0.2, 5.0), box: float = BOX_SIZE
) -> DataFrame:
    """Nearest second-catalogue halo within reach*R200 and an open mass-ratio range.

    first: id1, x, y, z, r1, m1.  second: id2, hx, hy, hz, m2.  Ties go to the lowest id2.
    """
    kinds = {**dict(first.dtypes), **dict(second.dtypes)}
    shape = f"id1 {kinds['id1']}, d double, id2 {kinds['id2']}, ratio double"

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        order = np.argsort(a.column("x").to_numpy(), kind="stable")
        x, y, z, m2 = (v[order] for v in columns(a, (*POINT, "m2")))
        (m1,) = columns(b, ("m1",))
        ball, point, distance, quotient = ([np.zeros(0, t)] for t in (np.int64, np.int64, float, float))
        for j, at, d, _ in each_ball((x, y, z), b, box):
            with np.errstate(all="ignore"):
                q = m2[at] / m1[j]
            ok = (q > ratio[0]) & (q < ratio[1])
            if ok.any():
                ok &= d == d[ok].min()  # equal ones are told apart below
                ball.append(np.full(int(ok.sum()), j))
                point.append(order[at[ok]])
                distance.append(d[ok])
                quotient.append(q[ok])
        rows = [b.column("id1").take(pa.array(np.concatenate(ball))), pa.array(np.concatenate(distance)), a.column("id2").take(pa.array(np.concatenate(point))), pa.array(np.concatenate(quotient))]
        return pa.Table.from_arrays(rows, ["id1", "d", "id2", "ratio"])

    found = in_cells(
        second.select("id2", F.col("hx").alias("x"), F.col("hy").alias("y"), F.col("hz").alias("z"), "m2"),
        first.select("id1", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("z").alias("hz"), "r1", "m1"),
        F.col("r1") * F.lit(reach),
        nearest,
        shape,
        box=box,
    )
    best = found.groupBy("id1").agg(F.min(F.struct("d", "id2", "ratio")).alias("b"))
    return best.select("id1", F.col("b.id2").alias("id2"), F.col("b.d").alias("separation"), F.col("b.ratio").alias("ratio"))
