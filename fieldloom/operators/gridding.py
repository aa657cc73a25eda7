"""Mass assignment onto periodic grids through per-cell moments.

The weights of the cloud-in-cell and triangular-shaped-cloud rules are polynomials in the
particle's offset inside its home cell. So the particles are first reduced to a few moments
per home cell, one row in and one map-side aggregate, and only the cell table is spread over
neighbours. The particle rows themselves are never multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOX_SIZE, PLANES_PER_SNAPSHOT
from ..functions.geometry import depth_slice, projection_axes, transform_coordinate, wrap

# origin, then neighbour offset -> weight as coefficients of 1, d, d*d. ``cic`` and ``tsc`` put
# pixel k at position k; the centred forms put it at k + 1/2.
RULES: dict[str, tuple[float, dict[int, tuple[float, float, float]]]] = {
    "ngp": (0.0, {0: (1.0, 0.0, 0.0)}),
    "cic": (0.0, {0: (1.0, -1.0, 0.0), 1: (0.0, 1.0, 0.0)}),
    "cic_centred": (-0.5, {0: (1.0, -1.0, 0.0), 1: (0.0, 1.0, 0.0)}),
    "tsc": (0.5, {-1: (0.5, -1.0, 0.5), 0: (0.5, 1.0, -1.0), 1: (0.0, 0.0, 0.5)}),
    "tsc_centred": (0.0, {-1: (0.5, -1.0, 0.5), 0: (0.5, 1.0, -1.0), 1: (0.0, 0.0, 0.5)}),
}


def tsc_weights(x: Column, cell: float) -> tuple[Column, Column, Column]:
    """Weights of the left, home and right cell for a position."""
    t = x / F.lit(cell)
    d = t - F.floor(t) - F.lit(0.5)
    left = F.lit(0.5) * (F.lit(0.5) - d) * (F.lit(0.5) - d)
    right = F.lit(0.5) * (F.lit(0.5) + d) * (F.lit(0.5) + d)
    return left, F.lit(0.75) - d * d, right


def assign(
    points: DataFrame,
    axes: Sequence[str],
    n: int,
    rule: str = "tsc",
    keys: Sequence[str] = (),
    box: float = BOX_SIZE,
    weight: str = "mass",
    names: Sequence[str] = ("i", "j", "k"),
) -> DataFrame:
    """Occupied pixels of the grid: keys, i, j(, k), ``mass``. Works in one to three dimensions."""
    origin, table = RULES[rule]
    degree = 2 if rule.startswith("tsc") else 0 if rule == "ngp" else 1
    dims = len(axes)
    out = points
    for a, nm in zip(axes, names):
        t = wrap(F.col(a), box) / F.lit(box / n) + F.lit(origin)
        out = out.withColumn(f"_t{nm}", t).withColumn(f"_h{nm}", F.floor(F.col(f"_t{nm}")).cast("int"))
        out = out.withColumn(f"_d{nm}", F.col(f"_t{nm}") - F.col(f"_h{nm}"))
    powers = [()]
    for _ in range(dims):
        powers = [p + (q,) for p in powers for q in range(degree + 1)]
    moments = []
    for p in powers:
        term = F.col(weight)
        for nm, q in zip(names, p):
            for _ in range(q):
                term = term * F.col(f"_d{nm}")
        moments.append(F.sum(term).alias("_m" + "".join(map(str, p))))
    homes = [f"_h{nm}" for nm in names[:dims]]
    cells = out.groupBy(*keys, *homes).agg(*moments)

    offsets = [()]
    for _ in range(dims):
        offsets = [o + (s,) for o in offsets for s in table]
    structs = []
    for o in offsets:
        total = None
        for p in powers:
            coef = 1.0
            for s, q in zip(o, p):
                coef *= table[s][q]
            if coef != 0.0:
                part = F.lit(coef) * F.col("_m" + "".join(map(str, p)))
                total = part if total is None else total + part
        fields = [F.pmod(F.col(h) + F.lit(s), F.lit(n)).alias(nm) for h, s, nm in zip(homes, o, names)]
        structs.append(F.struct(*fields, total.alias("w")))
    spread = cells.select(*keys, F.explode(F.array(*structs)).alias("_p"))
    return spread.groupBy(*keys, *[F.col(f"_p.{nm}").alias(nm) for nm in names[:dims]]).agg(F.sum("_p.w").alias("mass"))


def histogram2d(points: DataFrame, axes: Sequence[str], n: int, box: float = BOX_SIZE, keys: Sequence[str] = ()) -> DataFrame:
    """Mass per pixel area; a coordinate equal to the box size falls in the last pixel."""
    out = points
    for a, nm in zip(axes, ("i", "j")):
        out = out.withColumn(nm, F.least(F.floor(F.col(a) / F.lit(box / n)), F.lit(n - 1)).cast("int"))
    area = (box / n) ** 2
    return out.groupBy(*keys, "i", "j").agg((F.sum("mass") / F.lit(area)).alias("sigma"))


def dense(pixels: DataFrame, n: int, keys: Sequence[str], value: str = "mass") -> DataFrame:
    """All n*n pixels of every key, zeros where nothing was deposited."""
    grid = pixels.select(*keys).distinct() if keys else pixels.sparkSession.range(1).drop("id")
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    cols = [*keys, "i", "j"]
    return grid.join(pixels.select(*cols, value), cols, "left").select(*cols, F.coalesce(value, F.lit(0.0)).alias(value))


def overdensity(pixels: DataFrame, n_cells: int, keys: Sequence[str] = (), value: str = "mass") -> DataFrame:
    """mass / mean - 1, the mean taken over all cells, empty ones included."""
    mean = pixels.groupBy(*keys).agg((F.sum(value) / F.lit(float(n_cells))).alias("_mean"))
    joined = pixels.join(mean, list(keys)) if keys else pixels.crossJoin(F.broadcast(mean))
    return joined.withColumn("delta", F.col(value) / F.col("_mean") - F.lit(1.0)).drop("_mean")


def lens_planes(
    points: DataFrame,
    transforms: DataFrame,
    n: int,
    keys: Sequence[str] = ("model",),
    on: Sequence[str] = ("snap",),
    rule: str = "tsc",
    box: float = BOX_SIZE,
    slices: int = PLANES_PER_SNAPSHOT,
    cyclic: bool = False,
) -> DataFrame:
    """Project every snapshot under its transforms into depth slices.

    transforms (a fixed table of realizations x snapshots): lp, snap_index, direction, dx, dy, dz,
    flip and the ``on`` columns. Output: keys, lp, plane, i, j, mass.
    """
    joined = points.join(F.broadcast(transforms), list(on))
    moved = {c: transform_coordinate(F.col(c), F.col(f"d{c}"), F.col("flip"), box) for c in ("x", "y", "z")}
    joined = joined.select(
        *[k for k in keys], "lp", "snap_index", "direction", "mass", *[v.alias(f"_{c}") for c, v in moved.items()]
    )
    u, v, depth = projection_axes(F.col("direction"), F.col("_x"), F.col("_y"), F.col("_z"), cyclic)
    placed = (
        joined.withColumn("_u", u)
        .withColumn("_v", v)
        .withColumn("_s", depth_slice(depth, box, slices))
        .where(F.col("_s").isNotNull())
        .withColumn("plane", (F.col("snap_index") * slices + F.col("_s")).cast("int"))
    )
    return assign(placed, ("_u", "_v"), n, rule, [*keys, "lp", "plane"], box)


def roll(pixels: DataFrame, n: int, di: int, dj: int) -> DataFrame:
    """Cyclic shift of a gridded field."""
    return pixels.withColumn("i", F.pmod(F.col("i") + di, F.lit(n))).withColumn("j", F.pmod(F.col("j") + dj, F.lit(n)))


def rotate(pixels: DataFrame, n: int, degrees: float, keys: Sequence[str] = (), value: str = "v") -> DataFrame:
    """Bilinear rotation about the grid centre, zero where the source lies outside the grid."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    mid = (n - 1) / 2.0
    grid = pixels.select(*keys, "i", "j")
    a, b = F.col("i") - F.lit(mid), F.col("j") - F.lit(mid)
    src = grid.select(
        *keys,
        "i",
        "j",
        (F.lit(c) * a + F.lit(s) * b + F.lit(mid)).alias("_a"),
        (F.lit(c) * b - F.lit(s) * a + F.lit(mid)).alias("_b"),
    )
    inside = (F.col("_a") >= 0) & (F.col("_a") <= n - 1) & (F.col("_b") >= 0) & (F.col("_b") <= n - 1)
    fa, fb = F.col("_a") - F.floor("_a"), F.col("_b") - F.floor("_b")
    taps = F.array(
        *[
            F.struct(
                F.pmod(F.floor("_a").cast("int") + p, F.lit(n)).alias("si"),
                F.pmod(F.floor("_b").cast("int") + q, F.lit(n)).alias("sj"),
                F.when(~inside, F.lit(0.0)).otherwise((fa if p else F.lit(1.0) - fa) * (fb if q else F.lit(1.0) - fb)).alias("w"),
            )
            for p in (0, 1)
            for q in (0, 1)
        ]
    )
    spread = src.select(*keys, "i", "j", F.explode(taps).alias("_t")).select(
        *keys, "i", "j", F.col("_t.si").alias("si"), F.col("_t.sj").alias("sj"), F.col("_t.w").alias("_w")
    )
    source = pixels.select(*keys, F.col("i").alias("si"), F.col("j").alias("sj"), F.col(value).alias("_v"))
    return spread.join(source, [*keys, "si", "sj"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("_w") * F.col("_v")).alias(value))
