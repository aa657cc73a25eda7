"""Periodic geometry, transforms and unit scaling as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import OMEGA_M, RHO_CRIT_0


def wrap(x: Column, box: float) -> Column:
    """Periodic position in [0, box)."""
    return F.pmod(x, F.lit(box))


def min_image(d: Column, box: float) -> Column:
    """Nearest-image displacement; halves round to even."""
    return d - F.lit(box) * F.rint(d / F.lit(box))


def min_image_branch(d: Column, box: float) -> Column:
    """Nearest image by comparison, for |d| < 1.5 box."""
    half = F.lit(box / 2)
    return F.when(d > half, d - box).when(d < -half, d + box).otherwise(d)


def norm3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def periodic_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], box: float) -> Column:
    return norm3(*[min_image(p - q, box) for p, q in zip(a, b)])


def recentre(x: Column, centre: Column, box: float) -> Column:
    """Coordinate in a frame where ``centre`` sits at box/2."""
    return min_image(x - centre, box) + F.lit(box / 2)


def unwrap_about(x: Column, centre: Column, box: float) -> Column:
    """The image of ``x`` closest to ``centre`` (may lie outside the box)."""
    return centre + min_image(x - centre, box)


def replicate(df: DataFrame, box: float, n: int = 1, cols: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(2n+1)**3 periodic images of every row, with the shifts kept as sx, sy, sz."""
    steps = F.array(*[F.lit(s) for s in range(-n, n + 1)])
    out = df
    for c, s in zip(cols, ("sx", "sy", "sz")):
        out = out.withColumn(s, F.explode(steps)).withColumn(c, F.col(c) + F.col(s) * F.lit(box))
    return out


def transform_coordinate(x: Column, shift: Column, flip: Column, box: float) -> Column:
    """Displace, mirror when ``flip``, wrap."""
    moved = x + shift
    return wrap(F.when(flip, F.lit(box) - moved).otherwise(moved), box)


def transform_coordinate_per_axis(x: Column, shift: Column, flip: Column, box: float) -> Column:
    """Variant with one flag per axis, negating before the displacement is wrapped."""
    moved = x + shift
    return wrap(F.when(flip, -moved).otherwise(moved), box)


def projection_axes(direction: Column, x: Column, y: Column, z: Column, cyclic: bool = False) -> tuple[Column, Column, Column]:
    """(first, second, depth): in-plane axes ascending, or cyclic as (z, x) for y."""
    first_y, second_y = (z, x) if cyclic else (x, z)
    first = F.when(direction == 0, y).when(direction == 1, first_y).otherwise(x)
    second = F.when(direction == 0, z).when(direction == 1, second_y).otherwise(y)
    depth = F.when(direction == 0, x).when(direction == 1, y).otherwise(z)
    return first, second, depth


def depth_slice(depth: Column, box: float, slices: int) -> Column:
    """0-based slice along the line of sight; NULL outside [0, box)."""
    k = F.floor(depth / F.lit(box / slices))
    return F.when((k >= 0) & (k < slices), k)


def shell_volume(r200: Column, lo: Column, hi: Column) -> Column:
    return F.lit(4.0 / 3.0 * math.pi) * r200 * r200 * r200 * (hi * hi * hi - lo * lo * lo)


def mass_to_density(mass: Column, volume: Column) -> Column:
    return F.when(volume > 0, mass / volume).otherwise(F.lit(0.0))


def density_contrast(mass: Column, n: int, side: float, thickness: float, omega_m: float = OMEGA_M) -> Column:
    """Pixel mass (Msun/h) to overdensity times slice thickness."""
    mean = RHO_CRIT_0 * omega_m * side * side * thickness / (n * n)
    return (mass / F.lit(1e10) / F.lit(mean) - F.lit(1.0)) * F.lit(thickness)


# substrings that name a unit family, in the order in which they are tried
UNIT_FAMILIES = [("length", ("coordinate", "pos")), ("mass", ("mass",)), ("velocity", ("vel",)), ("length", ("radius", "r_"))]


def convert_units(value: Column, field: Column, h: float, a: float, to_physical: bool = True) -> Column:
    """Code units to physical units, chosen by the field name (first family that fits)."""
    length = a / h / 1e3 if to_physical else 1e-3
    mass = 1e10 / h if to_physical else 1e10
    factor = {"length": length, "mass": mass, "velocity": 1.0}
    name = F.lower(field)
    chosen = None
    for family, parts in UNIT_FAMILIES:
        hit = name.contains(parts[0])
        for part in parts[1:]:
            hit = hit | name.contains(part)
        scaled = value * F.lit(factor[family])
        chosen = F.when(hit, scaled) if chosen is None else chosen.when(hit, scaled)
    return chosen.otherwise(value)
