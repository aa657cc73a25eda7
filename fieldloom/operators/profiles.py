"""Radial profiles, enclosed masses and the ratios built from them.

Those that take ``pairs`` start from the pair table of ``spatial.ball_join`` with a column ``r`` (distance
in units of R200), ``ptype`` and ``mass``; each is one partial/final aggregate over it. ``ball_profile`` and ``ball_masses`` give the
same sums from points and balls by ``rings.in_rings``, without the pair table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RADIAL_EDGES, STATS_RADII
from ..functions.bins import bin_table, with_bin, with_spine
from ..functions.geometry import shell_volume
from .rings import in_rings

GAS, DM, STARS = 0, 1, 4


def _sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0.0)))


def radial_profile(pairs: DataFrame, edges: Sequence[float] = RADIAL_EDGES, side: str = "hist", keys: Sequence[str] = ("halo_id", "r200")) -> DataFrame:
    """Mass and count per shell, in total and by type; only shells that hold particles."""
    m = F.col("mass")
    binned = with_bin(pairs, "r", edges, side)
    return binned.groupBy(*keys, "bin").agg(
        F.sum(m).alias("mass"),
        F.count(F.lit(1)).alias("n"),
        _sum_if(F.col("ptype") == GAS, m).alias("mass_gas"),
        _sum_if(F.col("ptype") == DM, m).alias("mass_dm"),
        _sum_if(F.col("ptype") == STARS, m).alias("mass_stars"),
    )


def _by_type() -> dict[str, Column]:
    m, only = F.col("mass"), lambda t: F.when(F.col("ptype") == t, F.col("mass")).otherwise(F.lit(0.0))
    return {"mass": m, "mass_gas": only(GAS), "mass_dm": only(DM), "mass_stars": only(STARS)}


def ball_profile(
    points: DataFrame, halos: DataFrame, reach: float, max_radius: float, edges: Sequence[float] = RADIAL_EDGES, side: str = "hist",
    keys: Sequence[str] = ("halo_id", "r200"), by: str | None = None,
) -> DataFrame:
    """``radial_profile`` of the particles within ``reach`` R200 of each halo; ``keys`` are halo columns, ``by`` one of the particles."""
    out = in_rings(points, halos, F.col("r200") * F.lit(reach), "r200", edges, side, by, keys, _by_type(), max_radius)
    return out.select(*keys, *([by] if by else []), "bin", "mass", "n", "mass_gas", "mass_dm", "mass_stars")


def add_density(profile: DataFrame, edges: Sequence[float] = RADIAL_EDGES, physical: bool = True, cols: Sequence[str] = ("mass",)) -> DataFrame:
    """Density columns next to mass columns; ``physical=False`` leaves volumes in R200**3."""
    bins = bin_table(profile.sparkSession, edges)
    vol = shell_volume(F.col("r200") if physical else F.lit(1.0), F.col("lo"), F.col("hi"))
    out = profile.join(F.broadcast(bins), "bin").withColumn("volume", vol)
    for c in cols:
        name = "density" if c == "mass" else c.replace("mass_", "density_")
        out = out.withColumn(name, F.when(F.col("volume") > 0, F.col(c) / F.col("volume")).otherwise(F.lit(0.0)))
    return out


def full_bins(profile: DataFrame, halos: DataFrame, n_bins: int, value_cols: Sequence[str], key: str = "halo_id") -> DataFrame:
    """One row per halo and bin, zeros where a shell is empty."""
    spine = with_spine(halos.select(key), n_bins)
    out = spine.join(profile.select(key, "bin", *value_cols), [key, "bin"], "left")
    return out.select(key, "bin", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in value_cols])


def enclosed_from_shells(profile: DataFrame, value: str = "mass", key: str = "halo_id") -> DataFrame:
    """Running total over the shells of a halo (a halo has a fixed number of shells)."""
    w = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return profile.withColumn("enclosed", F.sum(value).over(w))


def masses_within(pairs: DataFrame, radii: Sequence[float] = STATS_RADII, keys: Sequence[str] = ("halo_id",), strict: bool = False) -> DataFrame:
    """Masses by type within each radius (in R200), and baryon fractions.

    A pair is counted once in the innermost radius that holds it; a running total over the few
    radii then gives the enclosed masses, so pairs are not repeated per radius.
    """
    m = F.col("mass")
    edges = [-1.0, *radii]
    shells = (
        with_bin(pairs, "r", edges, "left" if strict else "right", "ring")
        .groupBy(*keys, "ring")
        .agg(
            F.sum(m).alias("t"),
            _sum_if(F.col("ptype") == GAS, m).alias("g"),
            _sum_if(F.col("ptype") == STARS, m).alias("s"),
            _sum_if(F.col("ptype") == DM, m).alias("d"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return _enclosed(shells, radii, keys)


def ball_masses(
    points: DataFrame, halos: DataFrame, reach: float, max_radius: float, radii: Sequence[float] = STATS_RADII, keys: Sequence[str] = ("halo_id",),
    by: str | None = None, strict: bool = False,
) -> DataFrame:
    """``masses_within`` of the particles within ``reach`` R200 of each halo; ``keys`` are halo columns, ``by`` one of the particles."""
    shells = ball_profile(points, halos, reach, max_radius, [-1.0, *radii], "left" if strict else "right", keys, by)
    names = {"bin": "ring", "mass": "t", "mass_gas": "g", "mass_stars": "s", "mass_dm": "d"}
    return _enclosed(shells.withColumnsRenamed(names), radii, [*keys, *([by] if by else [])])


def _enclosed(shells: DataFrame, radii: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Running totals of the rings' sums over the radii, with fractions."""
    spread = shells.withColumn("k", F.explode(F.sequence(F.col("ring"), F.lit(len(radii) - 1))))
    out = spread.groupBy(*keys, "k").agg(
        F.sum("t").alias("m_total"),
        F.sum("g").alias("m_gas"),
        F.sum("s").alias("m_stellar"),
        F.sum("d").alias("m_dm"),
        F.sum("n").alias("n_part"),
    )
    frac = lambda c: F.when(F.col("m_total") > 0, c / F.col("m_total")).otherwise(F.lit(0.0))
    table = F.array(*[F.lit(float(r)) for r in radii])
    return (
        out.withColumn("radius", F.element_at(table, F.col("k") + 1))
        .withColumn("f_baryon", frac(F.col("m_gas") + F.col("m_stellar")))
        .withColumn("f_gas", frac(F.col("m_gas")))
        .withColumn("f_stellar", frac(F.col("m_stellar")))
        .drop("k")
    )


def mass_conservation(dmo: DataFrame, hydro: DataFrame, keys: Sequence[str] = ("halo_id", "radius")) -> DataFrame:
    """Hydro over DMO mass, in total and for dark matter alone; 0 where DMO holds nothing."""
    d = dmo.select(*keys, F.col("m_total").alias("d_total"), F.col("m_dm").alias("d_dm"))
    h = hydro.select(*keys, F.col("m_total").alias("h_total"), F.col("m_dm").alias("h_dm"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ratio = lambda a, b: F.when(z(b) > 0, z(a) / z(b)).otherwise(F.lit(0.0))
    return d.join(h, list(keys), "full").select(
        *keys, ratio("h_total", "d_total").alias("ratio_total"), ratio("h_dm", "d_dm").alias("ratio_dm")
    )


def enclosed_interpolated(pairs: DataFrame, radii: Sequence[float], keys: Sequence[str] = ("halo_id",)) -> DataFrame:
    """Cumulative mass interpolated linearly between neighbouring particles.

    Only the last particle inside and the first one outside a radius matter, so a mass sum, a
    max and a min per radius replace the sort; all three combine on the map side.
    """
    out_cols: list[Column] = []
    d, m = F.col("r"), F.col("mass")
    for k, r in enumerate(radii):
        out_cols += [
            F.sum(F.when(d <= F.lit(float(r)), m)).alias(f"m{k}"),
            F.max(F.when(d <= F.lit(float(r)), d)).alias(f"a{k}"),
            F.min(F.when(d > F.lit(float(r)), F.struct(d.alias("d"), m.alias("m")))).alias(f"b{k}"),
        ]
    return _between(pairs.groupBy(*keys).agg(*out_cols), radii, keys)


def ball_interpolated(
    points: DataFrame, halos: DataFrame, reach: float, max_radius: float, radii: Sequence[float], keys: Sequence[str] = ("halo_id",), by: str | None = None
) -> DataFrame:
    """``enclosed_interpolated`` of the particles within ``reach`` R200 of each halo, from each ring's sum and ends."""
    edges = [-1.0, *radii, float("inf")]
    rings = in_rings(points, halos, F.col("r200") * F.lit(reach), "r200", edges, "right", by, keys, {"mass": F.col("mass")}, max_radius, ends=True)
    out_cols, within = [], lambda k: F.col("bin") <= k
    for k in range(len(radii)):
        out_cols += [
            F.sum(F.when(within(k), F.col("mass"))).alias(f"m{k}"),
            F.max(F.when(within(k), F.col("r_last"))).alias(f"a{k}"),
            F.min(F.when(~within(k), F.struct(F.col("r_first").alias("d"), F.col("first").alias("m")))).alias(f"b{k}"),
        ]
    keys = [*keys, *([by] if by else [])]
    return _between(rings.groupBy(*keys).agg(*out_cols), radii, keys)


def _between(wide: DataFrame, radii: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Masses interpolated from the mass within each radius, the last distance inside and the first particle outside."""
    rows = F.array(
        *[
            F.struct(
                F.lit(float(r)).alias("radius"),
                F.when(F.col(f"m{k}").isNull(), F.lit(0.0))
                .when(F.col(f"b{k}").isNull(), F.col(f"m{k}"))
                .otherwise(
                    F.col(f"m{k}")
                    + F.col(f"b{k}.m") * (F.lit(float(r)) - F.col(f"a{k}")) / (F.col(f"b{k}.d") - F.col(f"a{k}"))
                )
                .alias("m_enclosed"),
            )
            for k, r in enumerate(radii)
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.radius", "_r.m_enclosed")


def mass_deficit(dmo: DataFrame, hydro: DataFrame, value: str = "m_enclosed", keys: Sequence[str] = ("halo_id", "radius")) -> DataFrame:
    """(hydro - dmo) / dmo; NULL where DMO holds nothing."""
    d = dmo.select(*keys, F.col(value).alias("m_dmo"))
    h = hydro.select(*keys, F.col(value).alias("m_hydro"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return d.join(h, list(keys), "full").select(
        *keys, F.try_divide(z("m_hydro") - z("m_dmo"), z("m_dmo")).alias("deficit")
    )


def deficit_by_run(masses: DataFrame, value: str = "m_enclosed", keys: Sequence[str] = ("halo_id", "radius"), run: str = "sim") -> DataFrame:
    """``mass_deficit`` of the runs 'dmo' and 'hydro' of one table, of which each key has at most one row a run, without working it out for each run.

    As in the join, a key with a NULL has no partner.
    """
    of = lambda name: F.coalesce(F.sum(F.when(F.col(run) == name, F.col(value))), F.lit(0.0))
    alone = F.when(F.greatest(*[F.col(c).isNull() for c in keys], F.lit(False)), F.col(run))
    both = masses.where(F.col(run).isin("dmo", "hydro")).groupBy(*keys, alone.alias("_alone")).agg(of("dmo").alias("m_dmo"), of("hydro").alias("m_hydro"))
    return both.select(*keys, F.try_divide(F.col("m_hydro") - F.col("m_dmo"), F.col("m_dmo")).alias("deficit"))


def stacked_sum(profile: DataFrame, value: str = "density", mass_bin: str = "mass_bin") -> DataFrame:
    """Sum of densities per (mass bin, radial bin), with the number of particles and halos."""
    return profile.groupBy(mass_bin, "bin").agg(
        F.sum(value).alias("stacked"), F.sum("n").alias("n_particles"), F.count_distinct("halo_id").alias("n_halos")
    )


def replace_profile(joined: DataFrame, alpha: float, min_mass: float | None = None, mass_range: tuple[float, float] | None = None) -> DataFrame:
    """Hydro value for shells with r_mid < alpha (and a passing mass centre), else DMO."""
    use = F.col("r_mid") < F.lit(alpha)
    if min_mass is not None:
        use = use & (F.col("mass_mid") >= F.lit(min_mass))
    if mass_range is not None:
        use = use & (F.col("mass_mid") >= F.lit(mass_range[0])) & (F.col("mass_mid") < F.lit(mass_range[1]))
    return joined.withColumn("replaced", F.when(use, F.col("hydro")).otherwise(F.col("dmo")))
