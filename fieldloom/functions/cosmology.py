"""Background cosmology as Column expressions (flat, cosmological constant)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import OMEGA_M, SPEED_OF_LIGHT


def efunc(z: Column, omega_m: float = OMEGA_M) -> Column:
    u = F.lit(1.0) + z
    return F.sqrt(F.lit(omega_m) * u * u * u + F.lit(1.0 - omega_m))


def scale_factor(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + z)


def comoving_distance(z: Column, omega_m: float = OMEGA_M, points: int = 1000) -> Column:
    """Trapezoid over ``points`` equally spaced redshifts, in Mpc/h."""
    steps = points - 1
    h = z / F.lit(float(steps))
    inner = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps - 1)),
        F.lit(0.0),
        lambda acc, k: acc + F.lit(1.0) / efunc(h * k, omega_m),
    )
    ends = (F.lit(1.0) / efunc(z * 0.0, omega_m) + F.lit(1.0) / efunc(z, omega_m)) / F.lit(2.0)
    return F.when(z <= 0, F.lit(0.0)).otherwise(F.lit(SPEED_OF_LIGHT / 100.0) * h * (inner + ends))


def scale_factor_at(chi: Column, omega_m: float = OMEGA_M, points: int = 1000, rounds: int = 12) -> Column:
    """Invert the distance relation by Newton steps, a fixed number of rounds.

    The integrand in a is 1/sqrt(Om*a + Ol*a^4); the step count is far beyond
    what the quadratic convergence needs, so no per-row stop test is made.
    """
    scale = SPEED_OF_LIGHT / 100.0

    def inv(a: Column) -> Column:
        return F.lit(1.0) / F.sqrt(F.lit(omega_m) * a + F.lit(1.0 - omega_m) * a * a * a * a)

    def step(a: Column, _k: Column) -> Column:
        h = (F.lit(1.0) - a) / F.lit(float(points - 1))
        inner = F.aggregate(
            F.sequence(F.lit(1), F.lit(points - 2)), F.lit(0.0), lambda acc, k: acc + inv(a + h * k)
        )
        dist = F.lit(scale) * h * (inner + (inv(a) + inv(F.lit(1.0))) / F.lit(2.0))
        moved = a + (dist - chi) / (F.lit(scale) * inv(a))
        return F.greatest(F.lit(0.01), F.least(F.lit(0.9999), moved))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.5), step)
    return F.when(chi <= 0, F.lit(1.0)).otherwise(solved)


def critical_surface_density(z_lens: Column, z_source: Column, omega_m: float = OMEGA_M) -> Column:
    """c^2 / (4 pi G) * D_s / (D_l D_ls), angular-diameter distances, Msun h / Mpc^2."""
    chi_l = comoving_distance(z_lens, omega_m)
    chi_s = comoving_distance(z_source, omega_m)
    g = 4.30091727e-9  # Mpc (km/s)^2 / Msun
    prefactor = SPEED_OF_LIGHT**2 / (4.0 * math.pi * g)
    value = F.lit(prefactor) * chi_s / (chi_l * (chi_s - chi_l) / (F.lit(1.0) + z_lens))
    return F.when((z_source > z_lens) & (z_lens > 0), value)


def lensing_weight(z: Column, z_source: Column, thickness: float, omega_m: float = OMEGA_M) -> Column:
    """3/2 Om (100/c)^2 * chi (chi_s - chi)/chi_s / a * thickness; NULL beyond the source."""
    chi = comoving_distance(z, omega_m)
    chi_s = comoving_distance(z_source, omega_m)
    pref = 1.5 * omega_m * (100.0 / SPEED_OF_LIGHT) ** 2 * thickness
    eff = F.when(chi < chi_s, chi * (chi_s - chi) / chi_s).otherwise(F.lit(0.0))
    return F.when(z < z_source, F.lit(pref) * eff * (F.lit(1.0) + z))
