"""Fourier-space lensing operators and line-of-sight sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BOX_SIZE, OMEGA_M, SPEED_OF_LIGHT
from ..functions.geometry import density_contrast
from . import blocks

DERIVATIVES = ["psi_x", "psi_y", "psi_xx", "psi_xy", "psi_yy"]


def potential_derivatives(pixels: DataFrame, keys: Sequence[str], n: int, side: float = BOX_SIZE, omega_m: float = OMEGA_M, value: str = "v") -> DataFrame:
    """First and second derivatives of the lensing potential of a contrast-times-thickness field.

    The potential is 3 Om (100/c)^2 delta / k^2; first derivatives carry i*k, second ones +k*k,
    and the k=0 mode is dropped. i is the x axis.
    """
    ku, scale = 2 * math.pi / side, 3 * omega_m * (100.0 / SPEED_OF_LIGHT) ** 2

    def factors(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        kx, ky = blocks.signed(i, n)[:, None] * ku, blocks.signed(j, n)[None, :] * ku
        k2 = kx * kx + ky * ky
        pre = np.divide(scale, k2, out=np.zeros_like(k2), where=k2 > 0)
        return [1j * kx * pre, 1j * ky * pre, kx * kx * pre, kx * ky * pre, ky * ky * pre]

    return blocks.filtered(pixels, keys, n, [value], DERIVATIVES, factors)


def convert_planes(masses: DataFrame, keys: Sequence[str], n: int, thickness: float, side: float = BOX_SIZE) -> DataFrame:
    """Mass planes to potential planes."""
    delta = masses.withColumn("v", density_contrast(F.col("mass"), n, side, thickness))
    return potential_derivatives(delta, keys, n, side)


def _shear_factors(i: np.ndarray, j: np.ndarray, n: int) -> list[np.ndarray]:
    """j is the first (x) frequency, i the second, as in image order."""
    lx, ly = blocks.signed(j, n)[None, :], blocks.signed(i, n)[:, None]
    l2 = lx * lx + ly * ly
    part = lambda x: np.divide(x, l2, out=np.zeros_like(l2), where=l2 > 0)
    return [part(lx * lx - ly * ly), part(2 * lx * ly)]


def shear_from_convergence(pixels: DataFrame, keys: Sequence[str], n: int, value: str = "v") -> DataFrame:
    return blocks.filtered(pixels, keys, n, [value], ["gamma1", "gamma2"], lambda i, j: _shear_factors(i, j, n))


def convergence_from_shear(shear: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return blocks.filtered(shear, keys, n, ["gamma1", "gamma2"], ["kappa"], lambda i, j: _shear_factors(i, j, n))


def aperture_kernel(theta_pix: float) -> list[tuple[int, int, float]]:
    """(di, dj, weight) of the compensated filter; zero outside the aperture."""
    r = int(math.ceil(theta_pix))
    out = []
    for di in range(-r, r + 1):
        for dj in range(-r, r + 1):
            u = math.sqrt(di * di + dj * dj) / theta_pix
            if u < 1:
                out.append((di, dj, 9 / math.pi * (1 - u * u) * (1 / 3 - u * u) / theta_pix**2))
    return out


def aperture_mass(pixels: DataFrame, keys: Sequence[str], n: int, theta: float, pixel: float, value: str = "v") -> DataFrame:
    """Periodic convolution with the aperture filter, as a product of spectra: its cost does not depend on the aperture, which has to be
    smaller than half a map."""
    taps = aperture_kernel(theta / pixel)
    return blocks.filtered(pixels, keys, n, [value], ["m_ap"], blocks.kernel_factors(taps, n))


def born_convergence(planes: DataFrame, weights: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """Weighted sum over planes; ``weights`` (plane, weight) has one row per lens plane."""
    return (
        planes.join(weights, "plane")
        .groupBy(*keys, "i", "j")
        .agg(F.sum(F.col("weight") * F.col(value)).alias("kappa"))
    )
