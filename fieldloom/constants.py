"""Units, bin edges, cosmology and light-cone geometry."""

from __future__ import annotations

import math

# --- fixed values: units and box -------------------------------------------------
BOX_SIZE = 205.0
LENGTH_UNIT = 1e-3
MASS_UNIT = 1e10
PARTICLE_TYPES = {"gas": 0, "dm": 1, "tracers": 3, "stars": 4, "bh": 5}

# dark-matter particle mass by particles per side, in units of MASS_UNIT
DM_PARTICLE_MASS = {
    2500: {"dmo": 0.0047271638660809, "hydro": 0.00398342749867548},
    1250: {"dmo": 0.0378173109, "hydro": 0.0318674199},
    625: {"dmo": 0.3025384873, "hydro": 0.2549393594},
}

# --- fixed values: bins ----------------------------------------------------------
MASS_BIN_EDGES = [12.0, 12.5, 13.0, 13.5, 14.0, 14.5, 16.0]
STATS_RADII = [0.5, 1.0, 2.0, 3.0, 4.0, 5.0]
REPLACE_MASS_BINS = [
    (12.0, 12.5, "M12.0-12.5"),
    (12.5, 13.0, "M12.5-13.0"),
    (13.0, 13.5, "M13.0-13.5"),
    (13.5, 15.0, "M13.5-15.0"),
    (12.0, math.inf, "M12.0+"),
    (12.5, math.inf, "M12.5+"),
    (13.0, math.inf, "M13.0+"),
    (13.5, math.inf, "M13.5+"),
]
RADIUS_FACTORS = [0.5, 1.0, 3.0, 5.0]

# --- fixed values: light cone ----------------------------------------------------
SNAPSHOT_ORDER = [96, 90, 85, 80, 76, 71, 67, 63, 59, 56, 52, 49, 46, 43, 41, 38, 35, 33, 31, 29]
PLANES_PER_SNAPSHOT = 2
N_REALIZATIONS = 10
TRANSFORM_SEED = 2020
LENS_PLANE_REDSHIFTS = [
    0.017, 0.052, 0.087, 0.123, 0.160, 0.197, 0.236, 0.275, 0.314, 0.355,
    0.397, 0.440, 0.484, 0.529, 0.576, 0.623, 0.673, 0.723, 0.776, 0.830,
    0.886, 0.944, 1.003, 1.065, 1.130, 1.197, 1.266, 1.338, 1.413, 1.492,
    1.573, 1.659, 1.748, 1.841, 1.938, 2.041, 2.148, 2.260, 2.379, 2.503,
]
SOURCE_PLANE_REDSHIFTS = [
    0.034, 0.070, 0.105, 0.142, 0.179, 0.216, 0.255, 0.294, 0.335, 0.376,
    0.418, 0.462, 0.506, 0.552, 0.599, 0.648, 0.698, 0.749, 0.803, 0.858,
    0.914, 0.973, 1.034, 1.097, 1.163, 1.231, 1.302, 1.375, 1.452, 1.532,
    1.615, 1.703, 1.794, 1.889, 1.989, 2.094, 2.203, 2.319, 2.440, 2.568,
]

# --- fixed values: cosmology -----------------------------------------------------
OMEGA_M = 0.3089
HUBBLE_H = 0.6774
SPEED_OF_LIGHT = 299792.458
RHO_CRIT_0 = 27.7536627

# --- fixed values: map statistics ------------------------------------------------
KAPPA_RMS = 0.0107
FIELD_SIZE_DEG = 5.0


def logspace(lo: float, hi: float, n: int) -> list[float]:
    """n points, evenly spaced in log10, from 10**lo to 10**hi."""
    import numpy as np

    return [float(v) for v in np.logspace(lo, hi, n)]


def linspace(lo: float, hi: float, n: int) -> list[float]:
    import numpy as np

    return [float(v) for v in np.linspace(lo, hi, n)]


RADIAL_EDGES = logspace(-2, math.log10(5), 31)


def lens_planes() -> list[tuple[int, float, float, float, float]]:
    """(plane, chi_lens, z_lens, chi_source, z_source), planes numbered from 1."""
    step = BOX_SIZE / PLANES_PER_SNAPSHOT
    return [
        (p + 1, step * (p + 0.5), LENS_PLANE_REDSHIFTS[p], step * (p + 1), SOURCE_PLANE_REDSHIFTS[p])
        for p in range(len(LENS_PLANE_REDSHIFTS))
    ]


# --- fixed values: edges of the response tiles, in mass and in multiples of R200 ---
MASS_EDGES = [1.00e12, 3.16e12, 1.00e13, 3.16e13, 1.00e15]
ALPHA_EDGES = [0.0, 0.5, 1.0, 3.0, 5.0]


# --- fixed values: baryonification parameter sets --------------------------------
BCM_PARAMETERS = {
    "schneider19": {
        "theta_ej": 4.0, "theta_co": 0.1, "M_c": 1.1e13 / HUBBLE_H, "mu_beta": 0.55, "gamma": 2.0, "delta": 7.0,
        "eta": 0.3, "eta_delta": 0.3, "tau": -1.5, "tau_delta": 0.0, "A": 0.045, "M1": 2.5e11 / HUBBLE_H,
        "epsilon_h": 0.015, "a": 0.3, "n": 2.0, "epsilon": 4.0, "p": 0.3, "q": 0.707,
    },
    "schneider25": {
        "epsilon0": 4.0, "epsilon1": 0.5, "alpha_excl": 0.4, "p": 0.3, "q": 0.707, "M_c": 1e15, "mu": 0.8,
        "theta_c": 0.3, "nu_theta_c": 0.5, "alpha": 1.0, "gamma": 1.5, "delta": 7.0, "c_iga": 0.1, "nu_c_iga": 1.5,
        "r_min_iga": 1e-3, "q0": 0.075, "q1": 0.25, "q2": 0.7, "nu_q0": 0.0, "nu_q1": 1.0, "nu_q2": 0.0,
        "nstep": 1.5, "tau": -1.376, "tau_delta": 0.0, "Mstar": 3e11, "Nstar": 0.03, "eta": 0.1, "eta_delta": 0.22,
        "epsilon_cga": 0.03, "M1_0": 1e11 / HUBBLE_H, "epsilon_h": 0.015, "alpha_nt": 0.1, "nu_nt": 0.5,
        "gamma_nt": 0.8, "mean_molecular_weight": 0.6125,
    },
    "arico20": {
        "M_c": 1.2e14 / HUBBLE_H, "mu": 0.31, "beta": 0.6, "M_inn": 3.3e13 / HUBBLE_H, "theta_inn": 0.1,
        "theta_out": 3.0, "epsilon_hydro": 5.0**0.5, "theta_rg": 0.3, "sigma_rg": 0.1, "M_r": 1e16, "beta_r": 2.0,
        "eta": 0.6, "M1_0": 2.2e11 / HUBBLE_H, "alpha_g": 2.0, "epsilon_h": 0.015, "alpha_fsat": 1.0,
        "M1_fsat": 1.0, "delta_fsat": 1.0, "gamma_fsat": 1.0, "eps_fsat": 1.0, "a": 0.3, "n": 2.0, "p": 0.3,
        "q": 0.707, "A_nt": 0.495, "alpha_nt": 0.1, "mean_molecular_weight": 0.59,
    },
}


def bcm_parameter_rows() -> list[tuple[str, str, float]]:
    """(model, name, value) for every parameter set."""
    return [(m, n, float(v)) for m, params in BCM_PARAMETERS.items() for n, v in params.items()]
