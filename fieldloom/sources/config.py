"""Small configuration tables built on the driver."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..constants import BOX_SIZE, N_REALIZATIONS, SNAPSHOT_ORDER, TRANSFORM_SEED


def expand(config: Any, variables: Mapping[str, str] | None = None) -> Any:
    """Replace ``${name}`` in every string of a nested configuration; top-level strings define names."""
    if variables is None:
        variables = {k: v for k, v in config.items() if isinstance(v, str)}
    if isinstance(config, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: variables.get(m.group(1), m.group(0)), config)
    if isinstance(config, Mapping):
        return {k: expand(v, variables) for k, v in config.items()}
    if isinstance(config, list):
        return [expand(v, variables) for v in config]
    return config


def transform_rows(n_lp: int = N_REALIZATIONS, n_snap: int = len(SNAPSHOT_ORDER), seed: int = TRANSFORM_SEED, box: float = BOX_SIZE) -> list[tuple]:
    """(lp, snap_index, direction, dx, dy, dz, flip) from one seeded generator.

    The draws are made array by array in this order, which fixes the values for a seed.
    """
    rng = np.random.RandomState(seed)
    direction = rng.randint(0, 3, (n_lp, n_snap))
    shift = rng.uniform(0, box, (n_lp, n_snap, 3))
    flip = rng.choice([True, False], (n_lp, n_snap))
    return [
        (lp, s, int(direction[lp, s]), *[float(v) for v in shift[lp, s]], bool(flip[lp, s]))
        for lp in range(n_lp)
        for s in range(n_snap)
    ]


def transform_table(spark: SparkSession, **options) -> DataFrame:
    """Fixed size (realizations x snapshots), so it is safe to broadcast."""
    schema = "lp int, snap_index int, direction int, dx double, dy double, dz double, flip boolean"
    return spark.createDataFrame(transform_rows(**options), schema)


def plane_table(spark: SparkSession) -> DataFrame:
    """Light-cone geometry, one row per lens plane."""
    from ..constants import PLANES_PER_SNAPSHOT, lens_planes

    rows = [(p, cl, zl, cs, zs, SNAPSHOT_ORDER[(p - 1) // PLANES_PER_SNAPSHOT]) for p, cl, zl, cs, zs in lens_planes()]
    return spark.createDataFrame(rows, "plane int, chi_lens double, z_lens double, chi_source double, z_source double, snap int")
