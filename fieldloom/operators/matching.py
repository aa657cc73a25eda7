"""One-to-one catalogue matching through shared particle ids.

Pairs of halos are dealt out before they are counted: few of them repeat within a task, and counting there first fills its memory for
nothing. Each choice is a max over a struct, so a halo with very many partners is still reduced on the map side, and the sizes of halos
are joined to the pairs that are chosen.

``keys`` names what ids are unique within, such as the run and the snapshot: everything is matched inside each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below these a halo takes no part in the canonical matching.
MIN_MASS, MIN_PARTICLES = 1e12, 100


def lookup(queries: DataFrame, members: DataFrame, key: str = "pid", value: str = "halo", missing: int = -1, keys: Sequence[str] = ()) -> DataFrame:
    """Halo of each queried id; the lowest halo where an id is listed twice, -1 where absent."""
    table = members.groupBy(*keys, key).agg(F.min(value).alias("_v"))
    return queries.join(table, [*keys, key], "left").withColumn(value, F.coalesce("_v", F.lit(missing))).drop("_v")


def shared_ids(dmo: DataFrame, hydro: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dmo, hydro, shared) for every pair of halos that shares an id."""
    pair = [*keys, "dmo", "hydro"]
    side = lambda members, name: members.where(F.col("halo").isNotNull()).select(*keys, "pid", F.col("halo").alias(name))
    met = side(dmo, "dmo").join(side(hydro, "hydro"), [*keys, "pid"]).select(*pair)
    return met.repartition(*pair).groupBy(*pair).agg(F.count(F.lit(1)).alias("shared"))


def _sizes(members: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    return members.groupBy(*keys, F.col("halo").alias(side)).agg(F.count(F.lit(1)).alias(f"n_{side}"))


def _with_sizes(pairs: DataFrame, dmo: DataFrame, hydro: DataFrame, keys: Sequence[str]) -> DataFrame:
    sized = pairs.join(_sizes(dmo, "dmo", keys), [*keys, "dmo"]).join(_sizes(hydro, "hydro", keys), [*keys, "hydro"])
    return sized.select(*keys, "dmo", "hydro", "shared", "n_dmo", "n_hydro")


def overlaps(dmo: DataFrame, hydro: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dmo, hydro, shared, n_dmo, n_hydro) for every pair that shares an id."""
    return _with_sizes(shared_ids(dmo, hydro, keys), dmo, hydro, keys)


def shared_fractions(dmo: DataFrame, hydro: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dmo, hydro, shared, n_dmo, f) for every pair that shares an id, f = shared / n_dmo."""
    pairs = shared_ids(dmo, hydro, keys).join(_sizes(dmo, "dmo", keys), [*keys, "dmo"])
    return pairs.withColumn("f", F.col("shared") / F.col("n_dmo"))


def members_of(members: DataFrame, halos: DataFrame, keys: Sequence[str] = (), min_mass: float = MIN_MASS, mass: str = "mass") -> DataFrame:
    """Member rows of the halos of at least ``min_mass``; ``halos`` has halo and its mass."""
    heavy = halos.where(F.col(mass) >= min_mass).select(*keys, "halo")
    return members.join(heavy, [*keys, "halo"], "left_semi")


def _best(df: DataFrame, side: str, other: str, score: str, keep: list[str], keys: Sequence[str] = ()) -> DataFrame:
    """Row with the highest score per ``side``; ties to the lowest ``other``."""
    top = df.groupBy(*keys, side).agg(
        F.max(F.struct(F.col(score).alias("s"), (-F.col(other)).alias("o"), *[F.col(c) for c in keep])).alias("b")
    )
    return top.select(*keys, side, (-F.col("b.o")).alias(other), *[F.col(f"b.{c}").alias(c) for c in keep])


def best_overlap(dmo: DataFrame, hydro: DataFrame, min_fraction: float = 0.5, min_particles: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Most shared ids per DMO halo, both fractions at least ``min_fraction``, score = sqrt(f*r)."""
    top = _with_sizes(_best(shared_ids(dmo, hydro, keys), "dmo", "hydro", "shared", ["shared"], keys), dmo, hydro, keys)
    return (
        top.where(F.col("n_dmo") >= min_particles)
        .withColumn("forward", F.col("shared") / F.col("n_dmo"))
        .withColumn("reverse", F.col("shared") / F.col("n_hydro"))
        .where((F.col("forward") >= min_fraction) & (F.col("reverse") >= min_fraction))
        .withColumn("score", F.sqrt(F.col("forward") * F.col("reverse")))
    )


def one_to_one(matches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keep the best score per hydro halo, then per DMO halo; first in DMO order on ties."""
    keep = [c for c in matches.columns if c not in ("dmo", "hydro", *keys)]
    per_hydro = _best(matches, "hydro", "dmo", "score", keep, keys)
    return _best(per_hydro, "dmo", "hydro", "score", keep, keys)


def _of_size(members: DataFrame, min_particles: int, keys: Sequence[str]) -> DataFrame:
    """Member rows of the halos with at least ``min_particles`` of them."""
    if min_particles <= 1:
        return members
    large = _sizes(members, "halo", keys).where(F.col("n_halo") >= min_particles)
    return members.join(large, [*keys, "halo"], "left_semi")


def mutual_best(dmo: DataFrame, hydro: DataFrame, min_fraction: float = 0.5, min_particles: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs that choose each other; score = min of both fractions."""
    pairs = shared_ids(_of_size(dmo, min_particles, keys), _of_size(hydro, min_particles, keys), keys)
    forward = _best(pairs, "dmo", "hydro", "shared", ["shared"], keys)
    back = _best(pairs, "hydro", "dmo", "shared", [], keys)
    return (
        _with_sizes(forward.join(back, [*keys, "dmo", "hydro"]), dmo, hydro, keys)
        .withColumn("score", F.least(F.col("shared") / F.col("n_dmo"), F.col("shared") / F.col("n_hydro")))
        .where(F.col("score") >= min_fraction)
    )


def match_catalogues(dmo: DataFrame, hydro: DataFrame, min_fraction: float = 0.5, min_particles: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Full matching: overlaps, best partner, one-to-one."""
    return one_to_one(best_overlap(dmo, hydro, min_fraction, min_particles, keys), keys)
