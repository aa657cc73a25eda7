"""Scans of particle, halo, match and product tables, with units applied once at the source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DM_PARTICLE_MASS, LENGTH_UNIT, MASS_UNIT


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scale_particles(raw: DataFrame, resolution: int, sim: Column, length: float = LENGTH_UNIT, mass: float = MASS_UNIT) -> DataFrame:
    """kpc/h and 1e10 Msun/h to Mpc/h and Msun/h; dark matter without a mass gets its constant."""
    table = DM_PARTICLE_MASS[resolution]
    constant = F.when(sim == "dmo", F.lit(table["dmo"])).otherwise(F.lit(table["hydro"]))
    m = F.coalesce(F.col("mass"), F.when(F.col("ptype") == 1, constant))
    out = raw
    for c in ("x", "y", "z"):
        out = out.withColumn(c, F.col(c) * F.lit(length))
    return out.withColumn("mass", m * F.lit(mass))


def scan_types(particles: DataFrame, sim: str, ptypes: Sequence[int]) -> DataFrame:
    """One run and some particle types; with a table partitioned by both, only those files are read."""
    return particles.where((F.col("sim") == sim) & F.col("ptype").isin(*ptypes))


def flag_members(particles: DataFrame, ids: DataFrame, exclude: bool = True) -> DataFrame:
    """``keep`` is false for listed ids (exclude) or true only for them."""
    marked = particles.join(ids.select("pid").distinct().withColumn("_hit", F.lit(True)), "pid", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return marked.withColumn("keep", ~hit if exclude else hit).drop("_hit")


def with_fallback(df: DataFrame, column: str, fallback: str) -> DataFrame:
    """A column that older products lack, filled from another one."""
    if column in df.columns:
        return df.withColumn(column, F.coalesce(F.col(column), F.col(fallback)))
    return df.withColumn(column, F.col(fallback))


def offsets(lengths: DataFrame, order: str, length: str) -> DataFrame:
    """First and past-the-end row of each group when groups are stored one after another.

    Running totals are taken inside slices of the order and shifted by the totals of the slices
    before, so the sum does not pass through one task.
    """
    from ..operators.ordering import before_slices, sliced
    from pyspark.sql import Window

    s = sliced(lengths, [], F.col(order))
    shift = before_slices(s.groupBy("_hi", "_lo").agg(F.sum(length).alias("_t")), [], "_t")
    inside = Window.partitionBy("_hi", "_lo").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = s.withColumn("_run", F.sum(length).over(inside)).join(shift, ["_hi", "_lo"])
    return out.withColumn("stop", F.col("_off") + F.col("_run")).withColumn("start", F.col("stop") - F.col(length)).drop("_hi", "_lo", "_run", "_off", "_total")


def attributes(df: DataFrame, json_column: str, schema: str) -> DataFrame:
    """Attribute values that start with a brace are JSON objects, others are plain text."""
    text = F.col(json_column)
    return df.withColumn("parsed", F.when(text.startswith("{"), F.from_json(text, schema)))


def snapshots(particles: DataFrame, column: str = "snap") -> DataFrame:
    """Snapshots present; on a partitioned table this reads folder names, not rows."""
    return particles.select(column).distinct()
