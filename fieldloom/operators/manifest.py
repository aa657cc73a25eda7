"""Completeness of artifact sets: expected against existing, reports and task lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PLANES_PER_SNAPSHOT, SNAPSHOT_ORDER


def expected_set(models: DataFrame, n_lp: int, n_planes: int) -> DataFrame:
    """models x realizations x planes."""
    return models.withColumn("lp", F.explode(F.sequence(F.lit(0), F.lit(n_lp - 1)))).withColumn(
        "plane", F.explode(F.sequence(F.lit(0), F.lit(n_planes - 1)))
    )


def missing(expected: DataFrame, existing: DataFrame, keys: Sequence[str] = ("model", "lp", "plane")) -> DataFrame:
    return expected.join(existing, list(keys), "left_anti")


def plane_to_snapshot(plane: Column) -> Column:
    """Snapshot number of a 0-based plane."""
    table = F.array(*[F.lit(s) for s in SNAPSHOT_ORDER])
    return F.element_at(table, F.floor(plane / PLANES_PER_SNAPSHOT).cast("int") + 1)


def recovery_tasks(missing_planes: DataFrame) -> DataFrame:
    """Per snapshot and model the sorted distinct realizations, and the count of planes.

    Realizations are made distinct before they are gathered, so a list is as long as the number
    of realizations.
    """
    m = missing_planes.withColumn("snap", plane_to_snapshot(F.col("plane")))
    per = m.groupBy("snap", "model", "lp").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("snap", "model").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("lp")), lambda v: v.cast("string"))).alias("realizations"),
        F.sum("n").alias("n_missing"),
    )


def report_json(tasks: DataFrame) -> DataFrame:
    """One JSON object per snapshot: model -> realizations."""
    pair = F.struct(F.col("model").cast("string").alias("k"), F.split("realizations", ",").alias("v"))
    return tasks.groupBy("snap").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair)))).alias("report"))


def completeness(expected: DataFrame, existing: DataFrame, keys: Sequence[str], group: Sequence[str], goal: int | None = None) -> DataFrame:
    """Expected and found counts with OK or n/m, and whether a goal is reached.

    Sets made by explode are far larger than the planner's estimate of them, so the joins are told to sort rather than broadcast.
    """
    e = expected.groupBy(*group).agg(F.count(F.lit(1)).alias("n_expected"))
    have = existing.join(expected.select(*keys).hint("merge"), list(keys), "left_semi").select(*keys).distinct()
    f = have.groupBy(*group).agg(F.count(F.lit(1)).alias("n_found"))
    out = e.join(f.hint("merge"), list(group), "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    status = F.when(F.col("n_found") == F.col("n_expected"), F.lit("OK")).otherwise(
        F.concat_ws("/", F.col("n_found").cast("string"), F.col("n_expected").cast("string"))
    )
    out = out.withColumn("status", status)
    return out if goal is None else out.withColumn("goal_met", F.col("n_found") >= goal)


def complete_runs(files: DataFrame, keys: Sequence[str], run: str, required: int) -> DataFrame:
    """Runs whose number of distinct files reaches ``required``, counted per key."""
    per = files.groupBy(*keys, run).agg(F.count_distinct("file").alias("n"))
    return per.groupBy(*keys).agg(F.count_if(F.col("n") >= required).alias("n_complete"), F.count(F.lit(1)).alias("n_runs"))


def block_of(position: Column, total: Column, workers: int) -> Column:
    """Worker of an item when items go out in contiguous blocks, the first total % workers one longer."""
    base = F.floor(total / workers)
    extra = total % workers
    long_part = extra * (base + 1)
    return F.when(position < long_part, F.floor(F.try_divide(position, base + 1))).otherwise(
        extra + F.floor(F.try_divide(position - long_part, F.greatest(base, F.lit(1))))
    ).cast("long")


def index_ranges(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Sorted distinct integers as "0-4,6,8-12".

    A break starts wherever the integer before is absent, so starts and ends are found by two
    anti joins on the integer; only the ranges are gathered per key. The joins sort, as the integers may come from an explode,
    which the planner takes for small enough to broadcast.
    """
    ids = df.select(*keys, index).distinct()
    prev = ids.select(*keys, (F.col(index) + 1).alias(index))
    nxt = ids.select(*keys, (F.col(index) - 1).alias(index))
    w = Window.partitionBy(*keys).orderBy(index)
    starts = ids.join(prev.hint("merge"), [*keys, index], "left_anti").withColumn("_k", F.row_number().over(w)).withColumnRenamed(index, "_lo")
    ends = ids.join(nxt.hint("merge"), [*keys, index], "left_anti").withColumn("_k", F.row_number().over(w)).withColumnRenamed(index, "_hi")
    one = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo").cast("string")).otherwise(
        F.concat_ws("-", F.col("_lo").cast("string"), F.col("_hi").cast("string"))
    )
    pieces = starts.join(ends.hint("merge"), [*keys, "_k"]).select(*keys, F.struct(F.col("_lo").alias("lo"), one.alias("s")).alias("_p"))
    return pieces.groupBy(*keys).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["s"])).alias("ranges")
    )


def pending(configs: DataFrame, manifest: DataFrame, keys: Sequence[str], required: int) -> DataFrame:
    """Configurations whose stored artifacts are fewer than required."""
    done = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= required)
    return configs.join(done.select(*keys), list(keys), "left_anti")


def selection_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Size of the intersection and of both differences of two selections, as sets."""
    parts = {"both": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a)}
    out = None
    for name, part in parts.items():
        n = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out
