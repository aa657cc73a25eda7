"""Product sinks: partitioned parquet, text, states saved and resumed by step, tracer settings."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_RECORD = "step long, name string, columns string"


def write_product(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``; rerunning a task leaves the same result."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def snr_summary(counts: DataFrame, configs: Sequence[str], bin_col: str = "bin", config: str = "model", value: str = "n") -> DataFrame:
    """One row per S/N bin, one column per configuration."""
    return counts.groupBy(bin_col).pivot(config, list(configs)).agg(F.sum(value))


def latest_checkpoint(records: DataFrame, keys: Sequence[str], step: str, path: str) -> DataFrame:
    """Newest record per key; the highest path on equal steps."""
    best = records.groupBy(*keys).agg(F.max(F.struct(step, path)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{step}").alias(step), F.col(f"_b.{path}").alias(path))


def save_state(state: DataFrame, folder: str, step: int) -> None:
    """The state after ``step``: a table of its own first, then one record that points to it.

    A run that stops before the record is written has saved nothing; its table is never looked at. The same step may be saved again; any
    of its complete tables will do.
    """
    name = f"step-{step}-{uuid.uuid4().hex}"
    state.write.parquet(f"{folder}/tables/{name}")
    _point(state.sparkSession, folder, step, name, state.schema.json())


def _point(spark: SparkSession, folder: str, step: int, name: str, columns: str) -> None:
    spark.createDataFrame([(step, name, columns)], _RECORD).coalesce(1).write.mode("append").parquet(f"{folder}/records")


def load_state(spark: SparkSession, folder: str) -> tuple[int, DataFrame] | None:
    """(step, state) of the last step saved whole; None where none was."""
    try:
        records = spark.read.schema(_RECORD).parquet(f"{folder}/records")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = records.orderBy(F.col("step").desc(), "name").first()
    if last is None:
        return None
    return last["step"], spark.read.schema(StructType.fromJson(json.loads(last["columns"]))).parquet(f"{folder}/tables/{last['name']}")


def resumed(start: DataFrame, folder: str, steps: int, advance: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The state after ``steps`` steps of ``advance(state, step)``, going on from the last one saved below ``folder``.

    Each step reads the table of the one before, so plans stay short and a lost executor costs one step.
    """
    spark = start.sparkSession
    done, state = load_state(spark, folder) or (-1, start)
    for step in range(done + 1, steps):
        save_state(advance(state, step), folder, step)
        _, state = load_state(spark, folder)
    return state


def tracer_settings(runs: DataFrame, keys: Sequence[str], snap: str, options: dict[str, Column]) -> DataFrame:
    """Text of an external tracer's settings, one ``key = value`` line per option."""
    snaps = runs.select(*keys, snap).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(snap)).alias("_s"))
    listed = F.concat_ws(", ", F.transform("_s", lambda v: v.cast("string")))
    lines = [F.concat(F.lit(f"{k} = "), v.cast("string")) for k, v in options.items()]
    return snaps.select(*keys, F.concat_ws("\n", *lines, F.concat(F.lit("snapshot_list = "), listed)).alias("settings"))
