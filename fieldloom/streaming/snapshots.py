"""Chunk-by-chunk accumulation over new snapshot files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_chunks(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """Particle files as a stream; a trigger takes at most ``max_files``. ``path``: a folder, or a glob of files and folders."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def accumulate(
    chunks: DataFrame,
    partial: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    keys: Sequence[str],
):
    """Run ``partial`` on each micro-batch and store its sums under the batch number.

    A batch that is run again replaces its own folder, so every chunk counts once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        chunks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def combine(spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Total over all stored batches."""
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
