"""The session's shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir, which every executor has to see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def opened(where: str) -> tuple:
    """File system and path, for any place Arrow knows."""
    from pyarrow import fs

    if where.startswith("file:"):
        where = "/" + where[5:].lstrip("/")
    elif where.startswith("s3a:"):
        where = "s3" + where[3:]
    return fs.FileSystem.from_uri(where)
