"""Cutting lineage with a written table in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, prefix: str = "t") -> str:
    """A new folder below spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own; on a
    cluster that is an error, as executors don't see the driver's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to a folder that all executors share and read again."""
    path = shared_folder(df.sparkSession, "k")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
