"""Cutting long plans with checkpoints that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        named = tempfile.mkdtemp(prefix="tablewash-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, on whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame once and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
