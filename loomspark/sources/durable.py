"""Checkpoints in the shared folder that the session names: they survive lost executors and cut the lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder of spark.checkpoint.dir; one of our own only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomspark-"))


def checkpoint(frame: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
