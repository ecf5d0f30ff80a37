"""Cutting lineage of iterative jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder if the master is local (tests), and an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
