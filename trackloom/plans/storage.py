"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one of our own in local mode and an error on a cluster, whose machines share none."""
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not there:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(there)
    return there.rstrip("/")


def cut(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, in folders by some columns: later readers don't run its plan again, and a lost executor takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
