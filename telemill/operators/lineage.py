"""Cutting the lineage of jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs in one process."""
    told = spark.sparkContext.getCheckpointDir()
    if not told:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            told = tempfile.mkdtemp(prefix="telemill-checkpoint-")
        spark.sparkContext.setCheckpointDir(told)
        told = spark.sparkContext.getCheckpointDir()
    return told


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and reread, so that what is read of it later is pruned."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
