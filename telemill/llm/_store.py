"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and all runs in one process."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="telemill-scratch-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told


#: rows that go to a Python worker at once, so that a batch of texts is a few MB
BATCH_ROWS = 1024


@contextmanager
def settings(spark: SparkSession, **values: object):
    """Settings of the session (``_`` for ``.``) that hold for the jobs inside, and are then as before."""
    names = {f"spark.sql.{k.replace('_', '.')}": str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, path: str, wide: bool = False) -> None:
    """Write Parquet in few files: partitions of a shuffle are joined up to the advisory size, unless ``wide`` asks for
    as many tasks as there are cores. Python workers get small batches."""
    with settings(df.sparkSession, execution_arrow_maxRecordsPerBatch=BATCH_ROWS, adaptive_coalescePartitions_parallelismFirst=str(wide).lower()):
        df.write.parquet(path)


class Scratch:
    """The intermediate tables of one run, in a folder of their own.

    Writing cuts the lineage (a lost executor costs only the stage in flight), and a reread
    frame carries no partitioning, so later joins add exchanges that AQE may split.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.dir = f"{scratch_dir(spark)}/telemill-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str, wide: bool = False) -> DataFrame:
        path = f"{self.dir}/{len(self.tables):03d}-{name}"
        save(df, path, wide)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for frame, path in self.tables:
            if any(frame is f for f in frames):
                delete(self.spark, path)

    def close(self, *kept: DataFrame) -> None:
        """Delete all tables but those that a result still reads."""
        self.drop(*[f for f, _ in self.tables if not any(f is k for k in kept)])


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    return Scratch(df.sparkSession).write(df, name, wide)


def parts_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
