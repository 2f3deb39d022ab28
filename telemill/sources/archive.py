"""Parquet archive and file-backed topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.geo import geohash_encode
from telemill.operators.ordered import numbered
from telemill.plans.schema import ARCHIVE


def archive_rows(events: DataFrame) -> DataFrame:
    """Events in the archive's schema: unknown columns are ignored, missing ones null, five fields narrowed to float."""
    e = events.withColumn("geohash5", geohash_encode(F.col("lat"), F.col("lon"), 5))
    return e.select(*[(F.col(f.name) if f.name in e.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ARCHIVE])


def write_archive(events: DataFrame, root: str, write_ms: int, batch_id: int | None = None) -> None:
    """Append under ``dt=/hour=`` of the write time, sorted by vehicle and time inside files.

    With a batch id the rows go to a folder of that batch and overwrite it, so a repeated micro-batch adds nothing.
    """
    at = F.timestamp_millis(F.lit(write_ms))
    rows = archive_rows(events).withColumn("dt", F.date_format(at, "yyyy-MM-dd")).withColumn("hour", F.date_format(at, "HH"))
    w = rows.repartition("vin").sortWithinPartitions("vin", "ts").write.option("compression", "zstd")
    if batch_id is None:
        w.mode("append").partitionBy("dt", "hour").parquet(root)
    else:
        rows.withColumn("batch", F.lit(batch_id)).repartition("vin").sortWithinPartitions("vin", "ts").write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch", "dt", "hour").parquet(root)


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).option("ignoreMissingFiles", "true").parquet(root)


def vehicle_history(archive: DataFrame, vin: str, limit: int, since_ms: int | None = None) -> DataFrame:
    """Newest rows of one vehicle; both predicates reach the Parquet scan."""
    rows = archive.where(F.col("vin") == vin)
    if since_ms is not None:
        rows = rows.where(F.col("ts") >= since_ms)
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def upsert_once(target: DataFrame, batch: DataFrame, keys=("vin", "ts", "seq")) -> DataFrame:
    """Rows of ``batch`` that are new by their key, each once: what an idempotent insert appends."""
    return batch.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def retained(files: DataFrame, budget: int) -> DataFrame:
    """Files ``(path, size, written)`` with ``keep``: the newest ones within the byte budget, and always the newest."""
    return numbered(files, F.desc("written"), F.desc("path"), total=F.col("size")).withColumn("keep", (F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def to_csv_rows(rows: DataFrame) -> DataFrame:
    """CSV lines with microsecond timestamps and ``{a,b}`` arrays."""
    said = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = F.concat(F.lit("{"), F.array_join(c, ","), F.lit("}"))
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        else:
            c = c.cast("string")
        quoted = F.when(c.rlike("[\",\\r\\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        said.append(F.coalesce(quoted, F.lit("")))
    return rows.select(F.concat_ws(",", *said).alias("line"))


def produce(records: DataFrame, topic: str, partitions: int = 8) -> None:
    """Append records to a topic folder, dealt by their key."""
    records.repartition(partitions, "key").write.mode("append").parquet(topic)


def consume(spark: SparkSession, topic: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A topic folder as a stream; the checkpoint holds the offsets."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("ignoreMissingFiles", "true").parquet(topic)
