"""Structured Streaming wiring: raw topic to events, dead letters, state, alerts and archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators.dedup import stream_deduplicated
from telemill.operators.normalize import canonical, dead_letters, outcomes
from telemill.operators.state import alerts, latest_state, merge_state
from telemill.plans.schema import RAW
from telemill.sources.archive import consume, upsert_once, write_archive


def normalizer(spark: SparkSession, topic: str, table, now_ms: int, files_per_batch: int = 4) -> tuple[DataFrame, DataFrame]:
    """Streams of de-duplicated events and of dead letters; the batch columns, over a stream."""
    out = outcomes(consume(spark, topic, RAW, files_per_batch), table)
    return stream_deduplicated(canonical(out, now_ms)), dead_letters(out, now_ms)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is available and stop; the checkpoint makes a rerun add only what is new."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def minute_counts(events: DataFrame, lateness: str = "30 seconds") -> DataFrame:
    """Tumbling minutes with a watermark."""
    at = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", lateness)
    return at.groupBy("oem", F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("events")).select("oem", F.unix_millis("w.start").alias("minute_ms"), "events")


def sessions(events: DataFrame, gap: str = "90 seconds", lateness: str = "30 seconds") -> DataFrame:
    at = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", lateness)
    return at.groupBy("vin", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("points")).select("vin", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "points")


class Processor:
    """``foreachBatch`` sink: archive, latest state and alerts, each idempotent by batch id or natural key."""

    def __init__(self, root: str, write_ms: int):
        self.root, self.write_ms = root, write_ms

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            write_archive(batch, f"{self.root}/archive", self.write_ms, batch_id)
            # an alert that an earlier batch has stored is not stored again; a repeated batch writes the same folder
            found = alerts(batch)
            if batch_id:
                stored = spark.read.parquet(f"{self.root}/alerts").where(F.col("batch") < batch_id)
                found = upsert_once(stored, found, ("vin", "kind", "ts"))
            found.write.mode("overwrite").parquet(f"{self.root}/alerts/batch={batch_id}")
            # state n comes from state n - 1, so a repeated batch writes the same table again
            new = latest_state(batch)
            old = f"{self.root}/state/{batch_id - 1}"
            state = merge_state(spark.read.parquet(old), batch) if batch_id else new
            state.write.mode("overwrite").parquet(f"{self.root}/state/{batch_id}")
        finally:
            batch.unpersist()


def process(events: DataFrame, root: str, checkpoint: str, write_ms: int) -> None:
    events.writeStream.foreachBatch(Processor(root, write_ms)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
