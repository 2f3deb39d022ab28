"""Latest state, alerts and late flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values
ALERTS = {"HARSH_BRAKE": "warning", "HARSH_ACCEL": "warning", "SPEEDING": "warning", "LOW_SOC": "critical"}
CRITICAL_PREFIX = ("P0A", "P0AA", "U01", "P1E")
LATENESS_MS = 30_000


def latest_state(events: DataFrame) -> DataFrame:
    """Newest event per vehicle by event time, ties to the later arrival, with the count of all events, stale ones too."""
    rest = [c for c in events.columns if c != "vin"]
    g = events.groupBy("vin").agg(F.max_by(F.struct(*rest), F.struct("ts", "part", "off")).alias("s"), F.count("*").alias("events"))
    return g.select("vin", "s.*", "events")


def merge_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a micro-batch: both sides are one row a vehicle, so the merge is one small aggregate."""
    new = latest_state(batch)
    both = state.unionByName(new)
    rest = [c for c in state.columns if c not in ("vin", "events")]
    g = both.groupBy("vin").agg(F.max_by(F.struct(*rest), F.struct("ts", "part", "off")).alias("s"), F.sum("events").alias("events"))
    return g.select("vin", "s.*", "events")


def newest_in_batch(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("vin").orderBy(F.desc("ts"), F.desc("part"), F.desc("off"))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def late_flags(events: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """``late``: event time below the batch's watermark, which is taken before the test; late rows stay."""
    top = events.agg(F.max("ts").alias("_top"))
    return events.crossJoin(F.broadcast(top)).withColumn("late", F.col("ts") < F.col("_top") - lateness_ms).drop("_top")  # one row on the right


def new_codes(events: DataFrame) -> DataFrame:
    """Trouble codes that the vehicle's previous non-empty set did not hold; the first set is silent."""
    w = Window.partitionBy("vin").orderBy("part", "off")
    seen = events.where(F.size("dtc") > 0).withColumn("before", F.lag("dtc").over(w))
    fresh = F.array_sort(F.array_except("dtc", "before"))
    return seen.where(F.col("before").isNotNull()).withColumn("codes", fresh).where(F.size("codes") > 0)


def alerts(events: DataFrame) -> DataFrame:
    """Event alerts with severity, and alerts about new trouble codes; unique by (vehicle, kind, ts)."""
    table = F.create_map(*[F.lit(x) for kv in ALERTS.items() for x in kv])
    severity = F.when((F.col("evt") == "LOW_SOC") & (F.coalesce("soc_pct", F.lit(0.0)) >= 8), "warning").otherwise(F.try_element_at(table, F.col("evt")))
    by_event = events.where(F.col("evt").isin(*ALERTS)).select("vin", F.col("evt").alias("kind"), severity.alias("severity"), "ts", F.array().cast("array<string>").alias("codes"))
    critical = F.exists("codes", lambda c: F.coalesce(*[F.when(c.startswith(p), True) for p in CRITICAL_PREFIX], F.lit(False)))
    by_code = new_codes(events).select("vin", F.lit("DTC").alias("kind"), F.when(critical, "critical").otherwise("warning").alias("severity"), "ts", "codes")
    return by_event.union(by_code).dropDuplicates(["vin", "kind", "ts"])


def known_vehicle(events: DataFrame, vehicles: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """Index of the vehicle in the dimension, -1 if unknown. The dimension is broadcast only while it is small."""
    side = vehicles.select("vin", F.col("vehicle_id").alias("_id"))
    if side.limit(most_rows + 1).count() <= most_rows:
        side = F.broadcast(side)
    return events.join(side, "vin", "left").withColumn("vehicle_index", F.coalesce("_id", F.lit(-1))).drop("_id")
