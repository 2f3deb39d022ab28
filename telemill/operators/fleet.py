"""Console reads over the fleet tables, and what the gateway lets in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators.relational import small
from telemill.plans.schema import MAX_PAYLOAD

LIVE = ("active", "canary")
SOURCE_MOST = 32  # characters of a source id


def alert_rows(alerts: DataFrame, vehicles: DataFrame, sources: DataFrame, fleets: DataFrame | None = None, tenant: int | None = None) -> DataFrame:
    """``alerts(vehicle_id, ...)`` with ``vin`` and ``source``; for a tenant only those of its ``fleets(id, tenant_id)``."""
    v = vehicles.select(F.col("id").alias("vehicle_id"), "vin", F.col("oem_id").alias("_oem"), F.col("fleet_id").alias("_fleet"))
    if tenant is not None:
        own = fleets.where(F.col("tenant_id") == tenant).select(F.col("id").alias("_fleet"))
        v = v.join(small(own), "_fleet", "left_semi")
    named = v.join(small(sources.select(F.col("id").alias("_oem"), F.col("key").alias("source"))), "_oem").select("vehicle_id", "vin", "source")
    return alerts.join(named, "vehicle_id")


def fleet_rows(fleets: DataFrame, tenants: DataFrame, tenant: int | None = None) -> DataFrame:
    """``fleets(id, name, tenant_id)`` with the name of their tenant; a fleet without one is absent."""
    rows = fleets if tenant is None else fleets.where(F.col("tenant_id") == tenant)
    return rows.join(small(tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant"))), "tenant_id").select("id", "name", "tenant_id", "tenant")


def live_versions(versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Versions in a live state with the key of their source: what a routing table is made from."""
    named = sources.select(F.col("id").alias("oem_id"), F.col("key").alias("oem"))
    return versions.where(F.col("state").isin(*LIVE)).join(small(named), "oem_id").drop("oem_id")


def with_live_state(page: DataFrame, state: DataFrame) -> DataFrame:
    """A page of vehicles with the latest state of each as ``live``, null where there is none."""
    held = state.select("vin", F.struct(*[c for c in state.columns if c != "vin"]).alias("live"))
    return page.join(held, "vin", "left")


def gateway(submitted: DataFrame, limit: int = 4 * MAX_PAYLOAD) -> DataFrame:
    """``submitted(oem, dev, payload, ...)`` with ``refused``: why a record is not taken, or null.

    A source id must have 1 to 32 characters, a record a device and at most ``limit`` bytes.
    """
    source = F.coalesce(F.length("oem"), F.lit(0)).between(1, SOURCE_MOST)
    why = F.when(~source, "source").when(F.coalesce(F.octet_length("payload"), F.lit(0)) > limit, "oversize").when(F.coalesce(F.length("dev"), F.lit(0)) == 0, "device")
    return submitted.withColumn("refused", why)


def gateway_counts(judged: DataFrame) -> DataFrame:
    """Accepted and refused records by source."""
    return judged.groupBy("oem").agg(F.count(F.when(F.col("refused").isNull(), 1)).alias("accepted"), F.count("refused").alias("rejected"))
