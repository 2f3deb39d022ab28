"""Raw records to canonical events, dead letters and duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators.lineage import stored
from telemill.plans.compile import ERROR
from telemill.plans.route import Routes
from telemill.plans.schema import CANONICAL, FIELDS, MAX_PAYLOAD


def outcomes(raw: DataFrame, table: dict[str, Routes]) -> DataFrame:
    """``raw`` with ``event``, ``error`` and ``version``.

    Each source has its own expression over its own rows, so no generated method holds all sources.
    """
    # inferring constraints over hundreds of aliased columns takes the optimizer minutes, and no filter here gains from it
    raw.sparkSession.conf.set("spark.sql.constraintPropagation.enabled", "false")
    fits = F.length("value") <= MAX_PAYLOAD
    parts = [r.read(raw.where((F.col("oem") == oem) & fits)) for oem, r in table.items()]
    size = F.concat(F.length("value").cast("string"), F.lit(" bytes"))
    error = F.when(~fits, F.struct(F.lit("OVERSIZE").alias("reason"), F.lit("").alias("field"), size.alias("detail"))).otherwise(F.struct(F.lit("NO_ADAPTER").alias("reason"), F.lit("").alias("field"), F.lit("no live mapping for this source").alias("detail")))
    rest = raw.where(~(fits & F.coalesce(F.col("oem").isin(*table), F.lit(False)))) if table else raw
    parts.append(rest.select("*", F.lit(None).cast(CANONICAL).alias("event"), error.cast(ERROR).alias("error"), F.lit(0).alias("version"), F.lit(0).alias("attempt")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Normalized:
    events: DataFrame
    dead: DataFrame
    duplicates: DataFrame


def canonical(out: DataFrame, now_ms: int) -> DataFrame:
    """Events with their lineage; the arrival place is kept for ordered steps."""
    return out.where("error is null").select("event.*", "oem", F.col("version").alias("map_v"), F.coalesce("rx", F.lit(now_ms)).alias("rx_ts"), F.lit(now_ms).alias("norm_ts"), F.coalesce(F.col("replay") > 0, F.lit(False)).alias("replayed"), "part", "off")


def dead_letters(out: DataFrame, now_ms: int) -> DataFrame:
    return out.where("error is not null").select("key", "value", "oem", "rx", "error.reason", "error.field", F.substring("error.detail", 1, 160).alias("detail"), F.col("version").alias("tried_v"), F.lit(now_ms).alias("dead_ts"), F.col("key").cast("string").alias("dev"), (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"), "part", "off")


def first_of_key(events: DataFrame) -> DataFrame:
    """Rank of each event among those of the same vehicle and sequence number, in arrival order."""
    w = Window.partitionBy("vin", "seq").orderBy("part", "off")
    return events.withColumn("copy", F.row_number().over(w))


def normalize(raw: DataFrame, table: dict[str, Routes], now_ms: int) -> Normalized:
    """Batch form. De-duplication runs on the mapped events, so a dead letter uses up no sequence number.

    The outcomes are written once, as events, dead letters and duplicates are all made from them.
    """
    out = stored(outcomes(raw, table))
    ranked = first_of_key(canonical(out, now_ms))
    return Normalized(ranked.where("copy = 1").drop("copy"), dead_letters(out, now_ms), ranked.where("copy > 1").drop("copy"))


def outcome_stats(n: Normalized) -> DataFrame:
    """Counts by (source, version), (source, reason) and (source, reason, field) in one pass over one outcome frame."""
    ok = n.events.select("oem", F.col("map_v").alias("version"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("field"))
    bad = n.dead.select("oem", F.lit(None).cast("int").alias("version"), "reason", "field")
    return ok.union(bad).groupingSets([["oem", "version"], ["oem", "reason"], ["oem", "reason", "field"]], "oem", "version", "reason", "field").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


FIELD_NAMES = [f.name for f in FIELDS]
