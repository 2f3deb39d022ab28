"""Batch reports over the archive, and metrics over time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.geo import geohash_decode, geohash_encode
from telemill.plans.schema import OPTIONAL

HARSH = ("HARSH_BRAKE", "HARSH_ACCEL", "SPEEDING")


def quality(archive: DataFrame) -> DataFrame:
    """Per source: volume, vehicles, delays (replayed events left out), speeds, completeness; one shuffle."""
    fresh = ~F.coalesce("replayed", F.lit(False))
    n = F.count("vin")
    g = archive.groupBy("oem").agg(
        n.alias("rows"),
        F.count_distinct("vin").alias("vehicles"),
        F.round(F.avg(F.when(fresh, F.col("norm_ts") - F.col("rx_ts"))), 2).alias("normalize_ms_mean"),
        F.max(F.when(fresh, F.col("norm_ts") - F.col("rx_ts"))).alias("normalize_ms_max"),
        F.round(F.avg(F.when(fresh, F.col("rx_ts") - F.col("ts"))), 1).alias("arrival_delay_ms_mean"),
        F.round(F.avg(F.col("speed_kmh").cast("double")), 2).alias("speed_kmh_mean"),
        F.round(F.max(F.col("speed_kmh").cast("double")), 1).alias("speed_kmh_max"),
        F.max("map_v").alias("latest_mapping_version"),
        F.sum((~fresh).cast("bigint")).alias("replayed"),
        ((F.max("ts") - F.min("ts")) / 1000.0).alias("_span"),
        *[F.round(F.count(c) / n, 4).alias(f"has_{c}") for c in OPTIONAL],
    )
    return g.withColumn("events_per_vehicle", F.round(F.col("rows") / F.greatest(F.lit(1), F.col("vehicles")), 1)).withColumn("events_per_second", F.round(F.col("rows") / F.greatest(F.lit(1.0), F.col("_span")), 4)).drop("_span")


def event_counts(archive: DataFrame) -> DataFrame:
    return archive.where("evt is not null").groupBy("oem", "evt").agg(F.count("*").alias("n"))


def hotspots(archive: DataFrame, top: int = 20) -> DataFrame:
    g = archive.where(F.col("evt").isin(*HARSH)).groupBy("geohash5").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "geohash5").limit(top)
    at = geohash_decode(F.col("geohash5"), 5)
    return g.select("geohash5", "events", F.round(at["lat"], 4).alias("lat"), F.round(at["lon"], 4).alias("lon"))


def density(state: DataFrame, precision: int = 3, most: int = 3000) -> DataFrame:
    g = state.groupBy(geohash_encode(F.col("lat"), F.col("lon"), precision).alias("cell")).agg(F.count("*").alias("vehicles"), F.count(F.when(F.col("speed_kmh") > 3, 1)).alias("moving"))
    return g.orderBy(F.desc("vehicles"), "cell").limit(most)


def minute_rollup(events: DataFrame) -> DataFrame:
    """Events and mean speed per source and minute."""
    at = F.timestamp_millis("ts")
    return events.groupBy("oem", F.window(at, "1 minute").alias("w")).agg(F.count("*").alias("events"), F.avg("speed_kmh").alias("avg_speed")).select("oem", F.unix_millis("w.start").alias("minute_ms"), "events", "avg_speed")


def additive_minutes(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Upsert by addition: ok, failed, duplicates per source and minute; received is derived."""
    g = stored.unionByName(delta).groupBy("oem", "minute_ms").agg(*[F.sum(c).alias(c) for c in ("ok", "failed", "duplicates")])
    return g.withColumn("received", F.col("ok") + F.col("failed") + F.col("duplicates"))


def sliding_total(events: DataFrame, seconds: int, keys=("oem",), value=None) -> DataFrame:
    """Per key and second with events: events of the last ``seconds`` seconds, this one included, and the rate."""
    per = events.groupBy(*keys, F.floor(F.col("ts") / 1000).cast("bigint").alias("second")).agg((F.count("*") if value is None else F.sum(value)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("second").rangeBetween(-(seconds - 1), 0)
    return per.withColumn("total", F.sum("n").over(w)).withColumn("rate", F.col("total") / float(seconds))


def zero_filled(series: DataFrame, key: str, step: int, value: str) -> DataFrame:
    """Every step between a key's first and last one, 0 where there was nothing."""
    span = series.groupBy("oem").agg(F.min(key).alias("a"), F.max(key).alias("b")).select("oem", F.explode(F.sequence("a", "b", F.lit(step).cast("bigint"))).alias(key))
    return span.join(series, ["oem", key], "left").select("oem", key, F.coalesce(value, F.lit(0)).alias(value))


LOW_MS, HIGH_MS, GROWTH = 0.01, 120_000.0, 1.08
N_BUCKETS = math.ceil(math.log(HIGH_MS / LOW_MS) / math.log(GROWTH)) + 2


def latency_bucket(ms) -> object:
    """Log-sized bucket number of a latency."""
    n = F.floor(F.log(ms / LOW_MS) / math.log(GROWTH)).cast("int") + 1
    return F.when(ms <= LOW_MS, 0).otherwise(F.least(F.lit(N_BUCKETS - 1), n))


def histogram(rows: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """Mergeable: buckets with counts, and the maximum and sum that go with them."""
    return rows.groupBy(*keys, latency_bucket(F.col(ms)).alias("bucket")).agg(F.count("*").alias("n"), F.max(ms).alias("max"), F.sum(ms).alias("sum"))


def merge_histograms(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.max("max").alias("max"), F.sum("sum").alias("sum"))


def histogram_percentile(hist: DataFrame, keys: list[str], p: float) -> DataFrame:
    """Upper bound of the bucket that holds the percentile, at most the maximum."""
    w = Window.partitionBy(*keys)
    c = hist.withColumn("cum", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w)).withColumn("top", F.max("max").over(w))
    hit = c.where(F.col("cum") >= F.greatest(F.lit(1), F.ceil(F.col("total") * (p / 100.0))))
    return hit.groupBy(*keys).agg(F.least(F.pow(F.lit(GROWTH), F.min("bucket")) * LOW_MS, F.max("top")).alias(f"p{p:g}"))


def top_k(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def approximate_top_k(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    return rows.agg(F.expr(f"approx_top_k({key}, {k})").alias("top")).select(F.inline("top"))


def overview(outcomes: DataFrame, now_ms: int, seconds: int = 60) -> DataFrame:
    """Per source: rates over the last seconds, totals and success ratio; ``outcomes(oem, kind, ts)``."""
    last = F.col("ts") > now_ms - seconds * 1000
    of = lambda k: F.col("kind") == k
    g = outcomes.groupBy("oem").agg(*[F.count(F.when(of(k), 1)).alias(f"{k}_total") for k in ("ok", "failed", "duplicate")], *[F.count(F.when(of(k) & last, 1)).alias(f"{k}_last") for k in ("ok", "failed", "duplicate")])
    return g.withColumn("success", F.round(F.try_divide(F.col("ok_total"), F.col("ok_total") + F.col("failed_total")), 6)).withColumn("ok_per_s", F.round(F.col("ok_last") / float(seconds), 6))


def canary_health(outcomes: DataFrame, now_ms: int, least: int = 200, most_rate: float = 0.05) -> DataFrame:
    """Canaries of the last minute, and whether the guard takes them back."""
    g = outcomes.where((F.col("ts") > now_ms - 60_000) & F.col("canary")).groupBy("oem", "version").agg(F.count(F.when(F.col("kind") == "ok", 1)).alias("ok"), F.count(F.when(F.col("kind") == "failed", 1)).alias("failed"))
    rate = F.col("failed") / F.greatest(F.lit(1), F.col("ok") + F.col("failed"))
    return g.withColumn("rate", F.round(rate, 6)).withColumn("roll_back", (F.col("failed") >= least) & (rate > most_rate))


def merge_snapshots(snapshots: DataFrame) -> DataFrame:
    """Additive worker deltas ``(ts, stats array<struct(oem, key, n)>)`` to totals per second."""
    s = snapshots.select(F.floor(F.col("ts") / 1000).cast("bigint").alias("second"), F.inline("stats"))
    return s.groupBy("second", "oem", "key").agg(F.sum("n").alias("n"))


def prometheus(counts: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Exposition lines, one a row."""
    said = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), F.col(k), F.lit('"')) for k in labels])
    return counts.select(F.format_string(f"{metric}{{%s}} %s", said, F.col(value).cast("string")).alias("line"))


def alert_ratio(outcomes: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Share of dead letters per source over sliding windows."""
    g = outcomes.groupBy("oem", F.window(F.timestamp_millis("ts"), window, slide).alias("w")).agg(F.count(F.when(F.col("kind") == "failed", 1)).alias("failed"), F.count("*").alias("n"))
    return g.select("oem", F.unix_millis("w.start").alias("start_ms"), "failed", "n", F.round(F.col("failed") / F.col("n"), 6).alias("share"))
