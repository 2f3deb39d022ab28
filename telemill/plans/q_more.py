"""Queries: as-of join, map samples, replay epochs, merged histograms, the archive and the device bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from telemill.operators import dedup, governance, relational, reports, state
from telemill.operators.lineage import shared_dir
from telemill.plans import oracle as S
from telemill.plans.q_core import _good
from telemill.plans.registry import query
from telemill.sources import archive


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


@query("join_as_of", "WITH l AS (SELECT user_id, event_id FROM events WHERE event_type <> 'purchase'), r AS (SELECT user_id, event_id, value AS price FROM events WHERE event_type = 'purchase') SELECT l.user_id, l.event_id, r.price FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.event_id >= r.event_id")
def _as_of(spark, d):
    e = _events(spark, d)
    bought = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("value").alias("price"))
    return relational.as_of(e.where("event_type <> 'purchase'").select("user_id", "event_id"), bought, "user_id", "event_id", "price")


@query("map_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, (count(*) OVER () + 499) // 500 AS s FROM orders) WHERE n % s = 0")
def _sample(spark, d):
    return relational.bounded_sample(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey", 500)


@query("in_box", f"WITH {S.TRUTH} SELECT seq FROM good WHERE lat BETWEEN -10 AND 25.5 AND lon BETWEEN -100 AND 12")
def _box(spark, d):
    return _good(spark, d).where(relational.in_box(F.col("lat"), F.col("lon"), -10, -100, 25.5, 12)).select("seq")


@query("newest_in_batch", f"WITH {S.TRUTH} SELECT vin, seq FROM (SELECT vin, seq, row_number() OVER (PARTITION BY vin ORDER BY ts DESC, rx DESC) AS n FROM good) WHERE n = 1")
def _newest(spark, d):
    return state.newest_in_batch(_good(spark, d)).select("vin", "seq")


@query("replay_epochs", "SELECT user_id AS vin, event_id AS seq, CAST(count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS epoch FROM events")
def _epochs(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("vin"), F.col("event_id").alias("seq"), F.lit(0).alias("part"), F.col("event_id").alias("off"), "event_type")
    return dedup.reset_window(e.drop("event_type"), e.where("event_type = 'signup'")).select("vin", "seq", "epoch")


@query("histogram_merge", f"WITH {S.TRUTH}, b AS (SELECT oem, CASE WHEN speed_kmh <= 0.01 THEN 0 ELSE least({reports.N_BUCKETS - 1}, CAST(floor(ln(speed_kmh / 0.01) / ln(1.08)) AS INT) + 1) END AS bucket FROM good) SELECT oem, bucket, count(*) AS n FROM b GROUP BY oem, bucket")
def _merged(spark, d):
    parts = reports.histogram(_good(spark, d).withColumn("worker", F.col("seq") % 5), ["oem", "worker"], "speed_kmh")
    return reports.merge_histograms(parts, ["oem"]).select("oem", "bucket", "n")


@query("archive_round_trip", f"WITH {S.TRUTH} SELECT vin, seq, ts, CAST(CAST(speed_kmh AS FLOAT) AS DOUBLE) AS speed_kmh, odo_km, evt, '2027-01-15' AS dt, CAST('08' AS VARCHAR) AS hour FROM good")
def _archive(spark, d):
    root = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    e = _good(spark, d)
    for batch in (0, 1, 1):  # a repeated batch adds nothing
        archive.write_archive(e.where(F.col("seq") % 2 == batch), root, 1_800_000_000_000, batch)
    rows = archive.read_archive(spark, root)
    at = F.timestamp_millis(F.lit(1_800_000_000_000))
    return rows.select("vin", "seq", "ts", F.col("speed_kmh").cast("double").alias("speed_kmh"), "odo_km", "evt", F.date_format(at, "yyyy-MM-dd").alias("dt"), F.date_format(at, "HH").alias("hour"))


@query("golden_mismatch", f"WITH {S.TRUTH} SELECT 'lat' AS field, round(avg(CASE WHEN seq % 3 = 1 THEN 0.0 ELSE 1.0 END), 9) AS accuracy FROM good UNION ALL SELECT 'speed_kmh', round(avg(CASE WHEN seq % 5 = 2 THEN 0.0 ELSE 1.0 END), 9) FROM good UNION ALL SELECT 'evt', round(avg(CASE WHEN seq % 7 = 3 THEN 0.0 ELSE 1.0 END), 9) FROM good")
def _mismatch(spark, d):
    want = _good(spark, d).select(F.col("seq").alias("case"), "lat", "speed_kmh", "evt")
    i = F.col("case")
    got = want.withColumn("lat", F.col("lat") + F.when(i % 3 == 1, 3e-6).otherwise(1e-6)).withColumn("speed_kmh", F.when(i % 5 == 2, None).otherwise(F.col("speed_kmh") - 0.01)).withColumn("evt", F.when(i % 7 == 3, "OTHER").otherwise(F.col("evt")))
    return governance.golden_report(governance.golden(got, want, ["lat", "speed_kmh", "evt"]))[1].withColumn("accuracy", F.round("accuracy", 9))
