"""Queries: console joins, gateway, flow control, onboarding. Vehicles are customers, sources nations, fleets regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.operators import fleet, flow, onboarding
from telemill.plans import oracle as S
from telemill.plans.registry import query
from telemill.sources import fixtures


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vehicles(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("vin"), F.col("c_nationkey").alias("oem_id"), (F.col("c_nationkey") % 5).alias("fleet_id"))


def _sources(spark, d):
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("key"))


def _fleets(spark, d):
    return _t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") % 2).alias("tenant_id"))


@query("alert_join", "SELECT o_orderkey AS id, o_custkey AS vehicle_id, o_orderpriority AS kind, c_name AS vin, n_name AS source FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = c_nationkey % 5 WHERE r_regionkey % 2 = 1")
def _alerts(spark, d):
    a = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("vehicle_id"), F.col("o_orderpriority").alias("kind"))
    return fleet.alert_rows(a, _vehicles(spark, d), _sources(spark, d), _fleets(spark, d), 1)


@query("fleet_join", "SELECT r_regionkey AS id, r_name AS name, r_regionkey % 2 AS tenant_id, 'tenant ' || CAST(r_regionkey % 2 AS VARCHAR) AS tenant FROM region WHERE r_regionkey % 2 = 0")
def _fleet(spark, d):
    tenants = spark.range(1).select(F.col("id").cast("int"), F.concat(F.lit("tenant "), F.col("id").cast("string")).alias("name"))
    return fleet.fleet_rows(_fleets(spark, d), tenants)


@query("live_versions", "SELECT p_partkey AS version, CASE p_size % 4 WHEN 0 THEN 'active' ELSE 'canary' END AS state, n_name AS oem FROM part JOIN nation ON n_nationkey = p_partkey % 30 WHERE p_size % 4 < 2")
def _live(spark, d):
    state = F.element_at(F.array(*[F.lit(x) for x in ("active", "canary", "draft", "retired")]), (F.col("p_size") % 4 + 1).cast("int"))
    return fleet.live_versions(_t(spark, d, "part").select((F.col("p_partkey") % 30).alias("oem_id"), F.col("p_partkey").alias("version"), state.alias("state")), _sources(spark, d))


@query("live_state_page", "SELECT c_custkey AS vin, s.ts, s.n FROM customer LEFT JOIN (SELECT user_id, max(epoch_us(ts) // 1000) AS ts, count(*) AS n FROM events GROUP BY user_id) s ON s.user_id = c_custkey")
def _page(spark, d):
    state = _t(spark, d, "events").groupBy(F.col("user_id").alias("vin")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"), F.count("*").alias("n"))
    return fleet.with_live_state(_t(spark, d, "customer").select(F.col("c_custkey").alias("vin")), state).select("vin", "live.ts", "live.n")


@query("gateway_counts", "SELECT oem, count(*) FILTER (len(oem) BETWEEN 1 AND 32 AND size <= 30 AND dev <> '') AS accepted, count(*) FILTER (NOT (len(oem) BETWEEN 1 AND 32 AND size <= 30 AND dev <> '')) AS rejected FROM (SELECT CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 33) ELSE event_type END AS oem, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS dev, event_id % 40 AS size FROM events) GROUP BY oem")
def _gateway(spark, d):
    i = F.col("event_id")
    e = _t(spark, d, "events").select(F.when(i % 11 == 0, "").when(i % 11 == 1, "x" * 33).otherwise(F.col("event_type")).alias("oem"), F.when(i % 7 == 0, "").otherwise(F.col("user_id").cast("string")).alias("dev"), F.encode(F.repeat(F.lit("y"), (i % 40).cast("int")), "UTF-8").alias("payload"))
    return fleet.gateway_counts(fleet.gateway(e, 30))


@query("back_pressure", "SELECT user_id, event_id, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS paused FROM (SELECT *, CASE WHEN value > 60 THEN true WHEN value < 20 THEN false END AS m FROM events)")
def _pressure(spark, d):
    return flow.paused(_t(spark, d, "events").select("user_id", "event_id", F.col("value").alias("lag")), "user_id", "event_id", high=60, low=20).select("user_id", "event_id", "paused")


@query("token_bucket", "WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) // 1000 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000) AS n FROM events), f AS (SELECT user_id, ts, n, 1.0::DOUBLE AS tokens, true AS ok FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.ts, r.n, least(2.0, f.tokens + (r.ts - f.ts) / 1000.0 / 3600.0) - CASE WHEN least(2.0, f.tokens + (r.ts - f.ts) / 1000.0 / 3600.0) >= 1 THEN 1 ELSE 0 END, least(2.0, f.tokens + (r.ts - f.ts) / 1000.0 / 3600.0) >= 1 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1) SELECT user_id AS key, count(*) AS n, count(*) FILTER (ok) AS passed FROM f GROUP BY user_id")
def _bucket(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return flow.token_bucket(e, 1 / 60, 2).groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("passed"))


@query("consumer_lag", "SELECT event_type AS topic, CAST(sum(greatest(0, event_id - CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END)) AS BIGINT) AS lag FROM events GROUP BY event_type")
def _lag(spark, d):
    x = _t(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("part"), F.col("event_id").cast("long").alias("end"), F.col("user_id").cast("long").alias("pos"))
    return flow.consumer_lag(x.select("topic", "part", "end"), x.where("part % 3 <> 0").select("topic", "part", "pos"))


@query("decode_counts", f"WITH {S.TRUTH}, x AS (SELECT seq, CASE WHEN seq % 50 = 0 THEN 2 ELSE 1 END AS c FROM truth WHERE oem = 'nested') SELECT 'nested' AS oem, CAST(sum(c) FILTER (seq % 101 <> 0) AS BIGINT) AS decoded, CAST(coalesce(sum(c) FILTER (seq % 101 = 0), 0) AS BIGINT) AS failed FROM x")
def _decoded(spark, d):
    return onboarding.decode_counts(fixtures.raw_records(spark, d, ("nested",)), fixtures.SPECS["nested"]["decoder"])


@query("preview_lineage", f"WITH {S.TRUTH} SELECT seq, canonical, path, value FROM (SELECT seq, 'seq' AS canonical, 'head.no' AS path, CAST(seq AS VARCHAR) AS value FROM truth WHERE oem = 'nested' AND speed_kmh <= 320 UNION ALL SELECT seq, 'vin', 'head.car', vin FROM truth WHERE oem = 'nested' AND speed_kmh <= 320 UNION ALL SELECT seq, 'evt', 'kind', evt FROM truth WHERE oem = 'nested' AND speed_kmh <= 320)")
def _preview(spark, d):
    seen = onboarding.preview(fixtures.raw_records(spark, d, ("nested",), False), "nested", 1, fixtures.SPECS["nested"]).where("error is null")
    return seen.select(F.col("event.seq").alias("seq"), F.explode("lineage").alias("x")).select("seq", "x.canonical", "x.path", F.col("x.source_value").alias("value")).where(F.col("canonical").isin("seq", "vin", "evt"))


@query("golden_seeds", f"WITH {S.TRUTH}, r AS (SELECT *, row_number() OVER (PARTITION BY oem, evt ORDER BY CAST(speed_kmh > 5 AS INT) DESC, seq) AS e FROM truth), f AS (SELECT *, row_number() OVER (PARTITION BY oem, e <= 4 ORDER BY CAST(speed_kmh > 1 AS INT) + CAST(len(dtc) > 0 AS INT) DESC, seq) AS v FROM r) SELECT oem AS label, seq AS \"order\", CASE WHEN e <= 4 THEN 'event' ELSE 'varied' END AS why FROM f WHERE e <= 4 OR v <= 20")
def _seeds(spark, d):
    t = fixtures.truth(spark, d).select(F.col("oem").alias("label"), "evt", "speed_kmh", "dtc", F.col("seq").alias("order"))
    return onboarding.golden_seeds(t).select("label", "order", "why")
