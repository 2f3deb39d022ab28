"""Queries: decode, transform, validate, normalise, route, de-duplicate, state, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from telemill.functions import geo, text, values, vehicle
from telemill.functions.units import UNITS
from telemill.operators import dedup, dlq, governance, normalize, reports, state, trips
from telemill.plans import oracle as S
from telemill.plans.compile import validate
from telemill.plans.registry import query
from telemill.plans.route import routing_table
from telemill.plans.schema import FIELDS
from telemill.sources import archive, decoders, fixtures

NOW = 1_800_000_000_000
T = S.TRUTH
_COLS = [f.name for f in FIELDS]


def _truth(spark, d):
    return fixtures.truth(spark, d)


def _events(spark, d, dialects=fixtures.DIALECTS, faults=True):
    return normalize.normalize(fixtures.raw_records(spark, d, dialects, faults), fixtures.live_table(dialects), NOW)


def _good(spark, d):
    """Clean canonical events with an arrival place, for operators behind the normaliser."""
    t = _truth(spark, d).where("seq % 101 <> 0 and seq % 211 <> 0 and speed_kmh <= 320")
    late = F.when(F.col("seq") % 37 == 0, 3_600_000).otherwise(0)
    rx = F.col("ts") + late + 250
    return t.select(*_COLS, "oem", "user_id", F.lit(1).alias("map_v"), rx.alias("rx_ts"), (rx + 40 + F.col("seq") % 7).alias("norm_ts"), (F.col("seq") % 13 == 0).alias("replayed"), F.lit(0).alias("part"), (rx * 4 + 1).alias("off"))


# ---- decoders: payload to fields, against the facts they were made from

_FIELDS = {"nested": "fuel_pct, CAST(len(dtc) AS DOUBLE) AS codes", "flat": "fuel_pct, CAST(nullif(len(dtc), 0) AS DOUBLE) AS codes", "pipe": "fuel_pct, CAST(nullif(len(dtc), 0) AS DOUBLE) AS codes", "signals": "CAST(NULL AS DOUBLE) AS fuel_pct, CAST(NULL AS DOUBLE) AS codes", "pairs": "CAST(NULL AS DOUBLE) AS fuel_pct, CAST(nullif(len(dtc), 0) AS DOUBLE) AS codes"}


def _decode(dialect):
    def run(spark, d):
        e = normalize.canonical(normalize.outcomes(fixtures.raw_records(spark, d, (dialect,), False), fixtures.live_table((dialect,))), NOW)
        return e.select("vin", "ts", "seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "speed_kmh", F.round("odo_km", 3).alias("odo_km"), F.round("fuel_pct", 4).alias("fuel_pct"), F.when(F.col("dtc").isNotNull(), F.size("dtc").cast("double")).alias("codes"), "ignition", "evt")

    sql = f"WITH {T} SELECT vin, ts, seq, round(lat, 6) AS lat, round(lon, 6) AS lon, speed_kmh, round(odo_km, 3) AS odo_km, {_FIELDS[dialect]}, ignition, evt FROM truth WHERE oem = '{dialect}' AND speed_kmh <= 320"
    query(f"decode_{dialect}", sql)(run)


for _d in fixtures.DIALECTS:
    _decode(_d)


@query("decode_flatten", f"WITH {T} SELECT seq, CASE WHEN oem = 'nested' THEN 15 ELSE 12 END - CAST(soc_pct IS NULL AS INT) - CAST(fuel_pct IS NULL AS INT) + CASE WHEN oem = 'flat' THEN 2 ELSE -1 END AS leaves FROM truth WHERE oem IN ('nested', 'flat')")
def _flatten(spark, d):
    r = fixtures.raw_records(spark, d, ("nested", "flat"), False)
    v = F.try_parse_json(F.col("value").cast("string"))
    seq = F.coalesce(F.try_variant_get(v, "$.head.no", "bigint"), F.try_variant_get(v, "$.n", "bigint"))
    return decoders.flatten_paths(r.select(seq.alias("seq"), v.alias("v")), "v", "paths").select("seq", F.size("paths").alias("leaves"))


@query("wire_detect", "SELECT * FROM (VALUES ('nested', 'json', NULL, 0), ('flat', 'json', NULL, 0), ('signals', 'json', NULL, 0), ('pipe', 'delimited', '|', 15), ('pairs', 'kv', ';', 0)) t(oem, type, separator, columns)")
def _detect(spark, d):
    return decoders.detect_format(fixtures.raw_records(spark, d)).drop("samples").withColumn("columns", F.coalesce("columns", F.lit(0)))


@query("topic_parse", "SELECT event_id, 'src' || CAST(user_id % 5 AS VARCHAR) AS oem, CAST(user_id AS VARCHAR) AS dev FROM events WHERE event_id % 3 <> 0")
def _topic(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    topic = F.concat(F.lit("oem/src"), (F.col("user_id") % 5).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "/status").otherwise("/telemetry"))
    return e.withColumn("t", decoders.parse_topic(topic)).where("t is not null").select("event_id", "t.oem", "t.dev")


@query("http_intake", "SELECT event_id, CAST(n AS INT) AS n FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM events)")
def _intake(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    req = e.select("event_id", F.concat_ws("\n", F.col("event_type"), F.lit(""), F.col("props"), F.lit(" ")).alias("body"), F.when(F.col("event_id") % 2 == 0, "text/plain").otherwise("application/json").alias("content_type"))
    return decoders.intake(req).groupBy("event_id").agg(F.count("*").cast("int").alias("n"))


# ---- transforms

_OPS = {
    "scale": ("lineitem", "l_quantity", {"op": "scale", "factor": 0.25}, "l_quantity * 0.25"),
    "affine": ("lineitem", "l_quantity", {"op": "affine", "factor": 1.5, "offset": -3.0}, "l_quantity * 1.5 + -3.0"),
    "to_int": ("lineitem", "l_extendedprice", "to_int", "CAST(round_even(l_extendedprice, 0) AS BIGINT)"),
    "to_float": ("lineitem", "cast(l_quantity as string)", "to_float", "l_quantity"),
    "round": ("lineitem", "l_quantity / 8", {"op": "round", "digits": 2}, "round_even(l_quantity / 8, 2)"),
    "to_str": ("lineitem", "l_returnflag", "to_str", "l_returnflag"),
    "upper": ("lineitem", "lower(l_returnflag)", "upper", "upper(lower(l_returnflag))"),
    "strip": ("lineitem", "concat('  ', l_returnflag, ' \\t')", "strip", "l_returnflag"),
    "to_bool": ("lineitem", "case when l_linenumber % 3 = 0 then 'ON' when l_linenumber % 3 = 1 then ' no ' else '2' end", "to_bool", "l_linenumber % 3 <> 1"),
    "split": ("part", "p_type", {"op": "split", "sep": " "}, "string_split(p_type, ' ')"),
    "enum": ("lineitem", "l_returnflag", {"op": "enum", "map": {"A": "alpha", "R": "return"}, "default": "other"}, "CASE l_returnflag WHEN 'A' THEN 'alpha' WHEN 'R' THEN 'return' ELSE 'other' END"),
    "iso8601": ("orders", "date_format(cast(o_orderdate as timestamp), \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\")", "iso8601", "epoch_ms(o_orderdate) - 7200000"),
}
_KEY = {"lineitem": ("l_orderkey", "l_linenumber"), "part": ("p_partkey",), "orders": ("o_orderkey",)}


def _transform(name, table, source, op, sql):
    keys = _KEY[table]

    def run(spark, d):
        col = F.expr(source)
        t = spark.read.parquet(f"{d}/{table}.parquet")
        kind = "num" if name in ("scale", "affine", "to_int", "round") else "raw"
        v = values.apply(values.Value(col.cast("double") if kind == "num" else col, kind, F.lit(False)), op)
        return t.select(*keys, v.col.alias("out"), v.bad.alias("bad"))

    query(f"transform_{name}", f"SELECT {', '.join(keys)}, {sql} AS out, false AS bad FROM {table}")(run)


for _n, (_t, _s, _o, _q) in _OPS.items():
    _transform(_n, _t, _s, _o, _q)


@query("transform_index", "SELECT p_partkey, string_split(p_type, ' ')[1] AS first, string_split(p_type, ' ')[-1] AS last, len(string_split(p_type, ' ')) < 3 AS third_bad FROM part")
def _index(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    v = values.apply(values.Value(F.col("p_type"), "raw", F.lit(False)), {"op": "split", "sep": " "})
    at = lambda i: values.apply(v, {"op": "index", "i": i})
    return t.select("p_partkey", at(0).col.alias("first"), at(-1).col.alias("last"), at(2).bad.alias("third_bad"))


def _units(quantity):
    factors = UNITS[quantity]

    def run(spark, d):
        t = spark.read.parquet(f"{d}/lineitem.parquet")
        v = values.Value(F.col("l_quantity"), "num", F.lit(False))
        return t.select("l_orderkey", "l_linenumber", *[values.apply(v, {"op": "unit", "quantity": quantity, "from": u}).col.alias(u) for u in factors])

    def one(f, o):
        x = "l_quantity" if f == 1.0 else f"l_quantity * CAST({f!r} AS DOUBLE)"
        return x if o == 0.0 else f"{x} + CAST({o!r} AS DOUBLE)"

    cast = (lambda x: f"CAST(round_even({x}, 0) AS BIGINT)") if quantity == "time" else (lambda x: x)
    query(f"unit_{quantity}", f"SELECT l_orderkey, l_linenumber, {', '.join(f'{cast(one(f, o))} AS {u}' for u, (f, o) in factors.items())} FROM lineitem")(run)


for _n in UNITS:
    _units(_n)


@query("number_grammar", "SELECT * FROM (VALUES ('1_000', 1000.0, false), ('1.5d', NULL, true), (' 7 ', 7.0, false), ('-2e3', -2000.0, false), ('', NULL, true), ('abc', NULL, true), ('.5', 0.5, false), ('5.', 5.0, false), ('1__0', NULL, true)) t(s, v, bad)")
def _grammar(spark, d):
    t = spark.createDataFrame([("1_000",), ("1.5d",), (" 7 ",), ("-2e3",), ("",), ("abc",), (".5",), ("5.",), ("1__0",)], "s string")
    n = values.number(values.Value(F.col("s"), "raw", F.lit(False)))
    return t.select("s", n.col.alias("v"), n.bad.alias("bad"))


# ---- scalar functions

@query("vin_check_digit", f"WITH {T} SELECT seq, vin, seq % 4 <> 1 AS valid, seq % 4 <> 1 AS digit_right FROM truth")
def _vin(spark, d):
    t = _truth(spark, d)
    v = F.when(F.col("seq") % 4 == 1, F.concat(F.substring("vin", 1, 8), F.when(F.substring("vin", 9, 1) == "X", "5").otherwise("X"), F.substring("vin", 10, 8))).otherwise(F.col("vin"))
    return t.select("seq", "vin", vehicle.is_valid_vin(v).alias("valid"), (vehicle.check_digit(v) == F.substring(v, 9, 1)).alias("digit_right"))


@query("dtc_extract", f"WITH {T} SELECT seq, array_to_string(dtc, ',') AS codes FROM truth")
def _dtc(spark, d):
    t = _truth(spark, d)
    said = F.concat(F.lit("x "), F.lower(F.array_join("dtc", " ; ")), F.lit(" xP0420 / "), F.lower(F.array_join("dtc", "/")))
    return t.select("seq", F.array_join(vehicle.extract_dtcs(said), ",").alias("codes"))


@query("dtc_describe", f"WITH {T} SELECT DISTINCT code, CASE substr(code, 1, 1) WHEN 'P' THEN 'powertrain' WHEN 'C' THEN 'chassis' WHEN 'B' THEN 'body' ELSE 'network' END AS system, CASE WHEN substr(code, 2, 1) IN ('0', '2') THEN 'generic' ELSE 'manufacturer' END AS scope FROM (SELECT unnest(dtc) AS code FROM truth)")
def _describe(spark, d):
    return _truth(spark, d).select(F.explode("dtc").alias("c")).distinct().select(vehicle.describe_dtc(F.col("c")).alias("x")).select("x.*")


@query("geohash_encode", f"WITH {T} SELECT seq, {S.geohash('lat', 'lon', 5)} AS g5, {S.geohash('lat', 'lon', 7)} AS g7 FROM truth")
def _geohash(spark, d):
    return _truth(spark, d).select("seq", geo.geohash_encode(F.col("lat"), F.col("lon"), 5).alias("g5"), geo.geohash_encode(F.col("lat"), F.col("lon"), 7).alias("g7"))


_CELL = lambda v, lo, w, bits: f"(floor(({v} - ({lo})) / {w} * {float(1 << bits)}) + 0.5) * {w / (1 << bits)!r} + ({lo})"


@query("geohash_mask", f"WITH {T} SELECT seq, round({_CELL('lat', -90.0, 180.0, 12)}, 6) AS lat, round({_CELL('lon', -180.0, 360.0, 13)}, 6) AS lon FROM truth")
def _mask(spark, d):
    m = geo.geohash_mask(F.col("lat"), F.col("lon"), 5)
    return _truth(spark, d).select("seq", F.round(m["lat"], 6).alias("lat"), F.round(m["lon"], 6).alias("lon"))


@query("geohash_decode", f"WITH {T} SELECT seq, round({_CELL('lat', -90.0, 180.0, 17)}, 6) AS lat, round({_CELL('lon', -180.0, 360.0, 18)}, 6) AS lon FROM truth")
def _gdecode(spark, d):
    m = geo.geohash_decode(geo.geohash_encode(F.col("lat"), F.col("lon"), 7), 7)
    return _truth(spark, d).select("seq", F.round(m["lat"], 6).alias("lat"), F.round(m["lon"], 6).alias("lon"))


_NEAR = ", ".join(S.geohash(f"clat + {i} * {180.0 / 4096!r}", f"(clon + {j} * {360.0 / 8192!r} + 540.0) % 360.0 - 180.0", 5) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


@query("geohash_neighbors", f"WITH {T}, c AS (SELECT seq, {_CELL('lat', -90.0, 180.0, 12)} AS clat, {_CELL('lon', -180.0, 360.0, 13)} AS clon FROM truth) SELECT seq, array_to_string(list_sort([{_NEAR}]), ',') AS around FROM c")
def _neighbors(spark, d):
    return _truth(spark, d).select("seq", F.array_join(geo.geohash_neighbors(geo.geohash_encode(F.col("lat"), F.col("lon"), 5), 5), ",").alias("around"))


_LAG = "lag(lat) OVER (PARTITION BY vin ORDER BY ts, seq)", "lag(lon) OVER (PARTITION BY vin ORDER BY ts, seq)"


@query("haversine_step", f"WITH {T}, s AS (SELECT seq, lat, lon, {_LAG[0]} AS a, {_LAG[1]} AS b FROM truth) SELECT seq, round(coalesce({S.haversine('a', 'b', 'lat', 'lon')}, 0.0), 5) AS km FROM s")
def _haversine(spark, d):
    return trips.with_steps(_truth(spark, d)).select("seq", F.round("step_km", 5).alias("km"))


@query("bearing", f"WITH {T} SELECT seq, round((degrees(atan2(sin(radians(10.0 - lon)) * cos(radians(20.0)), cos(radians(lat)) * sin(radians(20.0)) - sin(radians(lat)) * cos(radians(20.0)) * cos(radians(10.0 - lon)))) + 360.0) % 360.0, 5) AS deg FROM truth")
def _bearing(spark, d):
    return _truth(spark, d).select("seq", F.round(geo.bearing(F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(10.0)), 5).alias("deg"))


@query("point_in_polygon", f"WITH {T} SELECT seq, lat > -30 AND lat < 40 AND lon > -100 AND lon < 100 AS inside FROM truth WHERE lat NOT IN (-30, 40) AND lon NOT IN (-100, 100)")
def _polygon(spark, d):
    box = [(-30.0, -100.0), (40.0, -100.0), (40.0, 100.0), (-30.0, 100.0)]
    return _truth(spark, d).where(~F.col("lat").isin(-30.0, 40.0) & ~F.col("lon").isin(-100.0, 100.0)).select("seq", geo.in_polygon(F.col("lat"), F.col("lon"), box).alias("inside"))


@query("masks_and_names", "SELECT c_custkey, repeat('•', 11) || right(c_name, 6) AS masked, 'CN' AS initials, 'customer name' AS tokens FROM customer")
def _masks(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", text.mask_vin(F.col("c_name")).alias("masked"), text.initials(F.lit("carl.nor@x.org")).alias("initials"), F.array_join(text.name_tokens(F.lit("customerName[2]")), " ").alias("tokens"))


@query("cursor_round_trip", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s FROM orders")
def _cursor(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    back = text.decode_cursor(text.encode_cursor(F.col("o_orderkey"), F.col("o_orderstatus")))
    return o.select("o_orderkey", back[0].alias("k"), back[1].alias("s"))


@query("device_bucket")
def _bucket(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(text.device_bucket(F.col("user_id").cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


@query("partition_paths", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hour FROM events")
def _paths(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    at = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd").alias("dt"), F.date_format(at, "HH").alias("hour"))


# ---- validation, normalisation, routing

@query("validate_reasons", f"WITH {T} SELECT seq, CASE WHEN seq % 17 = 0 THEN 'MISSING_REQUIRED' WHEN seq % 19 = 0 THEN 'INVALID_VIN' WHEN speed_kmh > 320 THEN 'OUT_OF_RANGE' WHEN seq % 23 = 0 THEN 'INVALID_DTC' WHEN seq % 29 = 0 THEN 'UNKNOWN_EVENT_TYPE' END AS reason, CASE WHEN seq % 17 = 0 THEN 'odo_km' WHEN seq % 19 = 0 THEN 'vin' WHEN speed_kmh > 320 THEN 'speed_kmh' WHEN seq % 23 = 0 THEN 'dtc' WHEN seq % 29 = 0 THEN 'evt' END AS field FROM truth")
def _validate(spark, d):
    t, i = _truth(spark, d), F.col("seq")
    ev = {n: F.col(n) for n in _COLS}
    ev |= {"odo_km": F.when(i % 17 != 0, F.col("odo_km")), "vin": F.when(i % 19 == 0, "TOO_SHORT").otherwise(F.col("vin")), "dtc": F.when(i % 23 == 0, F.array(F.lit("X9"))).otherwise(F.col("dtc")), "evt": F.when(i % 29 == 0, "DANCE").otherwise(F.col("evt"))}
    bad = validate(ev)
    return t.select("seq", bad["reason"].alias("reason"), bad["field"].alias("field"))


_OUT = "CASE WHEN seq % 101 = 0 THEN CASE WHEN oem = 'pairs' THEN 'SCHEMA_MISMATCH' ELSE 'DECODE_ERROR' END WHEN seq % 211 = 0 OR speed_kmh > 320 THEN 'INVALID' END"


@query("dead_letter_counts", f"WITH {T} SELECT oem, {_OUT} AS reason, CAST(sum(CASE WHEN seq % 50 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM truth WHERE {_OUT} IS NOT NULL GROUP BY ALL")
def _dead(spark, d):
    return _events(spark, d).dead.groupBy("oem", "reason").agg(F.count("*").alias("n"))


@query("accounting", f"WITH {T}, x AS (SELECT {_OUT} AS bad, CASE WHEN seq % 50 = 0 THEN 2 ELSE 1 END AS c FROM truth) SELECT CAST(sum(c) AS BIGINT) AS sent, CAST(count(*) FILTER (bad IS NULL) AS BIGINT) AS ok, CAST(coalesce(sum(c) FILTER (bad IS NOT NULL), 0) AS BIGINT) AS failed, CAST(sum(c - 1) FILTER (bad IS NULL) AS BIGINT) AS duplicates FROM x")
def _accounting(spark, d):
    raw = fixtures.raw_records(spark, d)
    n = normalize.normalize(raw, fixtures.live_table(), NOW)
    kinds = n.events.select(F.lit("ok").alias("k")).union(n.dead.select(F.lit("failed"))).union(n.duplicates.select(F.lit("duplicates")))
    counts = kinds.agg(*[F.count(F.when(F.col("k") == k, 1)).alias(k) for k in ("ok", "failed", "duplicates")])
    return raw.agg(F.count("*").alias("sent")).crossJoin(counts)


@query("grouping_sets_stats", f"""WITH {T}, x AS (SELECT oem, {_OUT} AS reason, CASE WHEN seq % 50 = 0 THEN 2 ELSE 1 END AS c,
  CASE WHEN {_OUT} IS NULL THEN NULL WHEN seq % 101 = 0 THEN CASE oem WHEN 'pairs' THEN 'ts' WHEN 'signals' THEN 'signals' ELSE '' END WHEN seq % 211 = 0 THEN 'vin' ELSE 'speed_kmh' END AS field FROM truth)
SELECT oem, version, reason, field, CAST(sum(c) AS BIGINT) AS n FROM (
  SELECT oem, CASE WHEN reason IS NULL THEN 1 END AS version, NULL AS reason, NULL AS field, CASE WHEN reason IS NULL THEN 1 ELSE c END AS c, 1 AS l FROM x
  UNION ALL SELECT oem, NULL, reason, NULL, CASE WHEN reason IS NULL THEN 1 ELSE c END, 2 FROM x
  UNION ALL SELECT oem, NULL, reason, field, CASE WHEN reason IS NULL THEN 1 ELSE c END, 3 FROM x) GROUP BY l, oem, version, reason, field""")
def _stats(spark, d):
    return normalize.outcome_stats(_events(spark, d)).drop("level")


@query("normalize_quality", f"""WITH {T}, a AS (SELECT * FROM good WHERE oem IN ('flat', 'pipe')) SELECT oem, count(*) AS rows, count(DISTINCT vin) AS vehicles, round(avg(CAST(CAST(speed_kmh AS FLOAT) AS DOUBLE)), 2) AS speed_kmh_mean, round(max(CAST(CAST(speed_kmh AS FLOAT) AS DOUBLE)), 1) AS speed_kmh_max,
round(avg(rx - ts), 1) AS arrival_delay_ms_mean, 1 AS latest_mapping_version, CAST(0 AS BIGINT) AS replayed, round(count(soc_pct) / count(*), 4) AS has_soc_pct, round(count(evt) / count(*), 4) AS has_evt, round(count(*) / greatest(1, count(DISTINCT vin)), 1) AS events_per_vehicle FROM a GROUP BY oem""")
def _quality(spark, d):
    n = _events(spark, d, ("flat", "pipe"))
    q = reports.quality(archive.archive_rows(n.events))
    return q.select("oem", "rows", "vehicles", "speed_kmh_mean", "speed_kmh_max", "arrival_delay_ms_mean", "latest_mapping_version", "replayed", "has_soc_pct", "has_evt", "events_per_vehicle").orderBy(F.desc("rows"), "oem")


def _versions(pct):
    drift = {**fixtures.SPECS["pipe"], "fields": {**fixtures.SPECS["pipe"]["fields"]}}
    old = {**drift, "decoder": {**drift["decoder"], "delimiter": ";"}}
    return routing_table([{"oem": "pipe", "version": 1, "state": "active", "spec": old}, {"oem": "pipe", "version": 2, "state": "canary", "canary_pct": pct, "spec": drift}])[0]


@query("fallback_versions", f"WITH {T} SELECT seq, CASE WHEN seq % 4 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN seq % 4 = 0 THEN 0 ELSE 1 END AS attempt FROM truth WHERE oem = 'pipe' AND speed_kmh <= 320")
def _fallback(spark, d):
    raw = fixtures.raw_records(spark, d, ("pipe",), False)
    text_ = F.col("value").cast("string")
    old = F.split(text_, "\\|")[fixtures.PIPE_COLUMNS.index("no")].cast("bigint") % 4 == 0
    raw = raw.withColumn("value", F.encode(F.when(old, F.replace(text_, F.lit("|"), F.lit(";"))).otherwise(text_), "UTF-8"))
    out = normalize.outcomes(raw, _versions(0)).where("error is null")
    return out.select("event.seq", "version", "attempt")


@query("route_canary")
def _canary(spark, d):
    out = normalize.outcomes(fixtures.raw_records(spark, d, ("pipe",), False), _versions(30))
    return out.groupBy("version", "attempt").agg(F.count("*").alias("n"))


@query("canary_share", "SELECT CAST(user_id % 100 AS INT) < 30 AS first, count(*) AS n FROM events GROUP BY 1")
def _share(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy((F.pmod("user_id", F.lit(100)).cast("int") < 30).alias("first")).agg(F.count("*").alias("n"))


@query("shadow_run", f"WITH {T}, p AS (SELECT 'flat' AS oem, CASE WHEN seq % 101 = 0 THEN 'DECODE_ERROR' WHEN seq % 211 = 0 THEN 'INVALID' WHEN speed_kmh > 320 THEN 'INVALID' ELSE 'ok' END AS reason, CASE WHEN seq % 101 = 0 THEN '' WHEN seq % 211 = 0 THEN 'vin' WHEN speed_kmh > 320 THEN 'speed_kmh' ELSE '' END AS field, CASE WHEN seq % 50 = 0 THEN 2 ELSE 1 END AS c FROM truth WHERE oem = 'flat') SELECT oem, reason, field, CAST(sum(c) AS BIGINT) AS n, reason = 'DECODE_ERROR' AS damaged FROM p GROUP BY ALL")
def _shadow(spark, d):
    dead = normalize.dead_letters(normalize.outcomes(fixtures.raw_records(spark, d, ("flat",)), {}), NOW)
    return dlq.shadow(dead, fixtures.live_table(("flat",)))


@query("golden_report", f"WITH {T} SELECT f AS field, 1.0::DOUBLE AS accuracy FROM (SELECT unnest(['lat', 'lon', 'seq', 'speed_kmh', 'ts', 'vin']) AS f)")
def _golden(spark, d):
    out = normalize.outcomes(fixtures.raw_records(spark, d, ("nested",), False), fixtures.live_table(("nested",))).where("error is null").select("event.*")
    want = _truth(spark, d).where("oem = 'nested' and speed_kmh <= 320")
    fields = ["vin", "ts", "lat", "lon", "speed_kmh"]
    checked = governance.golden(out.withColumn("case", F.col("seq")), want.withColumn("case", F.col("seq")), fields + ["seq"], "case")
    return governance.golden_report(checked)[1]


# ---- de-duplication, state, alerts

@query("dedup_seq", f"WITH {T} SELECT oem, count(*) AS n FROM good GROUP BY oem")
def _dedup(spark, d):
    return _events(spark, d).events.groupBy("oem").agg(F.count("*").alias("n"))


_ARR = f"{T}, a AS (SELECT *, rx * 4 + 1 AS off FROM good), r AS (SELECT vin, seq, off FROM a UNION ALL SELECT vin, seq, off + 1 FROM a WHERE seq % 50 = 0)"


@query("replay_window", f"WITH {_ARR}, w AS (SELECT vin, seq, off, max(seq) OVER (PARTITION BY vin ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER (PARTITION BY vin, seq ORDER BY off) AS k FROM r) SELECT vin, seq, off, CASE WHEN top IS NULL OR seq > top THEN 0 WHEN top - seq >= 64 THEN 2 WHEN k > 1 THEN 1 ELSE 0 END AS outcome FROM w")
def _window(spark, d):
    e = _good(spark, d).select("vin", "seq", "part", "off")
    twice = e.union(e.where("seq % 50 = 0").withColumn("off", F.col("off") + 1))
    return dedup.replay_outcomes(twice).select("vin", "seq", "off", "outcome")


@query("latest_state", f"WITH {_ARR} SELECT vin, max_by(seq, CAST(ts AS HUGEINT) * 100000000000000000 + off) AS seq, max(ts) AS ts, count(*) AS events FROM a GROUP BY vin")
def _latest(spark, d):
    return state.latest_state(_good(spark, d)).select("vin", "seq", "ts", "events")


@query("late_flag", f"WITH {T} SELECT seq, ts < (SELECT max(ts) FROM good) - 30000 AS late FROM good")
def _late(spark, d):
    return state.late_flags(_good(spark, d)).select("seq", "late")


_CODES = f"{_ARR}, s AS (SELECT *, lag(dtc) OVER (PARTITION BY vin ORDER BY off) AS before FROM a WHERE len(dtc) > 0), n AS (SELECT vin, ts, seq, list_sort(list_filter(dtc, lambda c: NOT list_contains(before, c))) AS codes FROM s WHERE before IS NOT NULL)"


@query("dtc_new_codes", f"WITH {_CODES} SELECT vin, seq, array_to_string(codes, ',') AS codes FROM n WHERE len(codes) > 0")
def _codes(spark, d):
    return state.new_codes(_good(spark, d)).select("vin", "seq", F.array_join("codes", ",").alias("codes"))


@query("alerts", f"WITH {_CODES}, e AS (SELECT vin, evt AS kind, CASE WHEN evt <> 'LOW_SOC' OR coalesce(soc_pct, 0) >= 8 THEN 'warning' ELSE 'critical' END AS severity, ts FROM a WHERE evt IN ('HARSH_BRAKE', 'HARSH_ACCEL', 'SPEEDING', 'LOW_SOC') UNION ALL SELECT vin, 'DTC', 'warning', ts FROM n WHERE len(codes) > 0) SELECT kind, severity, count(*) AS n FROM (SELECT DISTINCT * FROM e) GROUP BY ALL")
def _alerts(spark, d):
    return state.alerts(_good(spark, d)).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query("vehicle_lookup", f"WITH {T} SELECT seq, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS vehicle_index FROM good")
def _lookup(spark, d):
    g = _good(spark, d)
    known = g.where("user_id % 3 <> 0").select("vin", F.col("user_id").alias("vehicle_id")).distinct()
    return state.known_vehicle(g, known).select("seq", "vehicle_index")


# ---- reports

@query("event_counts", f"WITH {T} SELECT oem, evt, count(*) AS n FROM good WHERE evt IS NOT NULL GROUP BY ALL")
def _counts(spark, d):
    return reports.event_counts(archive.archive_rows(_good(spark, d)))


@query("hotspots", f"WITH {T} SELECT {S.geohash('lat', 'lon', 5)} AS geohash5, count(*) AS events FROM good WHERE evt IN ('HARSH_BRAKE', 'HARSH_ACCEL', 'SPEEDING') GROUP BY 1 ORDER BY events DESC, geohash5 LIMIT 20")
def _hotspots(spark, d):
    return reports.hotspots(archive.archive_rows(_good(spark, d))).select("geohash5", "events")


@query("density_cells", f"WITH {T} SELECT {S.geohash('lat', 'lon', 3)} AS cell, count(*) AS vehicles, count(*) FILTER (speed_kmh > 3) AS moving FROM good GROUP BY 1 ORDER BY vehicles DESC, cell LIMIT 3000")
def _density(spark, d):
    return reports.density(_good(spark, d))


@query("minute_rollup", f"WITH {T} SELECT oem, ts - ts % 60000 AS minute_ms, count(*) AS events, round(avg(speed_kmh), 6) AS avg_speed FROM good GROUP BY ALL")
def _minutes(spark, d):
    return reports.minute_rollup(_good(spark, d)).withColumn("avg_speed", F.round("avg_speed", 6))


@query("additive_minutes", f"WITH {T} SELECT oem, ts - ts % 60000 AS minute_ms, 2 * count(*) AS ok, CAST(count(*) FILTER (seq % 5 = 0) AS BIGINT) AS failed, CAST(0 AS BIGINT) AS duplicates, 2 * count(*) + count(*) FILTER (seq % 5 = 0) AS received FROM good GROUP BY ALL")
def _additive(spark, d):
    minute = F.col("ts") - F.col("ts") % 60000
    g = _good(spark, d).groupBy("oem", minute.alias("minute_ms")).agg(F.count("*").alias("ok"), F.count(F.when(F.col("seq") % 5 == 0, 1)).alias("failed"), F.lit(0).cast("bigint").alias("duplicates"))
    return reports.additive_minutes(g, g.withColumn("failed", F.lit(0).cast("bigint")))


@query("sliding_rate", f"WITH {T}, p AS (SELECT oem, ts // 1000 AS second, count(*) AS n FROM good GROUP BY ALL) SELECT oem, second, n, CAST(sum(n) OVER (PARTITION BY oem ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM p")
def _sliding(spark, d):
    return reports.sliding_total(_good(spark, d), 3600).drop("rate")


@query("series_zero_fill", f"WITH {T}, p AS (SELECT oem, ts - ts % 3600000 AS hour_ms, count(*) AS n FROM good GROUP BY ALL), s AS (SELECT oem, unnest(generate_series(min(hour_ms), max(hour_ms), 3600000)) AS hour_ms FROM p GROUP BY oem) SELECT s.oem, s.hour_ms, coalesce(p.n, 0) AS n FROM s LEFT JOIN p ON s.oem = p.oem AND s.hour_ms = p.hour_ms")
def _series(spark, d):
    p = _good(spark, d).groupBy("oem", (F.col("ts") - F.col("ts") % 3600000).alias("hour_ms")).agg(F.count("*").alias("n"))
    return reports.zero_filled(p, "hour_ms", 3600000, "n")


@query("latency_histogram", f"WITH {T}, b AS (SELECT oem, CASE WHEN value <= 0.01 THEN 0 ELSE least({reports.N_BUCKETS - 1}, CAST(floor(ln(value / 0.01) / ln(1.08)) AS INT) + 1) END AS bucket FROM (SELECT oem, speed_kmh AS value FROM good WHERE seq % 13 <> 0)) SELECT oem, bucket, count(*) AS n FROM b GROUP BY ALL")
def _hist(spark, d):
    return reports.histogram(_good(spark, d).where("not replayed"), ["oem"], "speed_kmh").select("oem", "bucket", "n")


@query("latency_percentile", f"WITH {T}, b AS (SELECT oem, speed_kmh AS v, CASE WHEN speed_kmh <= 0.01 THEN 0 ELSE least({reports.N_BUCKETS - 1}, CAST(floor(ln(speed_kmh / 0.01) / ln(1.08)) AS INT) + 1) END AS bucket FROM good), h AS (SELECT oem, bucket, count(*) AS n, max(v) AS m FROM b GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY oem ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY oem) AS total, max(m) OVER (PARTITION BY oem) AS top FROM h) SELECT oem, round(least(pow(1.08, min(bucket)) * 0.01, max(top)), 6) AS p95 FROM c WHERE cum >= greatest(1, ceil(total * 0.95)) GROUP BY oem")
def _percentile(spark, d):
    h = reports.histogram(_good(spark, d), ["oem"], "speed_kmh")
    return reports.histogram_percentile(h, ["oem"], 95).withColumn("p95", F.round("p95", 6))


@query("top_k", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def _top(spark, d):
    return reports.top_k(spark.read.parquet(f"{d}/events.parquet"), "user_id")


@query("approx_top_k")
def _approx(spark, d):
    return reports.approximate_top_k(spark.read.parquet(f"{d}/events.parquet"), "event_type", 3)


@query("count_min_sketch")
def _cms(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").agg(F.length(F.count_min_sketch("user_id", F.lit(0.01), F.lit(0.95), F.lit(7))).alias("bytes"))


_KINDS = f"{T}, o AS (SELECT oem, ts, CASE WHEN seq % 9 = 0 THEN 'failed' WHEN seq % 11 = 0 THEN 'duplicate' ELSE 'ok' END AS kind FROM good)"


def _kinds(spark, d):
    i = F.col("seq")
    return _good(spark, d).select("oem", "ts", F.when(i % 9 == 0, "failed").when(i % 11 == 0, "duplicate").otherwise("ok").alias("kind"), (i % 4 == 0).alias("canary"), F.lit(2).alias("version"))


@query("overview", f"WITH {_KINDS} SELECT oem, count(*) FILTER (kind = 'ok') AS ok_total, count(*) FILTER (kind = 'failed') AS failed_total, count(*) FILTER (kind = 'duplicate') AS duplicate_total, count(*) FILTER (kind = 'ok' AND ts > 1705000000000 - 600000000) AS ok_last, count(*) FILTER (kind = 'failed' AND ts > 1705000000000 - 600000000) AS failed_last, count(*) FILTER (kind = 'duplicate' AND ts > 1705000000000 - 600000000) AS duplicate_last, round(count(*) FILTER (kind = 'ok') / count(*) FILTER (kind IN ('ok', 'failed')), 6) AS success, round(count(*) FILTER (kind = 'ok' AND ts > 1705000000000 - 600000000) / 600000.0::DOUBLE, 6) AS ok_per_s FROM o GROUP BY oem")
def _overview(spark, d):
    return reports.overview(_kinds(spark, d), 1705000000000, 600000)


@query("canary_guard", f"WITH {T}, o AS (SELECT oem, CASE WHEN seq % 9 = 0 THEN 'failed' WHEN seq % 11 = 0 THEN 'duplicate' ELSE 'ok' END AS kind FROM good WHERE seq % 4 = 0) SELECT oem, 2 AS version, count(*) FILTER (kind = 'ok') AS ok, count(*) FILTER (kind = 'failed') AS failed, round(count(*) FILTER (kind = 'failed') / greatest(1, count(*) FILTER (kind IN ('ok', 'failed'))), 6) AS rate, count(*) FILTER (kind = 'failed') >= 10 AND count(*) FILTER (kind = 'failed') / greatest(1, count(*) FILTER (kind IN ('ok', 'failed'))) > 0.05 AS roll_back FROM o GROUP BY oem")
def _guard(spark, d):
    return reports.canary_health(_kinds(spark, d), 0, least=10)


@query("alert_ratio", f"WITH {_KINDS}, w AS (SELECT oem, kind, unnest(generate_series(ts - ts % 60000 - 240000, ts - ts % 60000, 60000)) AS start_ms FROM o) SELECT oem, start_ms, count(*) FILTER (kind = 'failed') AS failed, count(*) AS n, round(count(*) FILTER (kind = 'failed') / count(*), 6) AS share FROM w GROUP BY ALL")
def _ratio(spark, d):
    return reports.alert_ratio(_kinds(spark, d))


@query("merge_snapshots", f"WITH {_KINDS} SELECT ts // 1000 AS second, oem, kind AS key, count(*) AS n FROM o GROUP BY ALL")
def _snapshots(spark, d):
    s = _kinds(spark, d).groupBy("ts").agg(F.collect_list(F.struct("oem", F.col("kind").alias("key"), F.lit(1).alias("n"))).alias("stats"))
    return reports.merge_snapshots(s)


@query("prometheus_text", f"WITH {_KINDS} SELECT 'outcomes{{oem=\"' || oem || '\",kind=\"' || kind || '\"}} ' || CAST(count(*) AS VARCHAR) AS line FROM o GROUP BY oem, kind")
def _prom(spark, d):
    return reports.prometheus(_kinds(spark, d).groupBy("oem", "kind").agg(F.count("*").alias("n")), "outcomes", ["oem", "kind"], "n")


# ---- trips

@query("threshold_segments", f"WITH {T}, s AS (SELECT *, CAST(speed_kmh > 3 AS INT) AS state FROM truth), c AS (SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY vin ORDER BY ts, seq) THEN 1 ELSE 0 END AS chg FROM s), r AS (SELECT *, sum(chg) OVER (PARTITION BY vin ORDER BY ts, seq) AS run FROM c) SELECT vin, CAST(run AS BIGINT) AS run, state, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points, max(speed_kmh) AS max_speed_kmh FROM r GROUP BY ALL")
def _islands(spark, d):
    return trips.islands(_truth(spark, d))


@query("trips_viterbi")
def _trips(spark, d):
    return trips.trips(_truth(spark, d).select("vin", "ts", "lat", "lon", "speed_kmh"))


@query("dlq_groups")
def _groups(spark, d):
    return dlq.groups(_events(spark, d).dead).select("oem", "reason", "field", "shape", "n")


@query("dlq_group_counts", f"WITH {T}, x AS (SELECT oem, {_OUT} AS reason, CASE WHEN seq % 50 = 0 THEN 2 ELSE 1 END AS c, CASE WHEN seq % 101 = 0 THEN CASE oem WHEN 'pairs' THEN 'ts' WHEN 'signals' THEN 'signals' ELSE '' END WHEN seq % 211 = 0 THEN 'vin' ELSE 'speed_kmh' END AS field FROM truth) SELECT oem, reason, field, CAST(sum(c) AS BIGINT) AS n FROM x WHERE reason IS NOT NULL GROUP BY ALL")
def _group_counts(spark, d):
    return dlq.groups(_events(spark, d).dead).groupBy("oem", "reason", "field").agg(F.sum("n").alias("n"))


@query("dlq_samples")
def _samples(spark, d):
    return dlq.samples(_events(spark, d).dead, 5).select("oem", "reason", "field", "shape", "n", F.base64("value").alias("value"))


@query("dlq_tracks", f"WITH {T}, x AS (SELECT oem, user_id, rx * 4 + k AS off FROM (SELECT *, unnest(CASE WHEN seq % 50 = 0 THEN [1, 2] ELSE [1] END) AS k FROM truth) WHERE {_OUT} IS NOT NULL), f AS (SELECT oem, user_id, row_number() OVER (PARTITION BY oem ORDER BY min(off), CAST(user_id AS VARCHAR)) AS device_rank FROM x GROUP BY oem, user_id) SELECT oem, CAST(user_id AS VARCHAR) AS dev, CAST(device_rank AS INT) AS device_rank, least(count(*), 3) AS n FROM x JOIN f USING (oem, user_id) WHERE device_rank <= 4 GROUP BY ALL")
def _tracks(spark, d):
    return dlq.tracks(_events(spark, d).dead, 4, 3).groupBy("oem", "dev", "device_rank").agg(F.count("*").alias("n"))


@query("shape_families")
def _families(spark, d):
    dead = normalize.dead_letters(normalize.outcomes(fixtures.raw_records(spark, d), {}), NOW)
    return dlq.family_report(dlq.groups(dead))


@query("replay_messages", f"WITH {T} SELECT oem, CAST(sum(CASE WHEN seq % 50 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n, 1 AS replay, 1 AS attempts FROM truth WHERE oem = 'flat' AND {_OUT} IS NOT NULL GROUP BY oem")
def _replay(spark, d):
    dead = _events(spark, d).dead
    return dlq.replay(dead, "flat", 1 << 62).groupBy("oem", "replay", "attempts").agg(F.count("*").alias("n"))
