"""Deterministic telemetry from the ``events`` table, encoded in several dialects, with injected faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.vehicle import make_vin
from telemill.plans.route import routing_table
from telemill.plans.schema import EVENT_TYPES

DIALECTS = ("nested", "flat", "pipe", "signals", "pairs")
PIPE_COLUMNS = ["frame", "no", "at", "car", "run", "kmh", "metres", "turn", "north6", "east6", "cell10", "tank10", "air10", "kind", "faults"]
TYPE_EVENT = {"signup": "IGNITION_ON", "error": "HARSH_BRAKE", "click": "HARSH_ACCEL", "view": "SPEEDING", "purchase": "LOW_SOC"}


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical facts, one row an event: vehicle = user, sequence = event id, speed = value, the rest integer arithmetic."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    i, u = F.col("event_id"), F.col("user_id")
    mod = lambda x, m: F.pmod(x, F.lit(m))
    code = F.when(mod(i, 10) < 7, F.array().cast("array<string>")).when(mod(i, 10) == 7, F.array(F.lit("P0420"))).when(mod(i, 10) == 8, F.array(F.lit("P0300"), F.lit("C1234"))).otherwise(F.array(F.lit("B1000")))
    return e.select(
        u.alias("user_id"),
        F.element_at(F.array(*[F.lit(d) for d in DIALECTS]), (mod(u, 5) + 1).cast("int")).alias("oem"),
        make_vin("7TM", u).alias("vin"),
        F.unix_millis("at").alias("ts"),
        i.alias("seq"),
        ((mod(u * 7919 + i * 104729, 120000) - 60000) / 1000.0).alias("lat"),
        ((mod(u * 104729 + i * 7919, 300000) - 150000) / 1000.0).alias("lon"),
        F.col("value").alias("speed_kmh"),
        (i * 0.5).alias("odo_km"),
        mod(i * 37, 360).cast("double").alias("heading_deg"),
        F.when(mod(u, 2) == 0, mod(i, 101).cast("double")).alias("soc_pct"),
        F.when(mod(u, 2) == 1, mod(i * 3, 101).cast("double")).alias("fuel_pct"),
        (mod(i, 60) - 20).cast("double").alias("ambient_c"),
        (mod(i, 2) == 0).alias("ignition"),
        code.alias("dtc"),
        F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_EVENT.items() for x in kv]), F.col("event_type")).alias("evt"),
        F.col("at"),
        F.col("k"),
    )


def encode(dialect: str) -> Column:
    """Payload text of a truth row. The five dialects are made up for this library; each has its own layout, names and units."""
    c = F.col
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    whole = lambda x, factor: F.coalesce(F.rint(x * factor).cast("bigint").cast("string"), F.lit(""))
    if dialect == "nested":
        when = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        place = F.struct(c("lat").alias("north"), c("lon").alias("east"))
        going = F.struct(c("heading_deg").alias("toward"), c("speed_kmh").alias("pace"), c("odo_km").alias("sofar"))
        left = F.struct(c("soc_pct").alias("cell"), c("fuel_pct").alias("tank"))
        state = F.struct(c("ignition").alias("running"), c("ambient_c").alias("air"), c("dtc").alias("faults"))
        return F.to_json(F.struct(F.struct(when.alias("at"), c("seq").alias("no"), c("vin").alias("car")).alias("head"), F.struct(place.alias("place"), going.alias("going"), left.alias("left"), state.alias("state")).alias("body"), c("evt").alias("kind")))
    if dialect == "flat":
        run = F.when(c("ignition"), "ON").otherwise("OFF")
        return F.to_json(F.struct(c("seq").alias("n"), (c("ts") / 1000.0).alias("sec"), c("vin").alias("car"), F.lower(c("evt")).alias("kind"), run.alias("run"), F.array_join("dtc", ",").alias("faults"), c("speed_kmh").alias("pace_kmh"), c("odo_km").alias("sofar_km"), c("heading_deg").alias("toward_deg"), c("lat").alias("north_deg"), c("lon").alias("east_deg"), c("soc_pct").alias("cell_pc"), c("fuel_pct").alias("tank_pc"), c("ambient_c").alias("air_c")))
    if dialect == "pipe":
        kind = F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), c("evt")).cast("string")
        return F.concat_ws("|", F.lit("TM"), text("seq"), text("ts"), c("vin"), c("ignition").cast("int").cast("string"), text("speed_kmh"), whole(c("odo_km"), 1000), whole(c("heading_deg"), 1), whole(c("lat"), 1000000), whole(c("lon"), 1000000), whole(c("soc_pct"), 10), whole(c("fuel_pct"), 10), whole(c("ambient_c"), 10), kind, F.array_join("dtc", " "))
    if dialect == "signals":
        number = lambda name, v: F.concat(F.lit(f'{{"of":"{name}","is":'), v.cast("string"), F.lit("}"))
        word = lambda name, v: F.concat(F.lit(f'{{"of":"{name}","is":"'), v, F.lit('"}'))
        head = F.concat(F.lit('{"from":{"car":"'), c("vin"), F.lit('"},"at":'), text("ts"), F.lit(',"no":'), text("seq"))
        # the pace comes twice, the last one counts; a reading that there is none of is left out
        told = F.concat_ws(",", word("kind", F.lower(c("evt"))), number("pace", F.lit(0)), number("sofar", c("odo_km")), number("toward", c("heading_deg")), number("north", c("lat")), number("east", c("lon")), F.when(c("soc_pct").isNotNull(), number("cell", c("soc_pct"))), word("engine", F.when(c("ignition"), "run").otherwise("stop")), number("pace", c("speed_kmh")))
        return F.concat(head, F.lit(',"signals":['), told, F.lit("]}"))
    if dialect == "pairs":
        pair = lambda name, v: F.concat(F.lit(f"{name}="), v)
        return F.concat_ws(";", pair("car", c("vin")), pair("no", text("seq")), pair("at", text("ts")), pair("kind", c("evt")), pair("run", c("ignition").cast("string")), pair("pace", text("speed_kmh")), pair("sofar", text("odo_km")), pair("north", text("lat")), pair("east", text("lon")), F.when(F.size("dtc") > 0, pair("faults", F.array_join("dtc", "/"))))
    raise ValueError(dialect)


def _field(path: str, *transforms) -> dict:
    return {"path": path, "transforms": list(transforms)} if transforms else {"path": path}


def _unit(quantity: str, unit: str) -> dict:
    return {"op": "unit", "quantity": quantity, "from": unit}


SPECS = {
    "nested": {
        "decoder": {"type": "json"},
        "fields": {
            "vin": _field("head.car"),
            "ts": _field("head.at", "iso8601"),
            "seq": _field("head.no"),
            "lat": _field("body.place.north"),
            "lon": _field("body.place.east"),
            "speed_kmh": _field("body.going.pace"),
            "odo_km": _field("body.going.sofar"),
            "heading_deg": _field("body.going.toward"),
            "soc_pct": _field("body.left.cell"),
            "fuel_pct": _field("body.left.tank"),
            "ambient_c": _field("body.state.air"),
            "ignition": _field("body.state.running", "to_bool"),
            "dtc": _field("body.state.faults", "dtc_extract"),
            "evt": _field("kind"),
        },
    },
    "flat": {
        "decoder": {"type": "json"},
        "fields": {
            "vin": _field("car"),
            "ts": _field("sec", _unit("time", "epoch_s")),
            "seq": _field("n", "to_int"),
            "lat": _field("north_deg"),
            "lon": _field("east_deg"),
            "speed_kmh": _field("pace_kmh"),
            "odo_km": _field("sofar_km"),
            "heading_deg": _field("toward_deg"),
            "soc_pct": _field("cell_pc"),
            "fuel_pct": _field("tank_pc"),
            "ambient_c": _field("air_c"),
            "ignition": _field("run", "to_bool"),
            "dtc": _field("faults", "dtc_extract"),
            "evt": _field("kind", "upper"),
        },
    },
    "pipe": {
        "decoder": {"type": "delimited", "delimiter": "|", "columns": PIPE_COLUMNS},
        "fields": {
            "vin": _field("car"),
            "ts": _field("at", "to_int"),
            "seq": _field("no", "to_int"),
            "lat": _field("north6", _unit("angle", "microdeg")),
            "lon": _field("east6", _unit("angle", "microdeg")),
            "speed_kmh": _field("kmh", "to_float"),
            "odo_km": _field("metres", _unit("distance", "m")),
            "heading_deg": _field("turn"),
            "soc_pct": _field("cell10", _unit("percent", "permille")),
            "fuel_pct": _field("tank10", _unit("percent", "permille")),
            "ambient_c": _field("air10", _unit("temperature", "deci_c")),
            "ignition": _field("run", "to_bool"),
            "dtc": _field("faults", "dtc_extract"),
            "evt": _field("kind", {"op": "enum", "map": {str(k): e for k, e in enumerate(EVENT_TYPES, 1)}}),
        },
    },
    "signals": {
        "decoder": {"type": "json", "pivot": {"path": "signals", "key": "of", "value": "is", "into": "now"}},
        "fields": {
            "vin": _field("from.car"),
            "ts": _field("at"),
            "seq": _field("no"),
            "lat": _field("now.north"),
            "lon": _field("now.east"),
            "speed_kmh": _field("now.pace"),
            "odo_km": _field("now.sofar"),
            "heading_deg": _field("now.toward"),
            "soc_pct": _field("now.cell"),
            "ignition": _field("now.engine", "to_bool"),
            "evt": _field("now.kind", "upper"),
        },
    },
    "pairs": {
        "decoder": {"type": "kv", "pair_sep": ";", "kv_sep": "="},
        "fields": {
            "vin": _field("car", "strip"),
            "ts": _field("at"),
            "seq": _field("no"),
            "lat": _field("north"),
            "lon": _field("east"),
            "speed_kmh": _field("pace"),
            "odo_km": _field("sofar", {"op": "round", "digits": 1}),
            "ignition": _field("run", "to_bool"),
            "dtc": _field("faults", "dtc_extract"),
            "evt": _field("kind"),
        },
    },
}


def raw_records(spark: SparkSession, sf_dir: str, dialects=DIALECTS, faults: bool = True) -> DataFrame:
    """Raw records of the dialects' vehicles in arrival order; with ``faults``: every 50th event twice, every 101st cut short,
    every 211th with a wrong check digit, every 37th late by an hour."""
    facts = truth(spark, sf_dir)
    out = None
    for d in dialects:
        # the source is a literal in its branch, so a filter on it leaves one branch and no other encoding
        own = _raw(facts.where(F.pmod("user_id", F.lit(len(DIALECTS))) == DIALECTS.index(d)), d, faults)
        out = own if out is None else out.union(own)
    return out


def _raw(t: DataFrame, dialect: str, faults: bool) -> DataFrame:
    i = F.col("seq")
    if faults:
        good = F.col("vin")
        t = t.withColumn("vin", F.when(i % 211 == 0, F.concat(F.substring(good, 1, 8), F.when(F.substring(good, 9, 1) == "0", "1").otherwise("0"), F.substring(good, 10, 8))).otherwise(good))
    r = t.select(F.col("user_id").cast("string").alias("dev"), F.col("ts").alias("event_ts"), "seq", encode(dialect).alias("text"))
    if faults:
        r = r.withColumn("text", F.when(i % 101 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")))
    arrival = F.col("event_ts") + (F.when(i % 37 == 0, 3_600_000).otherwise(0) if faults else F.lit(0)) + 250
    copies = F.when(i % 50 == 0, 2).otherwise(1) if faults else F.lit(1)
    r = r.withColumn("rx", arrival.cast("bigint")).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return r.select(F.encode("dev", "UTF-8").alias("key"), F.encode("text", "UTF-8").alias("value"), F.lit(dialect).alias("oem"), (F.col("rx") + (F.col("copy") - 1) * 5).alias("rx"), F.lit(None).cast("string").alias("ct"), F.lit(None).cast("string").alias("tp"), F.lit(None).cast("int").alias("replay"), F.lit(None).cast("int").alias("attempts"), F.col("rx").alias("ts"), F.lit(0).alias("part"), (F.col("rx") * 4 + F.col("copy")).alias("off"))


def live_table(dialects=DIALECTS):
    return routing_table([{"oem": d, "version": 1, "state": "active", "spec": SPECS[d]} for d in dialects])[0]
