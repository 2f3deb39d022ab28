"""Fixed schemas of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# fixed values
EVENT_TYPES = ("HARSH_BRAKE", "HARSH_ACCEL", "SPEEDING", "IDLE", "IGNITION_ON", "IGNITION_OFF", "LOW_SOC", "CHARGE_START", "CHARGE_STOP")
MAX_PAYLOAD = 64 * 1024


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool
    low: float | None = None
    high: float | None = None
    unit: str = ""
    pii: bool = False


# fixed values
FIELDS = (
    Field("vin", "str", True, pii=True),
    Field("ts", "int", True, 946684800000, 4102444800000, "epoch_ms"),
    Field("seq", "int", True, 0, 1 << 53),
    Field("lat", "float", True, -90.0, 90.0, "deg", True),
    Field("lon", "float", True, -180.0, 180.0, "deg", True),
    Field("speed_kmh", "float", True, 0.0, 320.0, "kmh"),
    Field("odo_km", "float", True, 0.0, 3_000_000.0, "km"),
    Field("heading_deg", "float", False, 0.0, 360.0, "deg"),
    Field("soc_pct", "float", False, 0.0, 100.0, "pct"),
    Field("fuel_pct", "float", False, 0.0, 100.0, "pct"),
    Field("ambient_c", "float", False, -70.0, 80.0, "c"),
    Field("ignition", "bool", False),
    Field("dtc", "list[str]", False),
    Field("evt", "enum", False),
)
BY_NAME = {f.name: f for f in FIELDS}
REQUIRED = tuple(f.name for f in FIELDS if f.required)
OPTIONAL = tuple(f.name for f in FIELDS if not f.required)

_TYPE = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "list[str]": T.ArrayType(T.StringType()), "enum": T.StringType()}
_JSON = {"str": {"type": "string"}, "int": {"type": "integer"}, "float": {"type": "number"}, "bool": {"type": "boolean"}, "list[str]": {"type": "array", "items": {"type": "string"}}, "enum": {"type": "string", "enum": list(EVENT_TYPES)}}

CANONICAL = T.StructType([T.StructField(f.name, _TYPE[f.kind]) for f in FIELDS])

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType())}


def struct(columns: str) -> T.StructType:
    """``name type, ...`` without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


RAW = struct("key binary, value binary, oem string, rx bigint, ct string, tp string, replay int, attempts int, ts bigint, part int, off bigint")

DEAD = struct("key binary, value binary, oem string, rx bigint, reason string, field string, detail string, tried_v int, dead_ts bigint, dev string, attempts int")

#: five fields are narrowed to float here
ARCHIVE = struct("vin string, ts bigint, seq bigint, oem string, map_v int, lat double, lon double, speed_kmh float, heading_deg float, odo_km double, soc_pct float, fuel_pct float, ambient_c float, ignition boolean, dtc array<string>, evt string, rx_ts bigint, norm_ts bigint, replayed boolean, geohash5 string")


def json_schema() -> dict:
    """JSON Schema of the canonical event; readers ignore unknown keys."""
    props = {}
    for f in FIELDS:
        p = dict(_JSON[f.kind])
        if f.low is not None:
            p |= {"minimum": f.low, "maximum": f.high}
        props[f.name] = p
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "canonical event", "type": "object", "required": list(REQUIRED), "properties": props, "additionalProperties": True}
