"""Small string functions: masks, cursors, previews, field names, payload shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_vin(vin: Column) -> Column:
    """Only the last six characters are shown."""
    return F.concat(F.repeat(F.lit("•"), 11), F.right(vin, F.lit(6)))


def initials(email: Column) -> Column:
    """First letters of the parts of the local name, upper-cased."""
    parts = F.split(F.substring_index(email, "@", 1), "[._-]")
    return F.upper(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))


def encode_cursor(*keys: Column) -> Column:
    return F.base64(F.encode(F.to_json(F.array(*[k.cast("string") for k in keys])), "UTF-8"))


def decode_cursor(cursor: Column) -> Column:
    """Array of key strings; null for anything that is not a cursor."""
    raw = F.when(cursor.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(cursor) % 4 == 0), F.try_to_binary(cursor, F.lit("base64")))
    return F.from_json(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), "array<string>")


def preview(payload: Column, n: int = 200) -> Column:
    """Text of a payload, or its hex if it is not UTF-8."""
    text = payload.cast("string")
    return F.when(F.is_valid_utf8(text), F.substring(text, 1, n)).otherwise(F.concat(F.lit("0x"), F.substring(F.lower(F.hex(payload)), 1, n)))


def name_tokens(path: Column) -> Column:
    """Lower-case tokens of a field path: camel case and snake case are cut, indices dropped."""
    plain = F.regexp_replace(path, "\\[-?[0-9]+\\]", " ")
    camel = F.regexp_replace(F.regexp_replace(plain, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(camel, "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


def device_bucket(key: Column, seed: int = 24301) -> Column:
    """Stable bucket 0..99 of a device."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(100)).cast("int")


def text_shape(payload: Column) -> Column:
    """Shape of a payload that is not JSON: ``text:<delimiter>:<columns>``, ``text:plain`` or ``binary:<size bucket>``."""
    text = payload.cast("string")
    count = lambda d: F.length(text) - F.length(F.replace(text, F.lit(d)))
    told = F.coalesce(*[F.when(count(d) >= 3, F.concat(F.lit(f"text:{d}:"), (count(d) + 1).cast("string"))) for d in ("|", ";", ",", "\t")], F.lit("text:plain"))
    return F.when(F.is_valid_utf8(text), told).otherwise(F.concat(F.lit("binary:"), (F.floor(F.length(payload) / 16) * 16).cast("string")))


def json_shape(paths: Column) -> Column:
    """Shape of a JSON payload from its field paths."""
    return F.concat(F.lit("json:"), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\u001f"), 256), 1, 12))
