"""SQL building blocks of the oracles: the facts of the generated telemetry straight from ``events``."""

from __future__ import annotations

from telemill.functions.geo import BASE32
from telemill.functions.vehicle import LETTERS, MARK, VALUES, WEIGHTS

_W = "[" + ",".join(map(str, WEIGHTS)) + "]"


def check_digit(vin: str) -> str:
    total = f"list_sum(list_transform(range(1, 18), lambda p: CAST(translate(substr({vin}, CAST(p AS INT), 1), '{LETTERS}', '{VALUES}') AS INT) * {_W}[p]))"
    return f"CASE WHEN {total} % 11 = 10 THEN 'X' ELSE CAST(CAST({total} % 11 AS INT) AS VARCHAR) END"


_BODY = f"('7TM{MARK}0' || lpad(CAST(user_id % 100000000 AS VARCHAR), 8, '0'))"

#: one row an event, before faults
TRUTH = f"""
truth AS (
  SELECT user_id, ['nested','flat','pipe','signals','pairs'][user_id % 5 + 1] AS oem,
    substr({_BODY}, 1, 8) || ({check_digit(_BODY)}) || substr({_BODY}, 10) AS vin,
    epoch_us(ts) // 1000 AS ts, event_id AS seq,
    ((user_id * 7919 + event_id * 104729) % 120000 - 60000) / 1000.0::DOUBLE AS lat,
    ((user_id * 104729 + event_id * 7919) % 300000 - 150000) / 1000.0::DOUBLE AS lon,
    value AS speed_kmh, event_id * 0.5::DOUBLE AS odo_km,
    CAST(event_id * 37 % 360 AS DOUBLE) AS heading_deg,
    CASE WHEN user_id % 2 = 0 THEN CAST(event_id % 101 AS DOUBLE) END AS soc_pct,
    CASE WHEN user_id % 2 = 1 THEN CAST(event_id * 3 % 101 AS DOUBLE) END AS fuel_pct,
    CAST(event_id % 60 - 20 AS DOUBLE) AS ambient_c, event_id % 2 = 0 AS ignition,
    CASE WHEN event_id % 10 < 7 THEN CAST([] AS VARCHAR[]) WHEN event_id % 10 = 7 THEN ['P0420'] WHEN event_id % 10 = 8 THEN ['P0300','C1234'] ELSE ['B1000'] END AS dtc,
    CASE event_type WHEN 'signup' THEN 'IGNITION_ON' WHEN 'error' THEN 'HARSH_BRAKE' WHEN 'click' THEN 'HARSH_ACCEL' WHEN 'view' THEN 'SPEEDING' WHEN 'purchase' THEN 'LOW_SOC' END AS evt,
    epoch_us(ts) // 1000 + CASE WHEN event_id % 37 = 0 THEN 3600000 ELSE 0 END + 250 AS rx
  FROM events),
good AS (SELECT * FROM truth WHERE seq % 101 <> 0 AND seq % 211 <> 0 AND speed_kmh <= 320)
"""


def geohash(lat: str, lon: str, precision: int) -> str:
    bits = 5 * precision
    x, y = (bits + 1) // 2, bits // 2
    sx = f"greatest(0, least({(1 << x) - 1}, CAST(floor(({lon} + 180.0) / 360.0 * {float(1 << x)}) AS BIGINT)))"
    sy = f"greatest(0, least({(1 << y) - 1}, CAST(floor(({lat} + 90.0) / 180.0 * {float(1 << y)}) AS BIGINT)))"
    out = []
    for c in range(precision):
        bit = []
        for b in range(5):
            k = 5 * c + b
            side, place = (sx, x - 1 - k // 2) if k % 2 == 0 else (sy, y - 1 - k // 2)
            bit.append(f"(({side} >> {place}) & 1) * {16 >> b}")
        out.append(f"substr('{BASE32}', CAST({' + '.join(bit)} AS INT) + 1, 1)")
    return "(" + " || ".join(out) + ")"


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"
