"""Positions: geohash cells, distances, bearings, polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_KM = 6371.0088


def _bound(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def _scaled(value: Column, low: float, width: float, bits: int) -> Column:
    top = (1 << bits) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((value - low) / width * float(1 << bits)).cast("bigint")))


def geohash_encode(lat: Column, lon: Column, precision: int = 5) -> Column:
    """Cell name from scaled integers, longitude bit first; null outside the valid range."""
    bits = precision * 5
    x, y = (bits + 1) // 2, bits // 2
    sx, sy = _scaled(lon, -180.0, 360.0, x), _scaled(lat, -90.0, 180.0, y)
    chars = []
    for c in range(precision):
        value = None
        for b in range(5):
            k = 5 * c + b
            side, place = (sx, x - 1 - k // 2) if k % 2 == 0 else (sy, y - 1 - k // 2)
            bit = F.shiftright(side, place).bitwiseAND(F.lit(1)) * (16 >> b)
            value = bit if value is None else value + bit
        chars.append(F.substr(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(*chars))


def geohash_bbox(cell: Column, precision: int) -> Column:
    """``struct(lat_lo, lat_hi, lon_lo, lon_hi)`` of a cell of known precision; null for other strings."""
    x, y, nx, ny = F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), 0, 0
    for c in range(precision):
        v = (F.call_function("locate", F.substring(cell, c + 1, 1), F.lit(BASE32)) - 1).cast("bigint")
        for b in range(5):
            bit = F.shiftright(v, 4 - b).bitwiseAND(F.lit(1))
            if (5 * c + b) % 2 == 0:
                x, nx = x * 2 + bit, nx + 1
            else:
                y, ny = y * 2 + bit, ny + 1
    w, h = 360.0 / (1 << nx), 180.0 / (1 << ny)
    box = F.struct((y * h - 90.0).alias("lat_lo"), ((y + 1) * h - 90.0).alias("lat_hi"), (x * w - 180.0).alias("lon_lo"), ((x + 1) * w - 180.0).alias("lon_hi"))
    return F.when(cell.rlike(f"^[{BASE32}]{{{precision}}}$"), box)


def geohash_decode(cell: Column, precision: int) -> Column:
    middle = lambda b: F.struct(((b["lat_lo"] + b["lat_hi"]) / 2).alias("lat"), ((b["lon_lo"] + b["lon_hi"]) / 2).alias("lon"))
    return _bound(cell, lambda c: _bound(geohash_bbox(c, precision), middle))


def geohash_mask(lat: Column, lon: Column, precision: int = 5) -> Column:
    """Position snapped to the centre of its cell."""
    return geohash_decode(geohash_encode(lat, lon, precision), precision)


def geohash_neighbors(cell: Column, precision: int) -> Column:
    """The cells around, sorted; longitude wraps, and there are fewer at the poles."""

    def around(box: Column) -> Column:
        dlat, dlon = box["lat_hi"] - box["lat_lo"], box["lon_hi"] - box["lon_lo"]
        lat, lon = (box["lat_lo"] + box["lat_hi"]) / 2, (box["lon_lo"] + box["lon_hi"]) / 2
        places = F.array(*[F.struct((lat + i * dlat).alias("lat"), (F.pmod(lon + j * dlon + 180.0, F.lit(360.0)) - 180.0).alias("lon")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        return F.transform(places, lambda p: geohash_encode(p["lat"], p["lon"], precision))

    return _bound(cell, lambda c: F.array_sort(F.array_except(F.array_compact(F.array_distinct(_bound(geohash_bbox(c, precision), around))), F.array(c))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def in_polygon(lat: Column, lon: Column, outline: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a closed outline of (lat, lon)."""
    crossings = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(outline, outline[1:] + outline[:1]):
        if a_lat == b_lat:
            continue
        over = (F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)
        left = lon < (b_lon - a_lon) * (lat - a_lat) / (b_lat - a_lat) + a_lon
        crossings = crossings + (over & left).cast("int")
    return crossings % 2 == 1
