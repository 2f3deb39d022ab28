"""Relational reads: scoping, masking, pages, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.geo import geohash_mask
from telemill.operators.ordered import numbered


def small(df: DataFrame, most_rows: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows that hold at most ``most_bytes`` as text; else as it is."""
    held = df.limit(most_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if held.n <= most_rows and held.bytes <= most_bytes else df


def scoped(rows: DataFrame, tenant: int | None, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; without a tenant, all. Foreign rows look absent."""
    return rows if tenant is None else rows.where(F.col(column) == tenant)


def masked_position(rows: DataFrame, precise: bool, precision: int = 5) -> DataFrame:
    """Exact positions for roles that may see them, cell centres for the others."""
    if precise:
        return rows
    m = geohash_mask(F.col("lat"), F.col("lon"), precision)
    return rows.withColumn("_m", m).withColumn("lat", F.col("_m.lat")).withColumn("lon", F.col("_m.lon")).drop("_m")


def page(rows: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """Keyset page of ``size`` rows and one more, which tells that there is a next page."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size + 1)


def page_desc(rows: DataFrame, first: str, second: str, after: tuple | None, size: int) -> DataFrame:
    """Keyset page over two descending keys."""
    if after is not None:
        a, b = after
        rows = rows.where((F.col(first) < a) | ((F.col(first) == a) & (F.col(second) < b)))
    return rows.orderBy(F.desc(first), F.desc(second)).limit(size + 1)


def offset_page(rows: DataFrame, key: str, skip: int, size: int) -> DataFrame:
    return rows.orderBy(key).offset(skip).limit(size)


def bounded_sample(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows at an even stride in order; this is a map's limit of points."""
    stride = max(1, -(-rows.count() // most))
    return numbered(rows, F.col(order)).where((F.col("_n") - 1) % stride == 0).drop("_n")


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def valid_at(facts: DataFrame, intervals: DataFrame, key: str, at: str) -> DataFrame:
    """Interval join: the row of ``intervals(key, valid_from, valid_to)`` that holds at each fact's time; an open end is null."""
    on = (facts[key] == intervals[key]) & (facts[at] >= intervals["valid_from"]) & (intervals["valid_to"].isNull() | (facts[at] < intervals["valid_to"]))
    return facts.join(intervals, on, "left").drop(intervals[key])


def version_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two versions: added, removed, changed or same."""
    x, y = a.select(key, F.col(value).alias("before")), b.select(key, F.col(value).alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return x.join(y, key, "full").withColumn("change", kind)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each left row the last right value at or before it, through one sort per key."""
    both = left.select("*", F.lit(None).alias("_v"), F.lit(1).alias("_side")).unionByName(right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def cosine_top_k(queries: DataFrame, known: DataFrame, k: int, most_rows: int = 100_000) -> DataFrame:
    """Exact nearest known vectors of each query ``(qid, v)`` among ``known(kid, u)``, in blocks of about ``most_rows`` queries."""
    blocks = max(1, -(-queries.count() // most_rows))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))
    dot = F.aggregate(F.zip_with("v", "u", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, y: s + y)
    q, d = queries.withColumn("qn", norm(F.col("v"))), known.withColumn("kn", norm(F.col("u")))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "kid")
    out = None
    for block in range(blocks):
        own = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        scored = d.crossJoin(F.broadcast(own)).select("qid", "kid", (dot / (F.col("qn") * F.col("kn"))).alias("score"))
        best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.union(best)
    return out


def halves(cases: DataFrame, order: str) -> DataFrame:
    """Cases in order fall alternately into the development and the hold-out half."""
    return numbered(cases, F.col(order)).withColumn("half", F.when(F.col("_n") % 2 == 1, "dev").otherwise("hold_out")).drop("_n")
