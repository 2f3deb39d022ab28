"""Device buckets, canaries and fallback against plain Python."""

import struct

import xxhash
from pyspark.sql import functions as F

from telemill.functions.text import device_bucket
from telemill.operators import normalize
from telemill.plans.route import routing_table
from telemill.sources import fixtures

SF = "/root/testdata/sf0.001"


def bucket(key: bytes) -> int:
    seed = xxhash.xxh64(struct.pack("<i", 24301), seed=42).intdigest()
    out = xxhash.xxh64(key, seed=seed).intdigest()
    return (out - (1 << 64) if out >> 63 else out) % 100


def test_buckets(spark):
    keys = [str(k).encode() for k in range(500)] + [b"", "ünï".encode(), b"x" * 100]
    got = spark.createDataFrame([(k,) for k in keys], "k binary").select("k", device_bucket(F.col("k")).alias("b")).collect()
    assert [r.b for r in got] == [bucket(bytes(r.k)) for r in got] and len({r.b for r in got}) > 90


def test_a_canary_goes_first_for_its_share(spark):
    spec = fixtures.SPECS["pairs"]
    rounded = {**spec, "fields": {**spec["fields"], "odo_km": {"path": "sofar", "transforms": [{"op": "round", "digits": 0}]}}}
    table, errors = routing_table([{"oem": "pairs", "version": 1, "state": "active", "spec": spec}, {"oem": "pairs", "version": 2, "state": "canary", "canary_pct": 40, "spec": rounded}, {"oem": "pairs", "version": 3, "state": "draft", "spec": spec}, {"oem": "other", "version": 1, "state": "active", "spec": {"fields": {}}}])
    assert len(errors) == 1 and errors[0].startswith("other v1") and set(table) == {"pairs"}
    raw = fixtures.raw_records(spark, SF, ("pairs",), False)
    for r in normalize.outcomes(raw, table).select("key", "version", "attempt", "error").collect():
        if r.error is None:
            assert (r.version, r.attempt) == (2 if bucket(bytes(r.key)) < 40 else 1, 0)


def test_unknown_sources_and_oversize_payloads(spark):
    raw = fixtures.raw_records(spark, SF, ("pairs",), False).limit(3)
    big = raw.withColumn("value", F.encode(F.repeat(F.lit("x"), 100_000), "UTF-8"))
    other = raw.withColumn("oem", F.lit("nobody"))
    got = normalize.outcomes(big.union(other).union(other.withColumn("oem", F.lit(None).cast("string"))), fixtures.live_table(("pairs",))).select("error.reason", "version").collect()
    assert sorted((r.reason, r.version) for r in got) == [("NO_ADAPTER", 0)] * 6 + [("OVERSIZE", 0)] * 3
