"""Streams over file topics, with restarts, against the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from telemill.operators import dedup, normalize, state
from telemill.sources import archive, fixtures
from telemill.streaming import pipeline

NOW = 1_800_000_000_000
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return fixtures.raw_records(spark, SF, ("pairs",)).cache()


def halves(raw):
    middle = raw.approxQuantile("rx", [0.5], 0)[0]
    return raw.where(F.col("rx") <= middle), raw.where(F.col("rx") > middle)


def test_normaliser_with_a_restart(spark, raw, tmp_path):
    topic, table = f"{tmp_path}/raw", fixtures.live_table(("pairs",))
    for part in halves(raw):
        archive.produce(part, topic, 2)
        events, dead = pipeline.normalizer(spark, topic, table, NOW)
        pipeline.run_once(events, f"{tmp_path}/events", f"{tmp_path}/c1")
        pipeline.run_once(dead, f"{tmp_path}/dead", f"{tmp_path}/c2")
    batch = normalize.normalize(raw, table, NOW)
    key = lambda df: sorted((r.vin, r.seq) for r in df.select("vin", "seq").collect())
    assert key(spark.read.parquet(f"{tmp_path}/events")) == key(batch.events)
    told = lambda df: sorted((r.reason, r.field, r.off) for r in df.select("reason", "field", "off").collect())
    assert told(spark.read.parquet(f"{tmp_path}/dead")) == told(batch.dead)


def numbered(spark, rows):
    return spark.createDataFrame(rows, "vin string, seq long, part int, off long, rx_ts long")


def test_stale_numbers_are_forgotten_after_a_while(spark, tmp_path):
    hour = 3_600_000
    rows = [("v", 1000, 0, 1, 0), ("v", 5, 0, 2, 0), ("v", 5, 0, 3, hour), ("v", 1000, 0, 4, hour), ("v", 5, 0, 5, 3 * hour), ("u", 5, 0, 6, 0), ("x", 1, 0, 7, 0), ("x", 1, 0, 8, 0)]
    numbered(spark, rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(numbered(spark, []).schema).parquet(f"{tmp_path}/in")
    out = dedup.stream_deduplicated(stream, known=F.col("vin") != "x", ttl_ms=2 * hour)
    pipeline.run_once(out, f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted(r.off for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 5, 6, 7, 8]


def test_stream_of_numbers_against_plain_sets(spark, tmp_path):
    """Inside the window of 64 every number once; of those behind it every one that came so late before."""
    draw = random.Random(2)
    rows = [(f"v{draw.randrange(3)}", draw.randrange(200), 0, k, k) for k in range(900)]
    for n in range(3):
        numbered(spark, rows[300 * n : 300 * n + 300]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(numbered(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        pipeline.run_once(dedup.stream_deduplicated(stream), f"{tmp_path}/out", f"{tmp_path}/c")
    top, inside, late, want = {}, set(), set(), []
    for vin, seq, _, off, _ in rows:
        held = late if top.get(vin, seq) - seq >= 64 else inside
        if (vin, seq) not in held:
            held.add((vin, seq))
            want.append(off)
        top[vin] = max(top.get(vin, seq), seq)
    assert sorted(r.off for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_processor_state_and_archive(spark, raw, tmp_path):
    events = normalize.normalize(raw, fixtures.live_table(("pairs",)), NOW).events.cache()
    first, second = events.where("seq % 2 = 0"), events.where("seq % 2 = 1")
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
        pipeline.process(stream, f"{tmp_path}/out", f"{tmp_path}/c", NOW)
    want = {r.vin: r.ts for r in state.latest_state(events).collect()}
    got = {r.vin: r.ts for r in spark.read.parquet(f"{tmp_path}/out/state/1").collect()}
    assert got == want
    kept = spark.read.parquet(f"{tmp_path}/out/archive")
    assert sorted((r.vin, r.seq) for r in kept.collect()) == sorted((r.vin, r.seq) for r in events.collect())


def test_minutes_with_a_watermark(spark, raw, tmp_path):
    events = normalize.normalize(raw, fixtures.live_table(("pairs",)), NOW).events
    events.select("oem", "ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("oem string, ts long").parquet(f"{tmp_path}/in")
    pipeline.run_once(pipeline.minute_counts(stream), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {(r.oem, r.minute_ms): r.events for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.oem, r.m): r.n for r in events.groupBy("oem", (F.col("ts") - F.col("ts") % 60000).alias("m")).agg(F.count("*").alias("n")).collect()}
    # the last minutes stay open until the watermark has passed them
    assert got and got.items() <= want.items() and len(want) - len(got) <= 2
