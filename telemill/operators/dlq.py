"""Dead letters: groups, samples, shape families, replay and shadow runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.text import json_shape, text_shape
from telemill.operators.lineage import cut
from telemill.operators.normalize import outcomes
from telemill.sources.decoders import flatten_paths

MOST_ATTEMPTS = 5


def with_shape(dead: DataFrame) -> DataFrame:
    """``shape`` and ``paths`` of each payload: the field paths of JSON, ``col0 ...`` of delimited text, none of the rest."""
    text = F.col("value").cast("string")
    v = F.when(text.rlike("^[{\\[]"), F.try_parse_json(F.when(F.is_valid_utf8(text), text)))
    found = flatten_paths(dead.withColumn("_v", v), "_v", "_paths").withColumn("_json", F.when(F.col("_v").isNotNull(), F.array_sort(F.array_distinct("_paths")))).drop("_v", "_paths")
    found = found.withColumn("shape", F.when(F.col("_json").isNotNull(), json_shape(F.col("_json"))).otherwise(text_shape(F.col("value"))))
    columns = F.regexp_extract("shape", "(?s)^text:.:([0-9]+)$", 1).try_cast("int")
    other = F.when(columns > 0, F.transform(F.sequence(F.lit(0), columns - 1), lambda k: F.concat(F.lit("col"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    return found.withColumn("paths", F.coalesce("_json", other)).drop("_json")


def groups(dead: DataFrame) -> DataFrame:
    """By (source, reason, field, shape): count, first and last seen, detail and one sample."""
    return with_shape(dead).groupBy("oem", "reason", "field", "shape").agg(F.count("*").alias("n"), F.min("dead_ts").alias("first_seen"), F.max("dead_ts").alias("last_seen"), F.min_by("detail", F.struct("dead_ts", "off")).alias("detail"), F.min_by("value", F.struct("dead_ts", "off")).alias("sample"), F.first("paths").alias("paths"))


def samples(dead: DataFrame, most: int = 60) -> DataFrame:
    """At most ``most`` messages a group, the first by arrival."""
    w = Window.partitionBy("oem", "reason", "field", "shape").orderBy("dead_ts", "off")
    return with_shape(dead).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def tracks(dead: DataFrame, devices: int = 24, messages: int = 40) -> DataFrame:
    """Consecutive messages of the first devices of each source."""
    first = dead.groupBy("oem", "dev").agg(F.min(F.struct("dead_ts", "off")).alias("seen")).withColumn("rank", F.row_number().over(Window.partitionBy("oem").orderBy("seen", "dev"))).where(F.col("rank") <= devices)
    w = Window.partitionBy("oem", "dev").orderBy("dead_ts", "off")
    return dead.join(first.select("oem", "dev", F.col("rank").alias("device_rank")), ["oem", "dev"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= messages)


def similar_shapes(shapes: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of shapes of one source whose path sets have Jaccard similarity of at least ``least``.

    Shapes are kinds of message, tens a source. Pairs come from an equi-join on a shared path; two empty sets are alike.
    """
    s = shapes.select("oem", "shape", "paths").dropDuplicates(["oem", "shape"])
    held = s.select("oem", "shape", F.explode_outer("paths").alias("path"))
    a, b = held.select("oem", "path", F.col("shape").alias("a")), held.select("oem", "path", F.col("shape").alias("b"))
    shared = a.join(b, (a.oem == b.oem) & a.path.eqNullSafe(b.path) & (a.a < b.b)).groupBy(a.oem.alias("oem"), "a", "b").agg(F.count("*").alias("both"))
    size = s.select("oem", "shape", F.greatest(F.size("paths"), F.lit(1)).alias("n"))
    out = shared.join(size.select("oem", F.col("shape").alias("a"), F.col("n").alias("na")), ["oem", "a"]).join(size.select("oem", F.col("shape").alias("b"), F.col("n").alias("nb")), ["oem", "b"])
    return out.withColumn("similarity", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).where(F.col("similarity") >= least).select("oem", "a", "b", "similarity")


def families(shapes: DataFrame, least: float = 0.6) -> DataFrame:
    """``(oem, shape, family)``: components of similar shapes, named by their smallest shape; min-label rounds until nothing moves."""
    pairs = similar_shapes(shapes, least).select("oem", "a", "b")
    both = cut(pairs.union(pairs.select("oem", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(shapes.select("oem", "shape").distinct().withColumn("family", F.col("shape")))
    while True:
        near = both.join(label.select("oem", F.col("shape").alias("b"), "family"), ["oem", "b"]).groupBy("oem", F.col("a").alias("shape")).agg(F.min("family").alias("near"))
        new = cut(label.join(near, ["oem", "shape"], "left").select("oem", "shape", F.least("family", F.coalesce("near", "family")).alias("family"), F.col("family").alias("was")))
        label = new.drop("was")
        if not new.where("family <> was").limit(1).count():
            return label


def family_report(dead_groups: DataFrame, least: float = 0.6) -> DataFrame:
    """Per source and family: groups, messages and counts by reason."""
    f = families(dead_groups, least)
    by_reason = dead_groups.join(f, ["oem", "shape"]).groupBy("oem", "family", "reason").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))
    return by_reason.groupBy("oem", "family").agg(F.sum("groups").alias("groups"), F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))


def replay(dead: DataFrame, oem: str, end_off: int, done: DataFrame | None = None) -> DataFrame:
    """Parked messages of a source as raw records again: under the attempt limit, up to the end frozen at the start, each once."""
    chosen = dead.where((F.col("oem") == oem) & (F.col("attempts") < MOST_ATTEMPTS) & (F.col("off") <= end_off))
    if done is not None:
        chosen = chosen.join(done.select("part", "off"), ["part", "off"], "left_anti")
    return chosen.select("key", "value", "oem", "rx", F.lit(None).cast("string").alias("ct"), F.lit(None).cast("string").alias("tp"), F.lit(1).alias("replay"), "attempts", F.col("dead_ts").alias("ts"), "part", "off")


def shadow(dead: DataFrame, table) -> DataFrame:
    """What a candidate mapping would make of the parked messages: outcomes by reason and field; damaged ones apart."""
    out = outcomes(dead.select("key", "value", "oem", "rx"), table)
    reason = F.coalesce("error.reason", F.lit("ok"))
    return out.groupBy("oem", reason.alias("reason"), F.coalesce("error.field", F.lit("")).alias("field")).agg(F.count("*").alias("n"), (reason_is_damage(F.first(reason))).alias("damaged"))


def reason_is_damage(reason):
    return reason.isin("DECODE_ERROR", "OVERSIZE")
