"""Onboarding of a source: decoding what can be decoded, previews with lineage, golden cases and their labels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators.dlq import with_shape
from telemill.operators.normalize import outcomes
from telemill.plans.compile import compile_spec
from telemill.plans.route import Routes
from telemill.sources.decoders import decode


def decode_counts(raw: DataFrame, decoder: dict) -> DataFrame:
    """Per source of ``raw(oem, value)``: payloads that the decoder reads, and those that it does not."""
    got = decode(decoder, F.col("value"), "_d_")
    rows = raw
    for stage in got.stages:
        rows = rows.withColumns(stage)
    bad = F.coalesce(got.bad, F.lit(True))
    return rows.groupBy("oem").agg(F.count(F.when(~bad, 1)).alias("decoded"), F.count(F.when(bad, 1)).alias("failed"))


def preview(raw: DataFrame, oem: str, version: int, spec: dict) -> DataFrame:
    """``raw(value, ...)`` with ``event``, ``error`` and ``lineage``: for each mapped field its path, transforms and source value."""
    compiled = compile_spec(oem, version, spec)
    got = decode(compiled.decoder, F.col("value"), "_p_")
    rows = raw
    for stage in got.stages:
        rows = rows.withColumns(stage)
    said = [F.struct(F.lit(name).alias("canonical"), F.lit(path).alias("path"), F.lit(json.dumps(list(chain))).alias("transforms"), got.get(path).col.cast("string").alias("source_value")) for name, path, chain in compiled.fields]
    # one-row generator: the lineage is made here, and not again in each stage of the normaliser
    rows = rows.withColumn("oem", F.lit(oem)).select(*[c for c in raw.columns if c != "oem"], "oem", F.inline(F.array(F.struct(F.array(*said).alias("lineage")))))
    return outcomes(rows, {oem: Routes([compiled])}).drop("attempt")


def golden_seeds(cases: DataFrame, per_event: int = 4, rest: int = 20) -> DataFrame:
    """Golden cases from ``cases(label, evt, speed_kmh, dtc, order, ...)``: the first ``per_event`` of each label and event type,
    moving ones first, and ``rest`` more of each label that vary: moving and with trouble codes first."""
    moving = (F.col("speed_kmh") > 5).cast("int")
    of_event = F.row_number().over(Window.partitionBy("label", "evt").orderBy(F.desc(moving), "order"))
    ranked = cases.withColumn("_event_rank", F.when(F.col("evt").isNotNull(), of_event))
    first = F.coalesce(F.col("_event_rank") <= per_event, F.lit(False))
    varied = (F.col("speed_kmh") > 1).cast("int") + (F.coalesce(F.size("dtc"), F.lit(0)) > 0).cast("int")
    of_rest = F.row_number().over(Window.partitionBy("label", F.col("_first")).orderBy(F.desc(varied), "order"))
    return ranked.withColumn("_first", first).withColumn("_rest_rank", of_rest).where(F.col("_first") | (F.col("_rest_rank") <= rest)).withColumn("why", F.when(F.col("_first"), "event").otherwise("varied")).drop("_event_rank", "_first", "_rest_rank")


def golden_label(payloads: DataFrame, golden: DataFrame) -> DataFrame:
    """Per source of ``payloads(oem, value)`` the label of ``golden(oem, label, value)`` whose field paths overlap most with theirs.

    Overlap is the Jaccard similarity of the two sets of paths; ties go to the first label. A source without payloads is absent.
    """
    paths = lambda rows, *by: with_shape(rows).select(*by, F.explode("paths").alias("path")).distinct()
    mine, known = paths(payloads, "oem"), paths(golden, "oem", "label")
    n = mine.groupBy("oem").agg(F.count("*").alias("n"))
    m = known.groupBy("oem", "label").agg(F.count("*").alias("m"))
    both = known.join(mine, ["oem", "path"]).groupBy("oem", "label").agg(F.count("*").alias("both"))
    labels = golden.select("oem", "label").distinct().join(payloads.select("oem").distinct(), "oem")
    scored = labels.join(n, "oem", "left").join(m, ["oem", "label"], "left").join(both, ["oem", "label"], "left").na.fill(0)
    union = F.col("n") + F.col("m") - F.col("both")
    overlap = F.when(union > 0, F.col("both") / union).otherwise(0.0)
    best = Window.partitionBy("oem").orderBy(F.desc("overlap"), "label")
    return scored.withColumn("overlap", overlap).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("oem", "label", "overlap")


class ReplayJobs:
    """Queue of replay jobs on the driver: queued, running, then done or failed. One job reads one source's dead letters."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def queue(self, oem: str, by: str = "user", trigger: str = "manual") -> int:
        self.rows.append({"id": len(self.rows) + 1, "oem": oem, "by": by, "trigger": trigger, "status": "queued", "scanned": 0, "republished": 0, "skipped": 0, "error": None})
        return len(self.rows)

    def run_queued(self, run) -> int:
        """``run(oem)`` gives (scanned, republished); a job that raises is failed, and the next one runs."""
        waiting = [r for r in self.rows if r["status"] == "queued"]
        for row in waiting:
            row["status"] = "running"
            try:
                scanned, republished = run(row["oem"])
                row |= {"status": "done", "scanned": scanned, "republished": republished, "skipped": scanned - republished}
            except Exception as e:  # noqa: BLE001 - what went wrong belongs to the job
                row |= {"status": "failed", "error": str(e)[:200]}
        return len(waiting)
