"""Registry life cycle, golden gate, audit chain, erasure."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.operators.ordered import numbered
from telemill.plans.compile import compile_spec

# fixed values: action -> (states it starts from, state it leads to), and who may take it
TRANSITIONS = {
    "validate": (("draft", "validated"), "validated"),
    "approve": (("validated",), "canary"),
    "promote": (("canary", "validated"), "active"),
    "rollback": (("canary", "active"), "retired"),
    "retire": (("active", "canary"), "retired"),
    "reject": (("draft", "validated"), "rejected"),
}
ACTORS = {"approve": ("user",), "promote": ("user",), "reject": ("user",), "retire": ("user",), "rollback": ("user", "system")}
PASS_RATE = 0.99

# fixed values
TOLERANCE = {"lat": 2e-6, "lon": 2e-6, "heading_deg": 0.06, "speed_kmh": 0.02, "odo_km": 0.06, "soc_pct": 0.06, "fuel_pct": 0.06, "ambient_c": 0.06}
GENESIS = "0" * 64


def spec_hash(spec: dict) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Registry:
    """Mapping versions of all sources: a few rows on the driver, written out as a table on request."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.epoch = 0

    def create(self, oem: str, spec: dict, actor: str = "user") -> dict:
        compile_spec(oem, 1, spec)
        own = [r for r in self.rows if r["oem"] == oem]
        active = [r["version"] for r in own if r["state"] == "active"]
        row = {"oem": oem, "version": max((r["version"] for r in own), default=0) + 1, "state": "draft", "canary_pct": 0, "spec": spec, "hash": spec_hash(spec), "parent": max(active, default=None), "by": actor}
        self.rows.append(row)
        return row

    def act(self, oem: str, version: int, action: str, actor_kind: str, canary_pct: int = 100, pass_rate: float | None = None) -> dict:
        row = next((r for r in self.rows if (r["oem"], r["version"]) == (oem, version)), None)
        if row is None or action not in TRANSITIONS:
            raise ValueError("no such version or action")
        if actor_kind not in ACTORS.get(action, (actor_kind,)):
            raise PermissionError(f"{actor_kind} may not {action}")
        before, after = TRANSITIONS[action]
        if row["state"] not in before:
            raise ValueError(f"cannot {action} from {row['state']}")
        if action == "validate" and (pass_rate is None or pass_rate < PASS_RATE):
            raise ValueError("the golden set did not pass")
        if action == "approve":
            if isinstance(canary_pct, bool) or not isinstance(canary_pct, int) or not 1 <= canary_pct <= 100:
                raise ValueError("canary_pct must be 1..100")
            for older in self.rows:  # a source has one canary: the new one takes its place
                if older["oem"] == oem and older["state"] == "canary":
                    older["state"], older["canary_pct"] = "retired", 0
        row["state"] = after
        row["canary_pct"] = canary_pct if after == "canary" else 0
        if after in ("active", "canary", "retired"):
            self.epoch += 1
        return row

    def table(self, spark) -> DataFrame:
        rows = [(r["oem"], r["version"], r["state"], r["canary_pct"], json.dumps(r["spec"], sort_keys=True), r["hash"], r["parent"]) for r in self.rows]
        return spark.createDataFrame(rows, "oem string, version int, state string, canary_pct int, spec string, hash string, parent int")

    def mapping_fields(self, spark) -> DataFrame:
        """One row a mapped field: what a version diff compares."""
        rows = [(r["oem"], r["version"], name, m["path"], json.dumps(m.get("transforms") or [])) for r in self.rows for name, m in r["spec"]["fields"].items()]
        return spark.createDataFrame(rows, "oem string, version int, field string, path string, transforms string")


def field_matches(name: str, got: Column, want: Column) -> Column:
    """Equal, within the field's tolerance; an expected null or empty list asks for the same."""
    if name in TOLERANCE:
        return F.when(want.isNull(), got.isNull()).otherwise(F.coalesce(F.abs(got - want) <= TOLERANCE[name], F.lit(False)))
    if name == "dtc":
        empty = lambda x: F.coalesce(F.size(x) <= 0, F.lit(True)) | x.isNull()
        return F.when(empty(want), empty(got)).otherwise(got.eqNullSafe(want))
    return got.eqNullSafe(want)


def golden(produced: DataFrame, expected: DataFrame, fields: list[str], case: str = "case") -> DataFrame:
    """Per case and field whether the produced event matches."""
    p = produced.select(case, F.struct(*fields).alias("got"))
    j = expected.select(case, F.struct(*fields).alias("want")).join(p, case, "left")
    return j.select(case, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), field_matches(f, F.col(f"got.{f}"), F.col(f"want.{f}")).alias("ok")) for f in fields])))


def golden_report(checked: DataFrame, case: str = "case") -> tuple[DataFrame, DataFrame]:
    """Totals, and accuracy by field."""
    per_case = checked.groupBy(case).agg(F.min("ok").alias("ok"))
    total = per_case.agg(F.count("*").alias("total"), F.count(F.when(F.col("ok"), 1)).alias("passed"))
    return total, checked.groupBy("field").agg(F.avg(F.col("ok").cast("double")).alias("accuracy"))


def digest(prev: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", prev, *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)


def append_audit(rows: list[dict], entry: dict) -> dict:
    """Sequential append on the driver; ``digest`` gives the same hash in Spark."""
    prev = rows[-1]["hash"] if rows else GENESIS
    names = ("ts", "actor", "action", "resource")
    said = "\u001f".join([prev, *["\u0000" if entry.get(k) is None else str(entry[k]) for k in names]])
    row = {"id": len(rows) + 1, **{k: entry.get(k) for k in names}, "prev_hash": prev, "hash": hashlib.sha256(said.encode()).hexdigest()}
    rows.append(row)
    return row


def chained(entries: DataFrame) -> DataFrame:
    """``entries(ts, actor, action, resource)`` in order of ts with ``id, prev_hash, hash``: one stream on an executor, as each hash needs the one before."""

    def run(batches):
        last: list[dict] = []
        n = 0
        for batch in batches:
            out = []
            for entry in batch.to_pylist():
                row = append_audit(last, entry)
                last, n = [row], n + 1
                out.append({**row, "id": n})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("id", pa.int64()), ("ts", pa.int64()), *[(c, pa.string()) for c in ("actor", "action", "resource", "prev_hash", "hash")]])
    rows = entries.select(F.col("ts").cast("long").alias("ts"), "actor", "action", "resource").repartition(1).sortWithinPartitions("ts")
    return rows.mapInArrow(run, "id long, ts long, actor string, action string, resource string, prev_hash string, hash string")


def verify_chain(audit: DataFrame) -> DataFrame:
    """Per entry ``id, ok``: whether it follows its predecessor and its own hash is right. Ids are unique; gaps are allowed."""
    right = F.col("hash") == digest(F.col("prev_hash"), F.col("ts"), F.col("actor"), F.col("action"), F.col("resource"))
    rows = numbered(audit.select("id", "prev_hash", "hash", F.coalesce(right, F.lit(False)).alias("right")), F.col("id"))
    earlier = rows.select((F.col("_n") + 1).alias("_n"), F.col("hash").alias("before"))
    follows = F.coalesce(F.col("prev_hash") == F.when(F.col("_n") == 1, GENESIS).otherwise(F.col("before")), F.lit(False))
    return rows.join(earlier, "_n", "left").select("id", (F.col("right") & follows).alias("ok"))


def erase(drivers: DataFrame, assignments: DataFrame, driver_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Personal columns of one driver to null, its links cut, and what is left of it as evidence."""
    cleared = drivers.select(*[F.when(F.col("driver_id") == driver_id, None).otherwise(F.col(c)).alias(c) if c != "driver_id" else F.col(c) for c in drivers.columns])
    cut = assignments.where(F.col("driver_id") != driver_id)
    pii = [c for c in drivers.columns if c != "driver_id"]
    left = cleared.where(F.col("driver_id") == driver_id).agg(*[F.count(c).alias(f"left_{c}") for c in pii])
    return cleared, cut, left


def read_audit_once(reads: DataFrame, seconds: int = 60) -> DataFrame:
    """Reads to record of ``reads(caller, path, ts)``: the first of each caller and path, then each that comes ``seconds`` or
    more after the last recorded one.

    What is recorded depends on what was before, so the reads of a caller and path pass one task in order; it holds a
    batch and the last recorded time. A read without ts is left out.
    """
    rows = reads.select("caller", "path", F.col("ts").cast("long").alias("ts")).where("ts is not null")
    ordered = rows.repartition("caller", "path").sortWithinPartitions("caller", "path", "ts")

    def run(batches):
        who, last = None, 0
        for batch in batches:
            keep = []
            for caller, path, ts in zip(*(c.to_pylist() for c in batch.columns)):
                new = (caller, path) != who or ts - last >= seconds * 1000
                if new:
                    who, last = (caller, path), ts
                keep.append(new)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)
