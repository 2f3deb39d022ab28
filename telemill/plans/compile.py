"""Mapping specs compiled to columns: the interpreter and the code generator are Catalyst's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.values import MAX_TRANSFORMS, SpecError, Value, apply, coerce
from telemill.functions.vehicle import DTC_PATTERN, is_valid_vin, vin_digits
from telemill.plans.schema import BY_NAME, CANONICAL, EVENT_TYPES, FIELDS, MAX_PAYLOAD, REQUIRED
from telemill.sources.decoders import decode, parse_path

ERROR = "struct<reason:string,field:string,detail:string>"


def _error(reason: str, field: str, detail) -> Column:
    return F.struct(F.lit(reason).alias("reason"), F.lit(field).alias("field"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def validate(event: dict[str, Column], digits: Column | None = None) -> Column:
    """First fault of a canonical event as ``struct(reason, field)``, or null: missing, vin, ranges in order, codes, event type."""
    fault = lambda reason, field: F.struct(F.lit(reason).alias("reason"), F.lit(field).alias("field"))
    ladder = [F.when(event[n].isNull(), fault("MISSING_REQUIRED", n)) for n in REQUIRED]
    ladder.append(F.when(~is_valid_vin(event["vin"], digits), fault("INVALID_VIN", "vin")))
    for f in FIELDS:
        if f.low is not None:
            x = event[f.name]
            out = (x < f.low) | (x > f.high)
            ladder.append(F.when(out | F.isnan(x) if f.kind == "float" else out, fault("OUT_OF_RANGE", f.name)))
    ladder.append(F.when(F.exists(event["dtc"], lambda c: ~F.coalesce(c.rlike(DTC_PATTERN), F.lit(False))), fault("INVALID_DTC", "dtc")))
    ladder.append(F.when(~event["evt"].isin(*EVENT_TYPES), fault("UNKNOWN_EVENT_TYPE", "evt")))
    return F.coalesce(*ladder)


@dataclass(frozen=True)
class Spec:
    oem: str
    version: int
    decoder: dict
    fields: tuple[tuple[str, str, tuple], ...]  # (canonical, path, transforms), required ones first

    def read(self, rows: DataFrame, payload: str, at: str) -> DataFrame:
        """``rows`` with ``<at>event`` and ``<at>error``, of which exactly one is set.

        Each step is a column of its own stage: decoded object, source values, transformed values, faults. So an
        expression is computed once however often it is used, and no tree grows with the number of fields.
        """
        own = list(rows.columns)
        got = decode(self.decoder, F.col(payload), f"{at}d_")
        for stage in got.stages:
            rows = rows.withColumns(stage)
        raws = {name: got.get(path) for name, path, _ in self.fields}
        stage = {}
        for name, v in raws.items():
            stage[f"{at}r_{name}"] = v.col
            if v.is_bool is not None:
                stage[f"{at}q_{name}"], stage[f"{at}i_{name}"] = v.is_bool, v.items
        rows = rows.withColumns(stage)
        stage = {}
        for name, _, transforms in self.fields:
            v = raws[name]
            typed = v.is_bool is not None
            v = Value(F.col(f"{at}r_{name}"), "raw", F.lit(False), F.col(f"{at}q_{name}") if typed else None, F.col(f"{at}i_{name}") if typed else None)
            absent = (v.col.isNull() & v.items.isNull()) | (v.col == "") if typed else v.col.isNull() | (v.col == "")
            absent = F.coalesce(absent, F.lit(False))
            for t in transforms:
                v = apply(v, t)
            v = coerce(v, BY_NAME[name].kind)
            stage |= {f"{at}a_{name}": absent, f"{at}b_{name}": ~absent & v.bad, f"{at}f_{name}": F.when(~absent, v.col).cast(CANONICAL[name].dataType)}
        rows = rows.withColumns(stage)
        event = {f.name: F.col(f"{at}f_{f.name}") if f.name in raws else F.lit(None).cast(CANONICAL[f.name].dataType) for f in FIELDS}
        rows = rows.withColumn(f"{at}digits", vin_digits(event["vin"]))
        rows = rows.withColumn(f"{at}wrong", validate(event, F.col(f"{at}digits")))
        faults = [F.when(F.length(payload) > MAX_PAYLOAD, _error("OVERSIZE", "", F.concat(F.length(payload).cast("string"), F.lit(" bytes")))), F.when(got.bad, _error("DECODE_ERROR", got.field, got.detail))]
        for name, path, _ in self.fields:
            # a transform may give null: absent for an optional field, and INVALID for a required one
            if BY_NAME[name].required:
                faults.append(F.when(F.col(f"{at}a_{name}"), _error("SCHEMA_MISMATCH", name, f"source field '{path}' is missing")))
            faults.append(F.when(F.col(f"{at}b_{name}"), _error("TRANSFORM_ERROR", name, f"{path}: not convertible")))
        wrong = F.col(f"{at}wrong")
        faults.append(F.when(wrong.isNotNull(), F.struct(F.lit("INVALID").alias("reason"), wrong["field"].alias("field"), wrong["reason"].alias("detail"))))
        return rows.select(*own, F.struct(*[event[f.name].alias(f.name) for f in FIELDS]).alias(f"{at}event"), F.coalesce(*faults).cast(ERROR).alias(f"{at}error"))


def compile_spec(oem: str, version: int, spec: object) -> Spec:
    """Check a spec document; whatever is wrong with it, the caller sees a SpecError."""
    if not isinstance(spec, dict):
        raise SpecError("spec must be an object")
    extra = sorted(set(spec) - {"oem", "decoder", "fields", "notes", "schema_version"})
    if extra:
        raise SpecError(f"unexpected keys in spec: {extra}")
    fields = spec.get("fields")
    if not isinstance(fields, dict) or not fields:
        raise SpecError("spec.fields must be a non-empty object")
    unknown, missing = sorted(set(fields) - set(BY_NAME)), [n for n in REQUIRED if n not in fields]
    if unknown or missing:
        raise SpecError(f"unknown canonical fields {unknown}, required ones not mapped {missing}")
    plan = []
    probe = Value(F.lit("x"), "raw", F.lit(False))
    for f in FIELDS:
        if f.name not in fields:
            continue
        m = fields[f.name]
        if not isinstance(m, dict) or "path" not in m:
            raise SpecError(f"field {f.name!r} needs a path")
        chain = m.get("transforms") or []
        if not isinstance(chain, list) or len(chain) > MAX_TRANSFORMS:
            raise SpecError(f"field {f.name!r}: transforms must be a list of at most {MAX_TRANSFORMS}")
        parse_path(m["path"])
        v = probe
        for t in chain:
            v = apply(v, t)
        plan.append((f.name, m["path"], tuple(chain)))
    plan.sort(key=lambda p: not BY_NAME[p[0]].required)
    out = Spec(oem, version, spec.get("decoder") or {}, tuple(plan))
    decode(out.decoder, F.lit(b""))
    return out
