"""The compiled normaliser against a plain interpreter of the same specs, on whole, cut and mutated payloads."""

import json
import random
import re
from datetime import datetime

import pytest

from telemill.functions.units import FALSE_WORDS, TRUE_WORDS, UNITS
from telemill.functions.values import NUMBER
from telemill.functions.vehicle import DTC_PATTERN, DTC_SCAN, LETTERS, VALUES, VIN_PATTERN, WEIGHTS
from telemill.operators import normalize
from telemill.plans.schema import BY_NAME, EVENT_TYPES, FIELDS, RAW, REQUIRED
from telemill.sources import fixtures


class Bad(Exception):
    pass


def number(v, bools=False):
    if isinstance(v, bool):
        if bools:
            return float(v)
        raise Bad
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str) and re.match(NUMBER, v.strip()):
        return float(v.strip().replace("_", ""))
    raise Bad


def whole(x):
    if not abs(x) < 9.2e18:
        raise Bad
    return round(x)


def text(v):
    return " ".join(v) if isinstance(v, list) else str(v)


def transform(v, t):
    op = t if isinstance(t, str) else t["op"]
    if op == "unit":
        factor, offset = UNITS[t["quantity"]][t["from"]]
        x = number(v) * factor + offset
        return whole(x) if t["quantity"] == "time" else x
    if op == "to_int":
        return whole(number(v))
    if op == "to_float":
        return number(v)
    if op == "round":
        return round(number(v), t["digits"])
    if op == "iso8601":
        try:
            return round(datetime.fromisoformat(text(v).strip().replace("Z", "+00:00")).timestamp() * 1000)
        except ValueError:
            raise Bad from None
    if op == "to_bool":
        if isinstance(v, bool):
            return v
        word = text(v).strip().lower()
        return True if word in TRUE_WORDS else False if word in FALSE_WORDS else number(v) != 0
    if op == "upper":
        return text(v).upper()
    if op == "strip":
        return text(v).strip()
    if op == "enum":
        return t["map"].get(text(v), t.get("default"))
    if op == "dtc_extract":
        return list(dict.fromkeys(re.findall(DTC_SCAN, text(v).upper())))
    raise AssertionError(op)


def coerce(v, kind):
    if v is None:
        return None
    if kind == "int":
        return v if isinstance(v, int) and not isinstance(v, bool) else whole(number(v, True))
    if kind == "float":
        return number(v, True)
    if kind == "bool":
        return v if isinstance(v, bool) else None
    if kind == "list[str]":
        return v if isinstance(v, list) else [text(v)]
    return text(v)


def decode(cfg, payload):
    try:
        body = payload.decode()
    except UnicodeDecodeError:
        raise Bad from None
    if cfg["type"] == "json":
        try:
            tree = json.loads(body)
        except ValueError:
            raise Bad from None
        if "pivot" in cfg:
            p = cfg["pivot"]
            tree[p["into"]] = {x[p["key"]]: x[p["value"]] for x in tree[p["path"]]}
        return tree
    if cfg["type"] == "delimited":
        parts = body.rstrip("\r\n").split(cfg["delimiter"])
        if len(parts) < len(cfg["columns"]):
            raise Bad
        return dict(zip(cfg["columns"], parts))
    return dict(x.split(cfg["kv_sep"], 1) for x in body.split(cfg["pair_sep"]) if cfg["kv_sep"] in x)


def at(tree, path):
    for step in path.split("."):
        tree = tree.get(step) if isinstance(tree, dict) else None
    return tree


def valid_vin(vin):
    if not re.match(VIN_PATTERN, vin):
        return False
    rest = sum(w * int(c.translate(str.maketrans(LETTERS, VALUES))) for w, c in zip(WEIGHTS, vin)) % 11
    return vin[8] == ("X" if rest == 10 else str(rest))


def interpret(spec, payload):
    """(reason, field) of the first fault, or the event."""
    try:
        tree = decode(spec["decoder"], payload)
    except Bad:
        return "DECODE_ERROR"
    event = {}
    for name in sorted(spec["fields"], key=lambda n: (n not in REQUIRED, [f.name for f in FIELDS].index(n))):
        m = spec["fields"][name]
        v = at(tree, m["path"])
        if v is None or v == "":
            if name in REQUIRED:
                return "SCHEMA_MISMATCH", name
            continue
        try:
            for t in m.get("transforms", []):
                v = transform(v, t) if v is not None else None
            event[name] = coerce(v, BY_NAME[name].kind)
        except Bad:
            return "TRANSFORM_ERROR", name
    for name in REQUIRED:
        if event.get(name) is None:
            return "INVALID", name
    if not valid_vin(event["vin"]):
        return "INVALID", "vin"
    for f in FIELDS:
        x = event.get(f.name)
        if f.low is not None and x is not None and not f.low <= x <= f.high:
            return "INVALID", f.name
    if any(not re.match(DTC_PATTERN, c) for c in event.get("dtc") or []):
        return "INVALID", "dtc"
    if event.get("evt") is not None and event["evt"] not in EVENT_TYPES:
        return "INVALID", "evt"
    return event


JUNK = [None, "", "abc", True, "1_000", " 12 ", -999, 5, "P0420 x P0420", "on", "0", "2001-02-03T04:05:06Z", "1e400"]


def mutated(dialect, payload, draw):
    body = payload.decode()
    if dialect in ("nested", "flat"):
        tree = json.loads(body)
        holders = [(tree, k) for k in tree if not isinstance(tree[k], dict)]
        holders += [(tree[a], k) for a in tree if isinstance(tree[a], dict) for k in tree[a] if not isinstance(tree[a][k], dict)]
        holders += [(y, k) for a in tree if isinstance(tree[a], dict) for y in tree[a].values() if isinstance(y, dict) for k in y]
        where, k = draw.choice(holders)
        if draw.random() < 0.2:
            del where[k]
        else:
            where[k] = draw.choice(JUNK)
        return json.dumps(tree).encode()
    if dialect == "pipe":
        parts = body.split("|")
        parts[draw.randrange(1, len(parts))] = str(draw.choice([x for x in JUNK if x is not None and x is not True]))
        return "|".join(parts).encode()
    parts = body.split(";")
    k = draw.randrange(len(parts))
    parts[k] = parts[k].split("=")[0] + "=" + str(draw.choice([x for x in JUNK if isinstance(x, str)]))
    return ";".join(parts).encode()


@pytest.mark.parametrize("dialect", ["nested", "flat", "pipe", "pairs"])
def test_compiled_equals_interpreted(spark, dialect):
    draw = random.Random(dialect)
    known = [bytes(r.value) for r in fixtures.raw_records(spark, "/root/testdata/sf0.001", (dialect,), False).collect()]
    payloads = known[:40] + [mutated(dialect, draw.choice(known), draw) for _ in range(400)] + ([b"{", b"\xff", known[0][:20]] if dialect != "pairs" else [b"\xff"])
    rows = [(b"k", p, dialect, 0, None, None, None, None, 0, 0, k) for k, p in enumerate(payloads)]
    out = normalize.outcomes(spark.createDataFrame(rows, RAW), fixtures.live_table((dialect,))).select("off", "event", "error").collect()
    assert len(out) == len(payloads)
    for r in out:
        want = interpret(fixtures.SPECS[dialect], payloads[r.off])
        if isinstance(want, dict):
            assert r.error is None, (payloads[r.off], r.error)
            for f in FIELDS:
                got = r.event[f.name]
                assert got == (pytest.approx(want.get(f.name), abs=1e-9) if isinstance(want.get(f.name), float) else want.get(f.name)), (f.name, payloads[r.off])
        else:
            reason, field = (want, None) if isinstance(want, str) else want
            assert r.error is not None and r.error.reason == reason and field in (None, r.error.field), (payloads[r.off], want, r.error)
