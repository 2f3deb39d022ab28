"""Shapes and families of dead letters against brute force, and the rules of the registry and the read audit."""

import itertools
import random

import pytest

from telemill.operators import dlq, governance, ordered
from telemill.sources import fixtures

PAYLOADS = [b'{"a":1,"b":2,"c":3}', b'{"a":1,"b":2}', b'{"a":1,"z":9}', b"{}", b"1|2|3|4", b"1|2|3|4|5", b"1;2;3;4;5;6;7;8;9;10;11;12", b"plain", b"{broken", b"\xff\xfe\xfd", b"a,b,c,d"]


def paths_of(payload: bytes) -> tuple[str, frozenset]:
    import json

    if payload[:1] in b"{[":
        try:
            return "json", frozenset(json.loads(payload))
        except ValueError:
            pass
    try:
        text = payload.decode()
    except UnicodeDecodeError:
        return f"binary:{len(payload) // 16 * 16}", frozenset()
    for d in "|;,\t":
        if text.count(d) >= 3:
            return f"text:{d}:{text.count(d) + 1}", frozenset(f"col{k}" for k in range(text.count(d) + 1))
    return "text:plain", frozenset()


def test_families_against_all_pairs(spark):
    rows = spark.createDataFrame([("s", p, k) for k, p in enumerate(PAYLOADS)], "oem string, value binary, k int")
    shaped = dlq.with_shape(rows).collect()
    for r in shaped:
        kind, paths = paths_of(bytes(r.value))
        assert frozenset(r.paths) == paths and r.shape.startswith(kind)
    shapes = {r.shape: frozenset(r.paths) for r in shaped}
    group = {s: s for s in shapes}
    top = lambda s: s if group[s] == s else top(group[s])
    for a, b in itertools.combinations(sorted(shapes), 2):
        x, y = shapes[a], shapes[b]
        if (1.0 if not x and not y else len(x & y) / len(x | y)) >= 0.6:
            group[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.shape: r.family for r in dlq.families(dlq.with_shape(rows).select("oem", "shape", "paths")).collect()}
    assert got == {s: top(s) for s in shapes} and len(set(got.values())) > 3


def test_a_new_canary_retires_the_older_one():
    r = governance.Registry()
    for _ in range(2):
        v = r.create("flat", fixtures.SPECS["flat"])["version"]
        r.act("flat", v, "validate", "agent", pass_rate=1.0)
        r.act("flat", v, "approve", "user")
    assert [(x["state"], x["canary_pct"]) for x in r.rows] == [("retired", 0), ("canary", 100)]
    v = r.create("flat", fixtures.SPECS["flat"])["version"]
    r.act("flat", v, "validate", "agent", pass_rate=1.0)
    for wrong in (0, 101, True, 2.5):
        with pytest.raises(ValueError):
            r.act("flat", v, "approve", "user", canary_pct=wrong)


def test_reads_are_recorded_once_a_minute_from_the_last_recorded(spark):
    draw = random.Random(4)
    rows = [(c, p, draw.randrange(600_000)) for c in ("ann", None) for p in ("/a", "/b") for _ in range(60)] + [("x", "/", 59_000), ("x", "/", 61_000), ("x", "/", 119_000)]
    want, last = [], {}
    for c, p, ts in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if (c, p) not in last or ts - last[c, p] >= 60_000:
            last[c, p] = ts
            want.append((c, p, ts))
    got = [tuple(r) for r in governance.read_audit_once(spark.createDataFrame([*rows, ("x", "/", None)], "caller string, path string, ts long")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_numbers_and_sums_over_partitions(spark):
    from pyspark.sql import functions as F

    rows = [(k, draw) for k, draw in enumerate(random.Random(1).choices(range(50), k=500))]
    got = ordered.numbered(spark.createDataFrame(rows, "k long, x long"), F.desc("x"), F.col("k"), total=F.col("x")).collect()
    want, total = {}, 0
    for n, (k, x) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += x
        want[k] = (n, total)
    assert {r.k: (r._n, r._sum) for r in got} == want
    assert ordered.numbered(spark.createDataFrame([], "k long"), F.col("k")).count() == 0
