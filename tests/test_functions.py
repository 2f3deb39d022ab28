"""Known values, and the trip and window rules against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.functions import geo, text, values, vehicle
from telemill.operators import dedup, matching, state, trips
from telemill.plans.compile import compile_spec
from telemill.sources import fixtures
from telemill.sources.decoders import parse_path


def test_known_vectors(spark):
    r = spark.range(1).select(
        geo.geohash_encode(F.lit(57.64911), F.lit(10.40744), 11).alias("cell"),
        F.round(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), 3).alias("degree"),
        vehicle.is_valid_vin(F.lit("1HGCM82633A004352")).alias("good"),
        vehicle.is_valid_vin(F.lit("1HGCM82634A004352")).alias("bad"),
        vehicle.extract_dtcs(F.lit("xP0420 p0420, P0300;P0420")).alias("codes"),
        text.mask_vin(F.lit("1HGCM82633A004352")).alias("masked"),
    ).first()
    assert r.cell == "u4pruydqqvj" and r.degree == 111.195
    assert r.good and not r.bad
    assert r.codes == ["P0420", "P0300"]
    assert r.masked.endswith("004352") and "HGCM" not in r.masked


@pytest.mark.parametrize("raw,quantity,unit,want", [(60.0, "speed", "mph", 96.56064), (10.0, "speed", "knots", 18.52), (98.6, "temperature", "f", 37.0), (129716000.0, "angle", "e7", 12.9716)])
def test_units(spark, raw, quantity, unit, want):
    v = values.apply(values.Value(F.lit(raw), "num", F.lit(False)), {"op": "unit", "quantity": quantity, "from": unit})
    assert spark.range(1).select(v.col).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("spec", [None, {}, {"decoder": {"type": "json"}}, {**fixtures.SPECS["flat"], "extra": 1}, {**fixtures.SPECS["flat"], "fields": {**fixtures.SPECS["flat"]["fields"], "lat": {"path": "a b"}}}, {**fixtures.SPECS["flat"], "fields": {**fixtures.SPECS["flat"]["fields"], "lat": {"path": "a", "transforms": ["eval"]}}}, {**fixtures.SPECS["flat"], "decoder": {"type": "xml"}}])
def test_bad_specs_are_refused(spark, spec):
    with pytest.raises(values.SpecError):
        compile_spec("x", 1, spec)


def test_paths():
    assert parse_path("a.b[2].c[-1]") == ["a", "b", 2, "c", -1]
    for bad in ("", "a..b", "a[", "a b", "a" * 201):
        with pytest.raises(values.SpecError):
            parse_path(bad)


def test_replay_window_batch_equals_steps(spark):
    draw = random.Random(3)
    rows = [(f"v{draw.randrange(4)}", draw.randrange(150), 0, k) for k in range(600)]
    got = {r.off: r.outcome for r in dedup.replay_outcomes(spark.createDataFrame(rows, "vin string, seq long, part int, off long")).collect()}
    held: dict = {}
    for vin, seq, _, off in rows:
        outcome, top, mask = dedup.window_step(*held.get(vin, (None, 0)), seq)
        held[vin] = (top, mask)
        assert got[off] == outcome, (vin, seq, off)


def test_latest_state_ties_go_to_the_later_arrival(spark):
    rows = [("a", 5, 1.0, 0, 1), ("a", 5, 2.0, 0, 2), ("a", 3, 9.0, 0, 3), ("b", 1, 4.0, 0, 4)]
    got = {r.vin: (r.x, r.events) for r in state.latest_state(spark.createDataFrame(rows, "vin string, ts long, x double, part int, off long")).collect()}
    assert got == {"a": (2.0, 3), "b": (4.0, 1)}


def test_viterbi_is_optimal():
    draw = np.random.default_rng(5)
    for _ in range(20):
        cost = draw.random((7, 2)) * 4
        path = trips.decode_states(cost, 1.3)
        price = lambda p: sum(cost[i, s] for i, s in enumerate(p)) + 1.3 * sum(a != b for a, b in zip(p, p[1:]))
        assert price(path) == pytest.approx(min(price(p) for p in itertools.product((0, 1), repeat=7)))


def test_red_light_stays_in_its_trip():
    import pandas as pd

    speed = np.r_[np.zeros(300), np.full(290, 50.0), np.zeros(20), np.full(290, 50.0), np.zeros(300)]
    f = pd.DataFrame({"vin": "v", "ts": np.arange(len(speed)) * 1000, "lat": np.cumsum(speed) * 1e-6, "lon": 0.0, "speed_kmh": speed})
    got = trips.segment_one(f)
    assert got["state"].tolist() == [0, 1, 0] and got["points"].sum() == len(f)


def test_assignment_against_all_permutations():
    draw = np.random.default_rng(7)
    for n, m in ((3, 3), (3, 5), (5, 3)):
        for _ in range(10):
            c = draw.random((n, m))
            pairs = matching.assign(c)
            small, large = min(n, m), max(n, m)
            best = min(sum((c if n <= m else c.T)[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
            assert len(pairs) == small and sum(c[r, k] for r, k in pairs) == pytest.approx(best)
