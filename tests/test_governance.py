"""Life cycle, audit chain and erasure."""

import pytest

from telemill.operators import governance as g
from telemill.sources import fixtures


def test_life_cycle(spark):
    r = g.Registry()
    r.create("flat", fixtures.SPECS["flat"])
    with pytest.raises(ValueError):
        r.act("flat", 1, "validate", "agent", pass_rate=0.5)
    r.act("flat", 1, "validate", "agent", pass_rate=1.0)
    with pytest.raises(PermissionError):
        r.act("flat", 1, "approve", "agent")
    r.act("flat", 1, "approve", "user", canary_pct=20)
    r.act("flat", 1, "promote", "user")
    assert r.rows[0]["state"] == "active" and r.epoch == 2
    assert r.create("flat", fixtures.SPECS["flat"])["parent"] == 1


def test_audit_chain_shows_where_it_breaks(spark):
    rows: list = []
    for k in range(6):
        g.append_audit(rows, {"ts": k, "actor": "a", "action": "read", "resource": None if k == 2 else f"r{k}"})
    schema = "id int, ts int, actor string, action string, resource string, prev_hash string, hash string"
    tell = lambda x: [r.ok for r in g.verify_chain(spark.createDataFrame(x, schema)).orderBy("id").collect()]
    assert all(tell(rows))
    rows[3] = {**rows[3], "actor": "b"}
    assert tell(rows) == [True, True, True, False, True, True]


def test_erasure_leaves_nothing(spark):
    drivers = spark.createDataFrame([(1, "Ann", "ann@x.org"), (2, "Bob", "bob@x.org")], "driver_id int, name string, email string")
    links = spark.createDataFrame([(1, 10), (2, 11)], "driver_id int, vehicle_id int")
    cleared, cut, left = g.erase(drivers, links, 1)
    assert left.first().asDict() == {"left_name": 0, "left_email": 0}
    assert cleared.where("driver_id = 2").first().name == "Bob" and cut.count() == 1
