"""Queries that run over whole tables, against brute force."""

from telemill.operators import governance, relational
from telemill.plans import registry


def _orders(spark, tmp_path):
    spark.range(1, 1001).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_retention_and_chain_over_all_orders(spark, tmp_path):
    d = _orders(spark, tmp_path)
    got = {r.path: r.keep for r in registry.queries()["retention"](spark, d).collect()}
    total, want = 0, {}
    for k in range(1000, 0, -1):
        total += 1000 + k % 7
        want[k] = total <= 100_000
    assert got == want
    assert {r.id: r.ok for r in registry.queries()["audit_chain"](spark, d).collect()} == {k: k % 50 != 7 for k in range(1, 1001)}


def test_chain_is_the_sequential_one(spark):
    rows: list = []
    for k in range(50):
        governance.append_audit(rows, {"ts": k, "actor": "a", "action": "read", "resource": None if k == 2 else f"r{k}"})
    frame = spark.createDataFrame([(r["ts"], r["actor"], r["action"], r["resource"]) for r in rows], "ts long, actor string, action string, resource string")
    assert [(r.id, r.hash) for r in governance.chained(frame).orderBy("id").collect()] == [(r["id"], r["hash"]) for r in rows]


def test_vector_top_k_takes_every_twentieth(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(200, 6))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(k), r + 1) for q in range(0, 200, 20) for r, k in enumerate(np.argsort(-(unit @ unit[q]))[:5])}
    assert {tuple(r) for r in registry.queries()["vector_top_k"](spark, str(tmp_path)).collect()} == want
    queries, known = frame.where("vec_id % 20 = 0").selectExpr("vec_id AS qid", "embedding AS v"), frame.selectExpr("vec_id AS kid", "embedding AS u")
    assert {(r.qid, r.kid, r["rank"]) for r in relational.cosine_top_k(queries, known, 5, most_rows=3).collect()} == want
