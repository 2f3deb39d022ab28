"""Queries over the relational tables: joins, pages, set operations, governance, matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from telemill.operators import governance, matching, relational
from telemill.plans.registry import query
from telemill.sources import archive


def _t(spark, d, *names):
    out = [spark.read.parquet(f"{d}/{n}.parquet") for n in names]
    return out if len(out) > 1 else out[0]


@query("join_inner", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _inner(spark, d):
    c, n, r = _t(spark, d, "customer", "nation", "region")
    return c.join(relational.small(n), c.c_nationkey == n.n_nationkey).join(relational.small(r), n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query("join_left_grouped", "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _left(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    g = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return c.join(g, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("join_full_diff", "WITH a AS (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END AS v FROM part WHERE p_partkey % 4 <> 0) SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.k = b.k")
def _full(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    return relational.version_diff(p.where("k % 3 <> 0"), p.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "new").otherwise(F.col("v"))), "k", "v")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _semi(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _anti(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("join_interval", "SELECT o_orderkey, r_name AS owner FROM orders LEFT JOIN region ON o_custkey % 5 = r_regionkey AND o_orderkey >= r_regionkey * 100 AND (r_regionkey = 4 OR o_orderkey < r_regionkey * 100 + 5000)")
def _interval(spark, d):
    o, r = _t(spark, d, "orders", "region")
    facts = o.select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("k"))
    spans = r.select(F.col("r_regionkey").cast("int").alias("k"), (F.col("r_regionkey") * 100).alias("valid_from"), F.when(F.col("r_regionkey") != 4, F.col("r_regionkey") * 100 + 5000).alias("valid_to"), F.col("r_name").alias("owner"))
    return relational.valid_at(facts, spans, "k", "o_orderkey").select("o_orderkey", "owner")


@query("page_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 51")
def _page(spark, d):
    return relational.page(_t(spark, d, "orders"), "o_orderkey", 100, 50).select("o_orderkey")


@query("page_keyset_two", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey < 500 OR (l_orderkey = 500 AND l_linenumber < 3) ORDER BY 1 DESC, 2 DESC LIMIT 31")
def _page2(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return relational.page_desc(rows, "l_orderkey", "l_linenumber", (500, 3), 30)


@query("page_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 200")
def _offset(spark, d):
    return relational.offset_page(_t(spark, d, "orders"), "o_orderkey", 200, 20).select("o_orderkey")


@query("tenancy", "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def _tenancy(spark, d):
    return relational.scoped(_t(spark, d, "customer"), 7, "c_nationkey").select("c_custkey")


@query("prefix_filter", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S')")
def _prefix(spark, d):
    return _t(spark, d, "part").where(F.col("p_type").startswith("S")).select("p_partkey")


@query("fleet_mix", "SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _mix(spark, d):
    c, n = _t(spark, d, "customer", "nation")
    return c.join(relational.small(n), c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("halves", "SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY p_partkey) % 2 = 1 THEN 'dev' ELSE 'hold_out' END AS half FROM part")
def _halves(spark, d):
    return relational.halves(_t(spark, d, "part"), "p_partkey").select("p_partkey", "half")


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _union(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _intersect(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _except(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).exceptAll(s.select("s_nationkey"))


@query("vector_top_k", "WITH q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS kid, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS score FROM q, embeddings) SELECT qid, kid, rank FROM (SELECT qid, kid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, kid) AS INT) AS rank FROM s) WHERE rank <= 5")
def _vectors(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return relational.cosine_top_k(q, e.select(F.col("vec_id").alias("kid"), F.col("embedding").alias("u")), 5).select("qid", "kid", "rank")


@query("upsert_once", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def _upsert(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    return archive.upsert_once(o.where("o_orderkey % 3 = 0"), o.union(o), ("o_orderkey",))


@query("retention", "WITH f AS (SELECT o_orderkey AS path, 1000 + o_orderkey % 7 AS size, o_orderkey AS written FROM orders), s AS (SELECT *, sum(size) OVER (ORDER BY written DESC) AS total, row_number() OVER (ORDER BY written DESC) AS n FROM f) SELECT path, total <= 100 * (SELECT count(*) FROM f) OR n = 1 AS keep FROM s")
def _retention(spark, d):
    f = _t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (1000 + F.col("o_orderkey") % 7).alias("size"), F.col("o_orderkey").alias("written"))
    return archive.retained(f, 100 * f.count()).select("path", "keep")


@query("csv_lines", "SELECT CAST(n_nationkey AS VARCHAR) || ',' || n_name || ',\"{a,b}\"' AS line FROM nation")
def _csv(spark, d):
    return archive.to_csv_rows(_t(spark, d, "nation").select("n_nationkey", "n_name", F.array(F.lit("a"), F.lit("b")).alias("x")))


@query("erasure", "SELECT c_custkey, CASE WHEN c_custkey <> 5 THEN c_name END AS c_name FROM customer")
def _erasure(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("driver_id"), "c_name")
    return governance.erase(c, c, 5)[0].select(F.col("driver_id").alias("c_custkey"), "c_name")


@query("audit_chain", "SELECT o_orderkey AS id, o_orderkey % 50 <> 7 AS ok FROM orders")
def _audit(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("ts"), F.lit("x").alias("actor"), F.lit("read").alias("action"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("resource"))
    t = governance.chained(o).withColumn("id", F.col("ts")).withColumn("actor", F.when(F.col("ts") % 50 == 7, "forged").otherwise(F.col("actor")))
    return governance.verify_chain(t)


@query("profile_stats", "SELECT 'events' AS oem, event_type AS path, count(*) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, count(DISTINCT value) AS distinct FROM events GROUP BY event_type")
def _profile(spark, d):
    e = _t(spark, d, "events").select(F.lit("events").alias("oem"), F.col("event_type").alias("path"), F.col("user_id").alias("dev"), F.col("event_id").alias("ord"), F.col("value").cast("string").alias("value"))
    return matching.profile(e).select("oem", "path", "n", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), "distinct")


@query("k_step_lead", "SELECT user_id, event_id, nxt - value AS d FROM (SELECT *, lead(value, 8) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def _lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _t(spark, d, "events").withColumn("nxt", F.lead("value", 8).over(w)).where("nxt is not null").select("user_id", "event_id", (F.col("nxt") - F.col("value")).alias("d"))


@query("event_table_vote", "SELECT oem, code, evt, n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, evt) AS r FROM (SELECT 's' AS oem, user_id % 10 AS code, event_type AS evt, count(*) AS n FROM events GROUP BY user_id % 10, event_type)) WHERE r = 1")
def _vote(spark, d):
    return matching.event_table(_t(spark, d, "events").select(F.lit("s").alias("oem"), (F.col("user_id") % 10).alias("code"), F.col("event_type").alias("evt")))


@query("ml_scores", "WITH p AS (SELECT event_type AS label, CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS guess FROM events), g AS (SELECT guess, count(*) AS told FROM p GROUP BY 1) SELECT label, count(*) AS n, count(*) FILTER (label = guess) AS hit, round(count(*) FILTER (label = guess) / count(*), 9) AS recall FROM p GROUP BY label")
def _scores(spark, d):
    p = _t(spark, d, "events").select(F.col("event_type").alias("label"), F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("event_type")).alias("guess"))
    return matching.scores(p).select("label", "n", "hit", F.round("recall", 9).alias("recall"))


@query("assignment")
def _assign(spark, d):
    e = _t(spark, d, "events")
    p = e.groupBy(F.lit("s").alias("oem"), F.col("event_type").alias("path"), F.concat(F.lit("f"), (F.col("user_id") % 6).cast("string")).alias("field"), F.lit("u").alias("unit")).agg((F.count("*") / 100.0).alias("p"))
    return matching.joint_assignment(p)


@query("read_audit_once", "WITH RECURSIVE r AS (SELECT user_id AS caller, event_type AS path, epoch_us(ts) // 1000 AS ts FROM events), k AS (SELECT caller, path, min(ts) AS ts FROM r GROUP BY caller, path UNION ALL SELECT r.caller, r.path, min(r.ts) AS ts FROM k JOIN r ON r.caller = k.caller AND r.path = k.path AND r.ts >= k.ts + 60000 GROUP BY r.caller, r.path) SELECT caller, path, ts FROM k")
def _reads(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("caller"), F.col("event_type").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return governance.read_audit_once(e)
