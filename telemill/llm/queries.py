"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lm_score, mixing, near_dup, pii, secrets, simhash, token_output, toxicity, url_filter

TOKENIZER = "word_bpe_49k.json"

#: so that reruns of the registered query agree; real data need a secret key, in the setting spark.telemill.pii.key
PUBLIC_KEY = "not a secret"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind_no"] < len(secrets.BASE_RULES))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key=spark.conf.get("spark.telemill.pii.key", PUBLIC_KEY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_score, op2_simhash, op3_secrets, op4_mixing, op5_toxicity, op6_decontamination, op7_token_output, op8_near_dup, op9_url_filter, op10_pii)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": _op3_sql(), "op6_decontamination": OP6_SQL, "op8_near_dup": OP8_SQL}


def _op3_sql() -> str:
    """Pieces between the matches and the matches give the positions, rule by rule."""
    each = []
    for k, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        p = r.pattern.replace("'", "''")
        each.append(f"SELECT doc_id, {k} AS kind_no, '{r.kind}' AS kind, m[i] AS m, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(regexp_extract(m[i], '{p}', {r.group})) AS counted, {r.least} AS least FROM (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m FROM d))")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, kind_no, kind, start, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + length(m) AS BIGINT) AS VARCHAR) AS said FROM ({" UNION ALL ".join(each)}) WHERE counted >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(said, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(secrets.BASE_RULES)}) AS base, string_agg(said, ',' ORDER BY start, kind_no) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.phrase = bw.phrase),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
df AS (SELECT x, count(*) AS f FROM u GROUP BY x),
r AS (SELECT u.doc_id, u.x, n.n, row_number() OVER (PARTITION BY u.doc_id ORDER BY f, u.x) AS k FROM u JOIN df USING (x) JOIN n USING (doc_id)),
p AS (SELECT doc_id, x, n FROM r WHERE k <= n - (n * 8 + 9) // 10 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
j AS (SELECT c.a, c.b, len(list_intersect(sa.s, sb.s)) AS shared, len(sa.s) + len(sb.s) AS total FROM c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b),
e AS (SELECT a, b FROM j WHERE 100 * shared >= 80 * (total - shared) UNION SELECT b, a FROM j WHERE 100 * shared >= 80 * (total - shared)),
reach(id, dst) AS (SELECT a, b FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.dst = e.a),
low AS (SELECT id, min(dst) AS first_id FROM reach GROUP BY id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(low.first_id, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(low.first_id, n.doc_id)) AS kept
FROM n LEFT JOIN low ON low.id = n.doc_id
"""
