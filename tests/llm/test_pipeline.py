"""Each stage of the corpus pipeline against brute force, on rows that are easily lost: null and repeated ids, tiny and empty texts."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from telemill.llm import mixing, toxicity
from telemill.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)
WORDS = [f"w{k}" for k in range(40)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


LONG = prose(60, 1)
TEXTS = [(1, LONG), (2, LONG), (2, LONG), (3, LONG + " tail"), (3, "other words entirely different from that"), (None, LONG), (None, prose(50, 2)), (None, prose(50, 2)), (4, "a b"), (5, "a B"), (6, "one"), (7, ""), (7, ""), (8, None), (9, " \t\n"), (None, ""), (10, prose(45, 3)), (11, prose(44, 3)), (12, "scum idiot " + prose(20, 4)), (13, "One two, THREE four five six seven eight nine ten eleven")]
ROWS = [(i, t, "en", "s" if k % 3 else None, len(t or "")) for k, (i, t) in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, 1, int(k == 12)) for k in range(1, 14)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, "one two three four five six seven eight nine ten"), (8, "a b")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def near(rows):
    """Groups by all pairs of five-word sets; the row that stays of each."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            group[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(top(k) if sets[k] else ("none", k), []).append(rows[k])
    return groups


def test_near_duplicates(spark, docs, sf_dir):
    got = STAGE["near_duplicates"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    left = rows_of(got)
    groups = near(TEXTS)
    assert sum(left.values()) == len(groups)
    for g in groups.values():
        least = min((i is None, i or 0) for i, _ in g)
        here = [r for r in set(g) if left[r] and (r[0] is None, r[0] or 0) == least]
        assert here, g
    assert left[(7, "")] == 2 and left[(3, "other words entirely different from that")] == 1


def test_toxicity(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    bad = model.above(model.scores(pa.array([t for _, t in TEXTS], pa.string())))[:, 0] >= 0.25
    assert rows_of(STAGE["toxicity"](spark, docs, sf_dir)) == Counter(r for r, b in zip(TEXTS, bad) if not b)


def test_a_toxic_word_goes_and_clean_rows_stay(spark, sf_dir, tmp_path):
    rows = [(k, f"{'idiot scum ' if k % 4 == 0 else ''}{prose(30, k)}", "en", "s", 0) for k in range(200)] + [(None, "idiot scum and so on", "en", "s", 0), (None, prose(30, 999), "en", None, 0), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = rows_of(STAGE["toxicity"](spark, docs, str(tmp_path)))
    assert got == Counter((i, t) for i, t, *_ in rows if "idiot" not in (t or ""))


def test_decontamination(spark, docs, sf_dir):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    def hit(t):
        w = words(t)
        return any(w[k : k + n] == item for item in (words("one two three four five six seven eight nine ten"), ["a", "b"]) for n in [len(item)] for k in range(len(w)))

    assert rows_of(STAGE["decontamination"](spark, docs, sf_dir)) == Counter(r for r in TEXTS if not hit(r[1]))


def test_mixing(spark, docs, sf_dir):
    got = rows_of(STAGE["mixing"](spark, docs, sf_dir))
    want = Counter()
    texts = {}
    for i, t in TEXTS:
        texts.setdefault((i, len((t or "").split())), set()).add(t)
    for r in mixing.mix_sources(docs).where("size > 0").collect():
        (t,) = texts[(r.doc_id, r.size)]
        want[(r.doc_id, t)] += (2 * r.taken + r["size"]) // (2 * r["size"])
    assert got == +want and any(i is None for i, _ in got)


def test_token_output(spark, docs, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, x in TEXTS:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    got = STAGE["token_output"](spark, docs, sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_empty_tables(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], SCHEMA), sf_dir)
        assert out.count() == 0, name
        assert name == "token_output" or out.columns == corpus_pipeline.COLUMNS


def test_whole_run(spark, sf_dir):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and not {r.doc_id for r in got} & {4, 5, 13} and {r.doc_id for r in got} <= {i for i, _ in TEXTS}
    assert sorted(r.start for r in got) == np.cumsum([0, *[r.n_tokens for r in sorted(got, key=lambda r: r.start)]])[:-1].tolist()
