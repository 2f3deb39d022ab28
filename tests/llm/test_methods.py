"""Parts of the corpus operators against independent computations."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telemill.llm import decontam, lm_score, mixing, near_dup, secrets, simhash, token_output, toxicity, trigrams, url_filter
from telemill.llm._spans import spans
from telemill.llm._words import blocks, shingles
from telemill.llm.components import components
from telemill.llm.queries import tokenizer_path

CLASHING = "doc_id long, text string, source string, key string, doc_key int, covered string, row int, toxic string, severity int, t int, label string, found int, n int, size int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "s", "k", 1, "c", 2, "x", 3, 4, "l", 5, 6, 7) for r in rows], CLASHING)


# ---- op1


def test_probabilities_by_plain_softmax():
    net, words = lm_score.start(40), 40
    draw = np.random.default_rng(1)
    ids = draw.integers(0, words + lm_score.n_rare(words), 300)
    near = lm_score.windows(ids, np.array([0, 7, 7, 300]))
    got = lm_score.log_probs(net, ids, near)
    classes = len(net["classes"])
    for k in draw.integers(0, 300, 40):
        row = next((a, b) for a, b in ((0, 7), (7, 300)) if a <= k < b)
        h = np.zeros(lm_score.WIDTH)
        for j, d in enumerate(lm_score.OFFSETS):
            h += net["embed"][j][ids[k + d] if row[0] <= k + d < row[1] else lm_score.PAD]
        h = np.append(np.tanh(h + net["bias"]), 1.0)
        soft = lambda z, i: z[i] - np.log(np.exp(z - z.max()).sum()) - z.max()
        want = soft(net["classes"] @ h, ids[k] % classes) + soft(net["words"][ids[k] % classes] @ h, ids[k] // classes)
        assert got[k] == pytest.approx(want, abs=1e-4)


def test_training_tells_order(spark):
    draw = random.Random(3)
    line = "the quick brown fox jumps over the lazy dog and runs to the old mill by the river".split()
    text = lambda n: " ".join(line * n)
    mixed = lambda n: " ".join(draw.sample(line * n, len(line) * n))
    docs = spark.createDataFrame([(k, text(40)) for k in range(60)], "doc_id long, text string").repartition(3)
    counts = lm_score.word_counts(docs)
    model = lm_score.train(docs, counts, rounds=6)
    probe = spark.createDataFrame([(1, text(20)), (2, mixed(20))], "doc_id long, text string")
    got = {r.doc_id: r.per_token for r in lm_score.score(probe, counts, *model).collect()}
    assert got[1] > got[2] + 0.2


def test_averages_of_many_tasks(spark):
    schema = "part int, group int, weight double, values array<float>"
    draw = np.random.default_rng(2)
    rows = [(p, g, float(draw.integers(1, 9)), draw.random(3).tolist()) for p in range(2) for g in range(300)]
    level = lm_score._average(spark.createDataFrame(rows, schema), schema)
    assert level.agg(F.max("group")).first()[0] == 4
    final = {r.part: r["values"] for r in lm_score._average(level, schema).collect()}
    for p in range(2):
        own = [(w, v) for q, _, w, v in rows if q == p]
        assert final[p] == pytest.approx(np.average([v for _, v in own], axis=0, weights=[w for w, _ in own]), rel=1e-5)


# ---- op3


def test_every_match_satisfies_its_query():
    draw = random.Random(5)
    patterns = {"(foo|ba?r)=x*(cat|dog)s?": lambda: draw.choice(["foo", "bar", "br"]) + "=" + "x" * draw.randrange(3) + draw.choice(["cat", "dog"]) + draw.choice(["", "s"]), "ab[cd]ef+[0-9]{2}tail": lambda: "ab" + draw.choice("cd") + "e" + "f" * draw.randrange(1, 4) + "42tail", "(abc){2}z": lambda: "abcabcz", "(?:ab)?cde": lambda: draw.choice(["ab", ""]) + "cde"}
    for pattern, make in patterns.items():
        query = trigrams.trigram_query(pattern)
        for _ in range(50):
            text = make()
            assert re.fullmatch(pattern, text) and any(all(t in text for t in clause) for clause in query), (pattern, text, query)
    assert trigrams.trigram_query("a[0-9]b") == trigrams.ANY == trigrams.trigram_query("(abc|x)")
    assert {len(c) for c in trigrams.trigram_query("AKIA[A-Z0-9]+")} == {2}
    assert all(r.query != trigrams.ANY for r in secrets.BASE_RULES + secrets.MORE_RULES if r.kind != "hex")


def test_secrets_with_clashing_columns_and_many_matches(spark):
    text = " ".join(f"token=abcdefgh{k:04d}" for k in range(2000))
    rows = [(1, text), (None, "AKIA" + "A" * 16), (1, text)]
    got = secrets.secrets(clashing(spark, rows)).collect()
    assert sorted(len(r.found) for r in got) == [1, 2000, 2000]
    want = [m.span() for m in re.finditer(r"token=[a-z0-9]+", text)]
    assert [(x.start, x.end) for x in got[0].found] == want or [(x.start, x.end) for x in got[1].found] == want


def test_spans_over_chunks(spark):
    text = "".join("ä" * (k % 3) + "<" + "x" * (k % 5) + ">" for k in range(1000))
    (row,) = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), "<x*>").alias("s")).collect()
    assert [(x.start, x.end, x.match) for x in row.s] == [(m.start(), m.end(), m.group()) for m in re.finditer("<x*>", text)]


# ---- op4


def test_mixing_against_a_plain_schedule(spark):
    draw = random.Random(6)
    rows = [(k if k % 9 else None, " ".join(["w"] * draw.randrange(0, 60)), draw.choice(["a", "b", "c", None])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r["size"], round(r.target, 6), r.taken) for r in mixing.mix_sources(docs).collect())
    keyed = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(17), "doc_id", "text").alias("key")).collect()
    sizes = defaultdict(int)
    for r in keyed:
        sizes[r.source] += len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    # targets: shares by weight, capped at three times the size, the rest shared again
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * share for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    total, bounds, at = sum(target.values()), [], 0.0
    for s in order:
        at += target[s]
        bounds.append((s, min(1 << 32, round(at / total * (1 << 32)))))
    ranks, times = Counter(), Counter()
    blocks_of = {s: -(-sizes[s] // 32) for s in order}
    for i in range(-(-sum(sizes.values()) // 32)):
        point = i * mixing.STEP % (1 << 32)
        s = next((s for s, b in bounds if point < b), order[-1])
        if ranks[s] < 3 * blocks_of[s]:
            times[s, ranks[s] % blocks_of[s]] += 1
        ranks[s] += 1
    want = Counter()
    for s in order:
        own = sorted((r for r in keyed if r.source == s), key=lambda r: ((r.key % (1 << 64) >> 20) % 2048, r.key, r.doc_id is not None, r.doc_id or 0, len(r.text.split())))
        start = 0
        for r in own:
            n = len(r.text.split())
            want[(r.doc_id, n, round(target[s], 6), sum(times[s, p // 32] for p in range(start, start + n)))] += 1
            start += n
    assert got == want


# ---- op5


def test_toxicity_odd_inputs(spark):
    rows = [(k, ("idiot " if k % 3 == 0 else "") + f"some plain text number {k}") for k in range(60)] + [(None, "idiot"), (3, None), (3, ""), (3, "idiot some plain text"), (61, "fine words " * 200_000)]
    docs = clashing(spark, rows)
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.p_severe <= r.p_toxic <= 1 for r in got)
    assert not next(r for r in got if r.doc_id == 61).toxic and {r.toxic for r in got if r.doc_id in (0, 6, None)} == {True}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in toxicity.toxicity(docs, none).collect())
    assert toxicity.toxicity(spark.createDataFrame([], CLASHING), labels).count() == 0


# ---- op6


def test_windows_of_a_large_benchmark(spark):
    words = [f"w{k}" for k in range(20_000)]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, None), (None, "x w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 y"), (3, "")]
    bench = spark.createDataFrame([(1, " ".join(words[100:130])), (2, " ".join(words[19_995:])), (3, " ".join(words[5:15]))], "item_id long, text string")
    docs = clashing(spark, rows)
    small, large = (Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontam.contamination(docs, bench, broadcast_windows=b).collect()) for b in (1000, 0))
    assert small == large == Counter({(1, 20_000, 45, ("1", "2", "3")): 2, (2, 0, 0, ()): 1, (3, 0, 0, ()): 1, (None, 12, 10, ("3",)): 1})
    for b in (1000, 0):
        cut = decontam.without_spans(docs, bench, broadcast_windows=b)
        assert cut.columns == docs.columns
        texts = {r.doc_id: r.text for r in cut.collect()}
        assert texts[None] == "x y" and texts[1].split() == words[:5] + words[15:100] + words[130:19_995] and texts[2] is None and texts[3] == ""
        assert sorted(r.doc_id for r in decontam.without_contaminated(docs, bench, broadcast_windows=b).collect()) == [2, 3]


# ---- op7


def test_ids_of_all_letters():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t, coder = Tokenizer.from_file(path), token_output.Encoder(path)
    points = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    draw = random.Random(8)
    texts = [*points, *[f"a{c}b" for c in points], *["".join(draw.choices(points, k=draw.randrange(1, 12))) for _ in range(4000)], *["".join(draw.choices("aZéŁƎɎß9'sS.,<|>ſK", k=draw.randrange(1, 14))) for _ in range(4000)], "<|endoftext|>", "it's WE'LL x<|startoftext|>y", "İstanbul ΑΣ Σ"]
    ids, sizes = coder.column(pa.array(texts))
    want = t.encode_batch(texts, add_special_tokens=False)
    at = 0
    for text, n, e in zip(texts, sizes.tolist(), want):
        assert ids[at : at + n - 1].tolist() == e.ids, ascii(text)
        at += n


def test_grammar_leaves_no_frequent_pair():
    for seed in range(40):
        draw = np.random.default_rng(seed)
        ids = draw.integers(2, draw.integers(4, 30), draw.integers(1, 3000)).astype(np.uint32)
        ids[draw.random(len(ids)) < 0.02] = 1
        if seed % 3 == 0:
            ids = np.concatenate([np.tile(ids[:50], 30), ids])
        seq, rules, free = token_output.compress(ids, first_free=40, bar=1)
        assert (token_output.expand(seq, rules, free) == ids).all()
        pairs = Counter((a, b) for a, b in zip(seq.tolist(), seq[1:].tolist()) if 1 not in (a, b))
        assert max(pairs.values(), default=0) < token_output.LEAST


def test_token_files_stay_where_they_are_asked_for(spark, tmp_path):
    docs = clashing(spark, [(None, 'say "### or so ' * 30), (3, None), (1, "b"), (1, "a"), (1, "a"), (2, "long " * 300_000)])
    token_output.token_output(docs, tokenizer_path(), 50_000, f"{tmp_path}/tokens").count()
    shards = spark.read.parquet(f"{tmp_path}/tokens")
    got = token_output.read_shards(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 2, 3] and got[-1].n_tokens == 1
    assert sum(r.n_tokens for r in got) == shards.agg(F.sum("n_ids")).first()[0]


# ---- op2, op8


def test_shingles_of_tiny_blocks():
    for texts in (["", "a b c"], ["a", "b"], ["a"], [""], ["a b", "", "c d e f g h"], [" ", None]):
        for width in (1, 2, 5):
            for lo, hi, hashes, at in blocks(pa.array(texts, pa.string())):
                sets, to = shingles(hashes, at, width)
                for k in range(lo, hi):
                    w = (texts[k] or "").split()
                    assert to[k - lo + 1] - to[k - lo] == (len({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))}) if w else 0)


def test_folded_bits_bound_the_difference():
    draw = np.random.default_rng(4)
    sets = [np.sort(draw.choice(1 << 40, draw.integers(1, 400), replace=False).astype(np.uint64)) for _ in range(60)]
    sets += [np.sort(np.concatenate([s[: len(s) * 9 // 10], draw.choice(1 << 40, 3).astype(np.uint64)])) for s in sets]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = near_dup.folded_bits(np.concatenate(sets), at)
    for a in range(len(sets)):
        for b in range(a):
            apart = int(np.bitwise_count(bits[a] ^ bits[b]).sum())
            assert apart <= len(np.setxor1d(sets[a], sets[b]))


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(50, 50), (61, 60), (60, 62)]
    got = {r.id: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 1 for k in range(1, 30)}, **{k: 60 for k in (60, 61, 62)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(5, base), (5, "entirely other words are here"), (7, base + " end"), (8, "entirely other words are here now and then again"), (None, base)]
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(clashing(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (None, 5, None)], key=str)


def test_fingerprints_of_repeated_ids(spark):
    rows = [(1, f"text {k} of one id") for k in range(50)] + [(None, "x"), (None, None), (2, "long " * 200_000)]
    got = simhash.document_fingerprints(clashing(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)


def test_search_tables_are_not_broadcast(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(128) for _ in range(60)]
    near = [b ^ sum(1 << k for k in draw.sample(range(128), n)) for b in base for n in (1, 5, 6, 7, 9)]
    count = {x: k % 3 + 1 for k, x in enumerate(dict.fromkeys(base + near))}
    signed = lambda x: (x - (1 << 64) if x >> 63 else x)
    halves = lambda x: (signed(x >> 64), signed(x & (1 << 64) - 1))
    points = spark.createDataFrame([(*halves(x), n) for x, n in count.items()], "hi long, lo long, n long")
    found = simhash.within_radius(spark.createDataFrame([halves(x) for x in base], "hi long, lo long"), points)
    got = {(r.hi, r.lo): r.n_within for r in found.collect()}
    assert got == {halves(x): sum(n for y, n in count.items() if (x ^ y).bit_count() <= 6) for x in base}
    # an exploded table is len(tables) times what Spark takes it for: it goes through no driver, however small it seems
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


# ---- op9


def test_page_rank_against_plain_iteration(spark):
    draw = np.random.default_rng(9)
    n = 30
    weight = draw.integers(0, 4, (n, n)) * (draw.random((n, n)) < 0.15)
    np.fill_diagonal(weight, 0)
    name = [f"h{k}.test" for k in range(n)]
    edges = spark.createDataFrame([(name[a], name[b], int(weight[a, b])) for a in range(n) for b in range(n) if weight[a, b]], "src string, dst string, n long")
    trust, distrust = np.zeros(n), np.zeros(n)
    trust[:3], distrust[-4:] = 1 / 3, 1 / 4
    seeds = spark.createDataFrame([(name[k], float(trust[k]), float(distrust[k])) for k in range(n) if trust[k] + distrust[k]], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(edges, seeds, tolerance=1e-5).collect()}

    def rank(w, start):
        step = w / np.maximum(w.sum(1, keepdims=True), 1)
        x = start
        for _ in range(300):
            x = 0.15 * start + 0.85 * step.T @ x
        return x

    forward, backward = rank(weight, trust), rank(weight.T, distrust)
    for k in range(n):
        assert got.get(name[k], (0, 0)) == pytest.approx((forward[k], backward[k]), rel=1e-3, abs=1e-9)


def test_urls_odd_inputs(spark):
    rows = [(1, "http://a.com/en/1", None), (1, "http://a.com/en/1", None), (None, "://", "<a href=//x.org/es/>" * 50_000), (2, "", ""), (3, None, "x" * 1_000_000)]
    pages = spark.createDataFrame([(*r, "h", "r", "v") for r in rows], "page_id long, url string, html string, host string, rule string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect())
    assert got == Counter({(1, "a.com", "/en/1", "com/en/", "block"): 2, (None, "", "", None, "allow"): 1, (2, "", "", None, "allow"): 1, (3, "", "", None, "allow"): 1})
    assert url_filter.url_filter(pages.limit(0)).count() == 0
