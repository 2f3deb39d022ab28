"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Every token is predicted from the two tokens before and the two after it: their position-specific embeddings are
added, passed through tanh, and a two-level softmax (class, then word in class) gives its conditional probability.
A document's score is the sum of the conditional log-probabilities of its tokens.

The vocabulary is every word with at least ``LEAST`` occurrences and a ``SHARE`` of all tokens, and the network is
sized to it. Any other word falls into one of at least ``RARE`` hashed entries, and its probability is that of the
entry times the word's own share of the entry's tokens in the corpus, so each token is predicted itself. The counts
of those words stay a table, which is joined; they are never gathered. Training is data-parallel over all tokens of all documents: each task starts from the broadcast
network, trains on its rows, and sends its parameters; they are averaged on the executors, weighted by tokens,
in a tree whose every node takes ``FAN_IN`` networks, so no task's memory grows with the number of tasks. Half of the tokens are trained on in each of two rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written
from ._words import SPACE, blocks

LEAST = 32
SHARE = 5e-5  # bounds the vocabulary by 1 / SHARE words; what is rarer has no hot join key
RARE = 256
WIDTH = 12
OFFSETS = (-2, -1, 1, 2)
PAD = -1  # the last embedding
_BATCH = 16384


def n_classes(words: int) -> int:
    """A power of two near the root of the number of entries."""
    return 1 << max(2, round(np.log2(words + RARE) / 2))


def n_rare(words: int) -> int:
    """Hashed entries: ``RARE`` and what fills the last class."""
    return RARE + -(words + RARE) % n_classes(words)


def start(words: int, seed: int = 7) -> dict[str, np.ndarray]:
    """The network for a vocabulary of ``words`` words."""
    classes, entries = n_classes(words), words + n_rare(words)
    draw = np.random.default_rng(seed)
    return {
        "embed": (draw.normal(size=(len(OFFSETS), entries + 1, WIDTH)) * 0.3).astype(np.float32),
        "bias": np.zeros(WIDTH, np.float32),
        "classes": (draw.normal(size=(classes, WIDTH + 1)) * 0.1).astype(np.float32),
        "words": (draw.normal(size=(classes, entries // classes, WIDTH + 1)) * 0.1).astype(np.float32),
    }


def token_ids(hashes: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """0..len(vocabulary)-1 by frequency, then a hashed entry."""
    out = (len(vocabulary) + (hashes >> np.uint64(7)) % np.uint64(n_rare(len(vocabulary)))).astype(np.int64)
    if len(vocabulary):
        place = np.searchsorted(vocabulary, hashes)
        place[place == len(vocabulary)] = 0
        hit = vocabulary[place] == hashes
        out[hit] = rank[place[hit]]
    return out


def windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(offsets, tokens): the neighbours of each token inside its row; PAD beyond its ends."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(ids))
    out = np.full((len(OFFSETS), len(ids)), PAD)
    for k, d in enumerate(OFFSETS):
        to = place + d
        ok = (to >= at[row]) & (to < at[row + 1])
        out[k, ok] = ids[to[ok]]
    return out


def _by_class(kind: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    return np.argsort(kind.astype(np.uint8), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=classes))])


def _softmax(z: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def forward(net: dict, near: np.ndarray) -> np.ndarray:
    """(WIDTH + 1, tokens): hidden units and a constant."""
    h = net["embed"][0].take(near[0], 0)
    for k in range(1, len(OFFSETS)):
        h += net["embed"][k].take(near[k], 0)
    h += net["bias"]
    out = np.ones((WIDTH + 1, len(h)), np.float32)
    np.tanh(h.T, out=out[:WIDTH])
    return out


def log_probs(net: dict, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Conditional log-probability of each token given both sides."""
    out = np.empty(len(ids), np.float32)
    classes = len(net["classes"])
    for a in range(0, len(ids), _BATCH):
        own, h = ids[a : a + _BATCH], forward(net, near[:, a : a + _BATCH])
        kind = own % classes
        order, ends = _by_class(kind, classes)
        own, kind, h = own[order], kind[order], h.take(order, 1)
        z = net["classes"] @ h
        p = z[kind, np.arange(len(own))] - np.log(np.exp(np.minimum(z, 60, out=z), out=z).sum(0))
        for c in range(classes):
            x = slice(ends[c], ends[c + 1])
            if ends[c + 1] > ends[c]:
                q = net["words"][c] @ h[:, x]
                p[x] += q[own[x] // classes, np.arange(ends[c + 1] - ends[c])] - np.log(np.exp(np.minimum(q, 60, out=q), out=q).sum(0))
        out[a + order] = p
    return out


def train_step(net: dict, ids: np.ndarray, near: np.ndarray, rate: float) -> None:
    """One step of gradient descent on the tokens given; the step of an embedding is scaled by its own count."""
    n, classes, entries = len(ids), len(net["classes"]), net["embed"].shape[1]
    order, ends = _by_class(ids % classes, classes)
    ids, near = ids[order], near[:, order] % entries
    kind = ids % classes
    h = forward(net, near)
    d = _softmax(net["classes"] @ h)
    d[kind, np.arange(n)] -= 1
    dh = net["classes"].T @ d
    net["classes"] -= rate / n * (d @ h.T)
    for c in range(classes):
        x, m = slice(ends[c], ends[c + 1]), ends[c + 1] - ends[c]
        if m:
            g = _softmax(net["words"][c] @ h[:, x])
            g[ids[x] // classes, np.arange(m)] -= 1
            dh[:, x] += net["words"][c].T @ g
            net["words"][c] -= rate / m * (g @ h[:, x].T)
    dh = (dh * (1 - h * h))[:WIDTH]
    net["bias"] -= rate * dh.mean(1)
    for k in range(len(OFFSETS)):
        each = rate / (np.bincount(near[k], minlength=entries) + 8.0)
        for j in range(WIDTH):
            net["embed"][k][:, j] -= (each * np.bincount(near[k], weights=dh[j], minlength=entries)).astype(np.float32)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word of all documents."""

    def count(batches):
        for batch in batches:
            for _, _, hashes, _ in blocks(batch.column(0), SPACE):
                words, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return written(docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word_counts")


def _floor(counts: DataFrame) -> float:
    return max(LEAST, SHARE * (counts.agg(F.sum("n")).first()[0] or 0))


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words of the vocabulary, and their ranks by frequency."""
    top = [r.word for r in counts.where(F.col("n") >= _floor(counts)).orderBy(F.desc("n"), "word").collect()]
    words = np.array(top, np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], order


def flat(net: dict) -> np.ndarray:
    return np.concatenate([x.ravel() for x in net.values()])


def unflat(values: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, x in like.items():
        out[k] = values[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


#: networks that one task averages
FAN_IN = 64


def _average(sent: DataFrame, schema: str) -> DataFrame:
    """``(part, group, weight, values)`` with the weighted mean of each ``FAN_IN`` neighbouring groups."""

    def mean(key_, table):
        weight, total = 0.0, 0.0
        for batch in table.to_batches():
            for w, values in zip(batch.column("weight").to_pylist(), batch.column("values")):
                total = total + np.asarray(values.values, np.float32).astype(np.float64) * w
                weight += w
        return pa.table({"part": pa.array([key_[0].as_py()], pa.int32()), "group": pa.array([key_[1].as_py()], pa.int32()), "weight": pa.array([weight]), "values": pa.array([(total / weight).astype(np.float32)], pa.list_(pa.float32()))})

    return sent.withColumn("group", F.floor(F.col("group") / FAN_IN).cast("int")).groupBy("part", "group").applyInArrow(mean, schema)


def train(docs: DataFrame, counts: DataFrame | None = None, rounds: int = 2, rate: float = 1.0, block: int = 8192) -> tuple[np.ndarray, np.ndarray, dict]:
    """The vocabulary and the network; an empty corpus leaves the network at its start."""
    spark = docs.sparkSession
    words, rank = vocabulary(word_counts(docs) if counts is None else counts)
    net = start(len(words))
    schema = "part int, group int, weight double, values array<float>"
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((words, rank, net))

        def run(batches, shared=shared, turn=turn):
            words, rank, given = shared.value
            own = {k: x.copy() for k, x in given.items()}
            seen, step = 0, 0
            held: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0
            for batch in batches:
                for _, _, hashes, at in blocks(batch.column(0), SPACE):
                    ids = token_ids(hashes, words, rank)
                    near = windows(ids, at)
                    mine = np.flatnonzero((np.arange(len(ids)) // 64) % rounds == turn)
                    held.append((ids[mine], near[:, mine]))
                    waiting += len(mine)
                    while waiting >= _BATCH:
                        ids, near = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], 1)
                        train_step(own, ids[:_BATCH], near[:, :_BATCH], rate / (1 + 0.01 * step) ** 0.5)
                        step += 1
                        held, waiting = [(ids[_BATCH:], near[:, _BATCH:])], len(ids) - _BATCH
                        seen += _BATCH
            if waiting:
                train_step(own, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], 1), rate / (1 + 0.01 * step) ** 0.5)
                seen += waiting
            if seen:
                values, task = flat(own), TaskContext.get().partitionId()
                for part, a in enumerate(range(0, len(values), block)):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([float(seen)]), pa.array([values[a : a + block]], pa.list_(pa.float32()))], ["part", "group", "weight", "values"])

        sent = docs.select("text").mapInArrow(run, schema)
        level = written(_average(sent, schema), "average")
        while (level.agg(F.max("group")).first()[0] or 0) > 0:
            level = written(_average(level, schema), "average")
        final = level.select("part", "values").collect()  # one network, bounded by SHARE
        if final:
            net = unflat(np.concatenate([np.asarray(r["values"], np.float32) for r in sorted(final, key=lambda r: r["part"])]), net)
    return words, rank, net


def score(docs: DataFrame, counts: DataFrame, words: np.ndarray, rank: np.ndarray, net: dict) -> DataFrame:
    """``doc_id, n_tokens, pseudo_log_likelihood, per_token`` of each row; ``counts`` are those of the corpus that holds ``docs``."""
    rare = n_rare(len(words))
    outside = counts.where(F.col("n") < _floor(counts))
    entry = (F.shiftrightunsigned("word", 7) % rare).alias("entry")
    log_n = np.zeros(len(words) + rare)
    for r in outside.groupBy(entry).agg(F.sum("n").alias("n")).collect():  # as many rows as there are entries
        log_n[len(words) + r.entry] = np.log(r.n)
    shared = docs.sparkSession.sparkContext.broadcast((words, rank, net, log_n))

    def run(batches):
        words, rank, net, log_n = shared.value
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, hashes, at in blocks(batch.column(1), SPACE):
                ids = token_ids(hashes, words, rank)
                p = np.concatenate([[0.0], np.cumsum(log_probs(net, ids, windows(ids, at)) - log_n[ids], dtype=np.float64)])
                total, n = p[at[1:]] - p[at[:-1]], np.diff(at)
                own = ids >= len(words)
                upto = np.concatenate([[0], np.cumsum(own)])[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + hi - lo)), batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(total), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(hashes[own].view(np.int64)))], ["key", "doc_id", "n_tokens", "total", "words"])
                key += hi - lo

    rows = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "key bigint, doc_id bigint, n_tokens bigint, total double, words array<bigint>"), "scored")
    # a word that occurs once adds log(1)
    found = rows.select("key", F.explode("words").alias("word")).join(outside.where("n > 1"), "word").groupBy("key").agg(F.sum(F.log("n")).alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    return rows.drop("words").join(found, "key", "left").select("doc_id", "n_tokens", total.alias("pseudo_log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"))


def lm_score(docs: DataFrame) -> DataFrame:
    """Train on all rows of ``docs(doc_id, text, ...)`` and score them all.

    Null, empty and blank texts have no token: n_tokens 0, score 0, per_token null. Repeated rows and null ids
    give a result row each; equal texts have equal scores. An empty table gives an empty result. A text longer
    than the block size is scored whole.
    """
    counts = word_counts(docs)
    return score(docs, counts, *train(docs, counts))
