"""Toxicity by cumulative-link ordinal regression.

P(severity > k) = sigmoid(w . x - threshold_k): one weight vector shared across ordered thresholds. x holds words
(A-Z lower-cased; runs of letters, digits and non-ASCII characters) and their first 4 to 7 bytes, which stand for
the stems of inflected words. A feature's value is ln(1 + its occurrences per 100 words, with 10 words added to the
text), so that a rare chance hit in a long text weighs little. Weights are fitted with an L1 penalty, so few
features keep one, and none is below zero: a word can raise the severity, but not take back what others say.

Grades from ``labels``: 0 not toxic, 1 toxic, 2 toxic in a text of low quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import written
from ._words import LETTERS, blocks, tidied, tidy

#: at most so many labelled rows are fitted on, chosen by a hash of doc_id; scoring covers every row
FIT_ROWS = 8_000

#: bytes of the prefixes that count as features beside the whole word
STEMS = (4, 5, 6, 7)

#: a feature needs so many rows, and at the start so large a part of the penalty as pull; the L1 penalty itself
LEAST_DF, SCREEN, PENALTY = 5, 0.25, 1e-3

_DAMP = 10
_SLOTS = 1 << 22


def _value(occurrences: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(100 * occurrences / (words + _DAMP))


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted uint64 feature hashes with a weight
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def scores(self, column: pa.Array) -> np.ndarray:
        """w . x of every row."""
        out = np.zeros(len(column))
        if not len(self.words):
            return out
        for lo, hi, hashes, at in blocks(column, LETTERS, STEMS):
            place = np.searchsorted(self.words, hashes)
            place[place == len(self.words)] = 0
            hit = np.flatnonzero(self.words[place] == hashes)
            row = np.searchsorted(at, hit, side="right") - 1
            each, times = np.unique(row * len(self.words) + place[hit], return_counts=True)
            row = each // len(self.words)
            n = np.diff(at)[row] / (1 + len(STEMS))
            out[lo:hi] += np.bincount(row, weights=self.weights[each % len(self.words)] * _value(times, n), minlength=hi - lo)
        return out

    def above(self, scores: np.ndarray) -> np.ndarray:
        """(rows, thresholds): P(severity > k)."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


def _common(rows: list[tuple[np.ndarray, np.ndarray]], least_df: int) -> np.ndarray:
    """Sorted features that at least ``least_df`` and at most half of the rows have; hashed counts come first, to spare memory."""
    seen = np.zeros(_SLOTS, np.uint16)
    slot = lambda words: (words & np.uint64(_SLOTS - 1)).astype(np.int64)
    for words, _ in rows:
        np.add.at(seen, slot(words), 1)
    often = seen >= least_df
    words, df = np.unique(np.concatenate([w[often[slot(w)]] for w, _ in rows]), return_counts=True)
    return words[(df >= least_df) & (df <= 0.5 * len(rows))]


def base_rates(grades: np.ndarray, n_grades: int = 3) -> np.ndarray:
    """Share of the rows above each threshold that the grades reach."""
    k = max(1, min(n_grades - 1, int(grades.max())))
    return np.clip((grades[:, None] > np.arange(k)[None, :]).mean(0), 1e-4, 1 - 1e-4)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = 3, least_df: int = LEAST_DF, penalty: float = PENALTY, rounds: int = 200) -> OrdinalModel:
    """Accelerated proximal gradient on the mean cumulative-link loss; ``rows`` are distinct features of a text and their values."""
    grades = np.asarray(grades)
    highest = int(grades.max()) if len(grades) else 0
    k = max(1, min(n_grades - 1, highest))
    if not len(rows) or highest == 0:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(n_grades - 1, 20.0))
    words = _common(rows, least_df)
    row, col, value = [], [], []
    for r, (x, v) in enumerate(rows):
        place = np.searchsorted(words, x)
        place[place == len(words)] = 0
        own = words[place] == x if len(words) else np.zeros(len(x), bool)
        row.append(np.full(int(own.sum()), r, np.int32))
        col.append(place[own].astype(np.int32))
        value.append(v[own])
    row, col, value = np.concatenate(row), np.concatenate(col), np.concatenate(value).astype(float)
    n, m = len(rows), len(words)
    y = (grades[:, None] > np.arange(k)[None, :]).astype(float)
    rate = base_rates(grades, n_grades)
    t = -np.log(rate / (1 - rate))
    # features that pull towards a weight by far less than the penalty at the start would stay at zero
    pull = np.bincount(col, weights=value * (y - rate).sum(1)[row], minlength=m) / n
    stay = pull >= SCREEN * penalty
    number = np.cumsum(stay) - 1
    inside = stay[col]
    words, row, col, value, m = words[stay], row[inside], number[col[inside]], value[inside], int(stay.sum())
    dot = lambda w: np.bincount(row, weights=value * w[col], minlength=n)
    slope = lambda w, t: (_sigmoid(dot(w)[:, None] - t[None, :]) - y) / n
    w = np.zeros(m)
    vw, vt, speed, step, loss = w.copy(), t.copy(), 1.0, 1.0, np.inf
    for _ in range(rounds):
        g = slope(vw, vt)
        new = np.maximum(vw - step * (np.bincount(col, weights=value * g.sum(1)[row], minlength=m) + penalty), 0)
        nt = np.maximum.accumulate(vt + step * g.sum(0))
        z = dot(new)[:, None] - nt[None, :]
        now = np.mean(np.logaddexp(0, z) - y * z) * k + penalty * new.sum()
        if now > loss:  # restart: shorter steps, no momentum
            step, speed, vw, vt = step * 0.6, 1.0, w.copy(), t.copy()
            if step < 1e-4:
                break
            continue
        after = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        vw, vt = new + (speed - 1) / after * (new - w), nt + (speed - 1) / after * (nt - t)
        w, t, speed, loss = new, nt, after, now
    # the penalty shrinks weights: refit those that are kept, with a slight ridge
    keep = np.flatnonzero(w > 1e-6)
    number = np.full(m, -1)
    number[keep] = np.arange(len(keep))
    inside = number[col] >= 0
    row, col, value, w, words = row[inside], number[col[inside]], value[inside], w[keep], words[keep]
    mw, mt, step = np.zeros(len(w)), np.zeros(k), 0.5
    for _ in range(400):
        g = slope(w, t)
        mw = 0.9 * mw + np.bincount(col, weights=value * g.sum(1)[row], minlength=len(w)) + 1e-3 * w
        mt = 0.9 * mt - g.sum(0)
        w, t = np.maximum(w - step * mw, 0), np.maximum.accumulate(t - step * mt)
    return OrdinalModel(words, w, np.concatenate([t, np.full(n_grades - 1 - k, max(20.0, t[-1]))]))


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` of the labelled rows; rows without doc_id or toxic label have no grade."""
    toxic, low = F.col("toxic").cast("int") > 0, F.coalesce(F.col("quality").cast("int"), F.lit(1)) == 0
    grade = F.when(~toxic, 0).when(low, 2).otherwise(1)
    return labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(grade).cast("int").alias("grade"))


def features(column: pa.Array) -> Iterator[tuple[int, int, list, list]]:
    """(first row, end row, distinct feature hashes a row, their values a row)."""
    for lo, hi, hashes, at in blocks(column, LETTERS, STEMS):
        each = [np.unique(hashes[at[k] : at[k + 1]], return_counts=True) for k in range(hi - lo)]
        n = np.diff(at) / (1 + len(STEMS))
        yield lo, hi, [w.view(np.int64) for w, _ in each], [_value(c, n[k]).astype(np.float32) for k, (_, c) in enumerate(each)]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on at most ``fit_rows`` labelled documents, the first by a hash of doc_id.

    Of rows that share a doc_id one is fitted on. Rows without doc_id are not; null and empty texts have no feature.
    Without labels, or without a toxic one, nothing gets a weight and nothing is toxic.
    """
    chosen = graded(labels).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(fit_rows)

    def run(batches):
        for batch in batches:
            for lo, hi, words, values in features(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(words, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "grade", "words", "values"])

    # fit_rows bounds the broadcast side
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    rows = picked.mapInArrow(tidied(run), "doc_id bigint, grade int, words array<bigint>, values array<float>").groupBy("doc_id", "grade").agg(F.min(F.struct("words", "values")).alias("x")).select("doc_id", "grade", "x.words", "x.values")
    rows = written(rows, "labelled")
    counts = {r.grade: r.n for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # one row a grade
    if max(counts, default=0) == 0:
        return fit([], np.zeros(0, int))
    held = _screened(rows, counts).toArrow()
    order = np.argsort(held.column("doc_id").to_numpy(), kind="stable")  # the fit does not depend on the order of arrival
    words, values = held.column("words"), held.column("values")
    sets = [(np.asarray(words[k].values, np.int64).view(np.uint64), np.asarray(values[k].values, np.float32)) for k in order.tolist()]
    model = fit(sets, held.column("grade").to_numpy()[order].astype(int))
    del held, words, values, sets
    tidy()
    return model


def _screened(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows(doc_id, grade, words, values)`` with those features only that the fit would start with, so few come to the driver."""
    n = sum(counts.values())
    rates = base_rates(np.repeat(list(counts), list(counts.values())))
    weight = F.element_at(F.create_map(*[x for g in counts for x in (F.lit(g), F.lit(float(sum((g > k) - r for k, r in enumerate(rates)))))]), F.col("grade"))
    each = rows.select("doc_id", "grade", F.explode(F.arrays_zip("words", "values")).alias("x")).select("doc_id", "grade", F.col("x.words").alias("word"), F.col("x.values").alias("value"))
    kept = each.groupBy("word").agg(F.count("*").alias("df"), F.sum(F.col("value") * weight).alias("pull"))
    kept = written(kept.where((F.col("df") >= LEAST_DF) & (F.col("df") <= 0.5 * n) & (F.col("pull") / n >= 0.9 * SCREEN * PENALTY)).select("word"), "features")
    own = each.join(kept, "word").groupBy("doc_id", "grade").agg(F.array_sort(F.collect_list(F.struct("word", "value"))).alias("x"))
    none = F.array().cast("array<struct<word:bigint,value:float>>")
    full = rows.select("doc_id", "grade").join(own, ["doc_id", "grade"], "left").withColumn("x", F.coalesce("x", none))
    return full.select("doc_id", "grade", F.transform("x", lambda y: y["word"]).alias("words"), F.transform("x", lambda y: y["value"]).alias("values"))


def _shared(spark: SparkSession, model: OrdinalModel):
    return spark.sparkContext.broadcast((model.words, model.weights, model.thresholds))


def score_toxicity(docs: DataFrame, model: OrdinalModel, cutoff: float = 0.25) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, severity, p_toxic, p_severe, toxic``.

    ``severity`` is the expected grade, the sum of P(severity > k). Null and empty texts have no words and get the
    base rate. Very long texts are scored whole, in blocks. Repeated rows give repeated results, and a null doc_id is
    kept; an empty table gives an empty result. Columns other than doc_id and text are not looked at.
    """
    shared = _shared(docs.sparkSession, model)

    def run(batches):
        own = OrdinalModel(*shared.value)
        for batch in batches:
            above = own.above(own.scores(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, -1]), pa.array(above[:, 0] >= cutoff)], ["doc_id", "severity", "p_toxic", "p_severe", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id bigint, severity double, p_toxic double, p_severe double, toxic boolean")


def is_toxic(spark: SparkSession, text: Column, model: OrdinalModel, cutoff: float = 0.25) -> Column:
    """Whether a text is toxic; only texts go to Python and only the answers come back."""
    shared = _shared(spark, model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = OrdinalModel(*shared.value)
        for x in texts:
            yield pa.array(own.above(own.scores(x))[:, 0] >= cutoff)
        tidy()

    return F.arrow_udf(run, "boolean")(text)


def without_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.25, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model fitted on them and ``labels`` doesn't call toxic, with all their columns.

    Null and empty texts stay, repeated rows share their fate, and rows without doc_id are judged like others.
    """
    return docs.where(~is_toxic(docs.sparkSession, F.col("text"), train(docs, labels, fit_rows), cutoff))


def toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = 0.25, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score all rows: see ``train`` and ``score_toxicity``."""
    return score_toxicity(docs, train(docs, labels, fit_rows), cutoff)
