"""MinHash near-duplicates by tensored banding.

Two small hash collections A and B of ``tables`` keys each are computed; every key joins ``rows``
minhashes. The table keys are all pairs (A_i, B_j): ``tables**2`` tables of ``2 * rows`` minhashes each
out of only ``2 * tables * rows`` minhash computations. A pair of sets of similarity s meets in some
table with probability (1 - (1 - s**rows)**tables)**2, for the defaults 0.9985 at s = 0.8.

Rows of one set are folded into one class first (equal size and 128-bit hash). Classes that meet in a
bucket are compared on their full sets, without making all pairs of a bucket:

* In each of ``STARS`` rounds every bucket that holds several components draws a leader, and its other
  members are compared with it. Confirmed links are joined to components, and buckets with one component
  are done. In the first round a class takes ``FIRST_LEADS`` of its leaders only; later rounds take all.
* What is still open after that is compared pair by pair, but for pairs that can't be links: sets are
  folded to ``BITS`` bits, each the parity of the shingles that fall on it, and two sets differ in at least
  as many shingles as their folded forms in bits. This bound is exact; no link is lost by it.

No bucket is capped and no candidate is dropped that could be a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, parts_for
from ._words import blocks, mix, shingles, tidied
from .components import merged

STARS = 2
FIRST_LEADS = 4
BITS = 1024
_WORDS = [f"b{k}" for k in range(BITS // 64)]
_SEED = 0x5EED


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(_SEED)
    return draw.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def set_keys(sets: np.ndarray, at: np.ndarray, tables: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(2, sets): a 128-bit hash of each non-empty set, and (2 * tables, sets): its collection keys; ``at`` are the sets' offsets."""
    times, plus = _constants(2 * tables * rows)
    starts = at[:-1]
    if not len(starts):
        return np.zeros((2, 0), np.uint64), np.zeros((2 * tables, 0), np.uint64)
    size = np.diff(at).astype(np.uint64)
    whole = np.stack([mix(np.add.reduceat(sets, starts) ^ size), mix(np.add.reduceat(mix(sets), starts) + size)])
    low = np.empty((2 * tables * rows, len(starts)), np.uint64)
    for k in range(len(times)):
        v = sets * times[k]
        v += plus[k]
        np.minimum.reduceat(v, starts, out=low[k])
    keys = np.zeros((2 * tables, len(starts)), np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(31) + low[r::rows] + np.uint64(r + 1))
    return whole, keys


def _content(docs: DataFrame) -> DataFrame:
    """``doc_id`` as bigint, ``t`` (a hash of the text) and ``text``: rows that agree in these are told apart by nothing."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def signatures(docs: DataFrame, width: int, tables: int, rows: int) -> DataFrame:
    """``row, doc_id, t, n, hi, lo, k0 ...`` for each row of ``docs``; ``row`` is unique once this is written."""
    keys = [f"k{k}" for k in range(2 * tables)]

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, hashes, at in blocks(batch.column(2)):
                sets, to = shingles(hashes, at, width)
                sizes = np.diff(to)
                full = np.flatnonzero(sizes)
                whole, own = set_keys(sets, np.append(to[:-1][full], to[-1]), tables, rows)
                wide = np.zeros((2 + 2 * tables, hi - lo), np.uint64)
                wide[:, full] = np.concatenate([whole, own])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int64()), *[pa.array(x.view(np.int64)) for x in wide]], ["row", "doc_id", "t", "n", "hi", "lo", *keys])
                row += hi - lo

    return _content(docs).mapInArrow(tidied(run), "row bigint, doc_id bigint, t bigint, n bigint, hi bigint, lo bigint, " + ", ".join(f"{k} bigint" for k in keys))


def folded_bits(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, BITS / 64): the parity, bit by bit, of the shingles of each set that fall on it."""
    out = np.zeros((len(at) - 1) * len(_WORDS), np.uint64)
    place = mix(sets) % np.uint64(BITS)
    word = np.repeat(np.arange(len(at) - 1), np.diff(at)) * len(_WORDS) + (place >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (place & np.uint64(63)))
    return out.reshape(-1, len(_WORDS))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``(id, s, b0 ...)``: the sorted distinct shingle hashes of each row of ``texts(id, text)``, and their folded bits."""

    def run(batches):
        for batch in batches:
            for lo, hi, hashes, at in blocks(batch.column(1)):
                sets, to = shingles(hashes, at, width)
                bits = folded_bits(sets, to).T
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(sets.view(np.int64))), *[pa.array(x.view(np.int64)) for x in bits]], ["id", "s", *_WORDS])

    return texts.select("id", "text").mapInArrow(tidied(run), "id bigint, s array<bigint>, " + ", ".join(f"{b} bigint" for b in _WORDS))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    near = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    return both.where(near).where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _star(known: DataFrame, turn: int) -> DataFrame:
    """``(id, lead)``: every bucket of ``known(bucket, id, label)`` that holds several labels draws a leader for its members of other labels."""
    # the least id under a mask of the bucket: a member of a large group meets many different leaders
    mask = F.xxhash64("bucket", F.lit(turn))
    drawn = known.groupBy("bucket").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("drawn"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    lead = drawn.select("bucket", F.col("drawn").bitwiseXOR(mask).alias("lead")).join(known.select("bucket", F.col("id").alias("lead"), F.col("label").alias("lead_label")), ["bucket", "lead"])
    return known.join(lead, "bucket").where("label <> lead_label").select("id", "lead").distinct()


def _links(s: Scratch, docs: DataFrame, sig: DataFrame, classes: DataFrame, width: int, percent: int, tables: int) -> DataFrame | None:
    """``(id, label)`` of all classes that are linked with another one; None if no two classes meet."""
    table = F.array(*[F.struct(F.lit(i * tables + j).alias("t"), F.col(f"k{i}").alias("x"), F.col(f"k{tables + j}").alias("y")) for i in range(tables) for j in range(tables)])
    spread = classes.select("id", *[f"k{k}" for k in range(2 * tables)]).repartition(parts_for(docs.sparkSession), "id")
    keyed = spread.select("id", F.explode(table).alias("k")).select(F.xxhash64("k.t", "k.x", "k.y").alias("bucket"), "id")
    shared = s.write(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    members = s.write(keyed.join(shared, "bucket").select("bucket", "id"), "members")
    if not members.limit(1).count():
        return None

    wanted = sig.select(F.col("row").alias("id"), "doc_id", "t").join(members.select("id").distinct(), "id")
    content = _content(docs)
    texts = content.join(wanted, content.doc_id.eqNullSafe(wanted.doc_id) & (content.t == wanted.t)).select("id", "text")
    # repeated rows give the same set; one is kept of each
    sets = s.write(shingle_sets(texts, width).groupBy("id").agg(*[F.first(c).alias(c) for c in ("s", *_WORDS)]), "sets")

    known, label = members.select("bucket", "id", F.col("id").alias("label")), None
    for turn in range(STARS):
        met = _star(known, turn)
        if not turn:
            met = met.groupBy("id").agg(F.collect_set(F.struct(F.xxhash64("lead", "id").alias("draw"), "lead")).alias("leads"))  # at most one a table
            met = met.select("id", F.explode(F.slice(F.array_sort("leads"), 1, FIRST_LEADS))).select("id", "col.lead")
        pairs = met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        label = merged(label, confirmed(pairs, sets, percent), s)
        after = known.select("bucket", "id").join(label, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
        several = after.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        known = s.write(after.join(several, "bucket").select("bucket", "id", "label"), "known")

    able = classes.select("id", "n").join(known.select("id").distinct(), "id").join(sets.drop("s"), "id")
    first = known.groupBy("bucket").agg(F.min("label").alias("first"))
    open_ = s.write(known.join(first, "bucket").join(able, "id"), "open")
    named = lambda side: open_.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "label", "first", *_WORDS)])
    x, y = named("x").where("x_label <> x_first").drop("x_first"), named("y")
    once = (F.col("y_label") == F.col("y_first")) | (F.col("x_id") < F.col("y_id"))
    met = x.join(y, [x.bucket == y.bucket, F.col("x_label") != F.col("y_label"), once, *_may_link(percent)])
    pairs = s.write(met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "pairs", wide=True)
    return merged(label, confirmed(pairs, sets, percent), s)


def _may_link(percent: int) -> list[Column]:
    """What sizes and folded bits allow: sets that differ in d shingles share (n + n' - d) / 2."""
    both = F.col("x_n") + F.col("y_n")
    differ = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in _WORDS), F.lit(0))
    return [100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"), (100 + percent) * (both - differ) >= 2 * percent * both]


def grouped(s: Scratch, docs: DataFrame, shingle_words: int, percent: int, tables: int, rows: int) -> DataFrame:
    """Per row with shingles ``row, doc_id, t, n, label, component_id``, per row without ``row, doc_id, t, 0, row, doc_id``; written.

    ``label`` names the group and is never null; ``component_id`` is the group's least doc_id.
    """
    sig = s.write(signatures(docs, shingle_words, tables, rows), "signatures")
    keys = [f"k{k}" for k in range(2 * tables)]
    folded = sig.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id"), *[F.first(k).alias(k) for k in keys])
    classes = s.write(folded, "classes")
    label = _links(s, docs, sig, classes, shingle_words, percent, tables)
    placed = classes.select("n", "hi", "lo", "id", F.col("doc_id").alias("least"))
    if label is None:
        placed = placed.withColumnRenamed("id", "label")
    else:
        linked = classes.select("id", "doc_id").join(label, "id")
        least = linked.groupBy("label").agg(F.min("doc_id").alias("group_least"))
        member = s.write(linked.join(least, "label").select("id", "label", "group_least"), "linked")
        placed = placed.join(member, "id", "left").select("n", "hi", "lo", F.coalesce("label", "id").alias("label"), F.when(F.col("label").isNotNull(), F.col("group_least")).otherwise(F.col("least")).alias("least"))
    found = sig.where("n > 0").select("row", "doc_id", "t", "n", "hi", "lo").join(placed, ["n", "hi", "lo"]).select("row", "doc_id", "t", "n", "label", F.col("least").alias("component_id"))
    alone = sig.where("n = 0").select("row", "doc_id", "t", "n", F.col("row").alias("label"), F.col("doc_id").alias("component_id"))
    out = s.write(found.union(alone), "grouped")
    s.close(out)
    return out


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, tables: int = 10, rows: int = 3) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A text with fewer words
    than ``shingle_words`` has its whole sequence as one shingle; null, empty and blank texts have
    n_shingles 0 and are linked with nothing. Very long texts are taken whole. Rows are told apart by their
    texts, not by doc_id: rows of one doc_id with different texts may be in different groups, repeated rows
    are one class and give repeated result rows. ``component_id`` is the least doc_id of the group; it is null
    only where no row of the group has one, and ``kept`` is null where the row has none. An empty table gives an
    empty result; other columns, whatever their names, are ignored.
    """
    found = grouped(Scratch(docs.sparkSession), docs, shingle_words, percent, tables, rows)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, tables: int = 10, rows: int = 3) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near duplicates.

    The row with the smallest doc_id stays, rows without one come last, ties go by a hash of the text; of rows that
    agree in doc_id and text one stays. Rows without words are in no group and all stay. Columns are those of ``docs``.
    """
    found = grouped(Scratch(docs.sparkSession), docs, shingle_words, percent, tables, rows)
    best = found.where("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("t").alias("t"))).alias("best"))
    chosen = best.select(F.col("best.id").alias("__telemill_id"), F.col("best.t").alias("__telemill_t"))
    copies = found.where("n > 0").groupBy("doc_id", "t").agg(F.count("*").alias("__telemill_rows"))
    chosen = chosen.join(copies, F.col("__telemill_id").eqNullSafe(copies.doc_id) & (F.col("__telemill_t") == copies.t)).select("__telemill_id", "__telemill_t", "__telemill_rows")
    s = Scratch(docs.sparkSession)
    chosen = s.write(chosen, "chosen")
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    once = docs.where(worded).join(chosen, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__telemill_id")) & (F.xxhash64("text") == F.col("__telemill_t")))
    repeated = once.where("__telemill_rows > 1").dropDuplicates(["__telemill_id", "__telemill_t"])
    return once.where("__telemill_rows = 1").select(*docs.columns).union(repeated.select(*docs.columns)).union(docs.where(~worded))
