"""Document fingerprints: 128-bit SimHash, and permuted block tables for search within a Hamming radius.

Terms are adjacent word pairs (weight 1 + ln count) and single words (a quarter of that, which matters
only for very short texts). Each term's 128-bit hash votes with its weight on every bit. The fingerprint
is cut into ``blocks`` blocks; for a radius r any two fingerprints that close agree in at least
``blocks - r`` whole blocks, so one table for each pair of blocks finds them all when blocks - r >= 2.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import parts_for, written
from ._words import blocks, mix

BITS = 128


def fingerprints(column: pa.Array) -> np.ndarray:
    """(rows, 2) uint64. A text without words has fingerprint 0; words are runs without ASCII white space, A-Z lower-cased."""
    out = np.zeros((len(column), 2), np.uint64)
    for lo, hi, hashes, at in blocks(column):
        for k in range(hi - lo):
            w = hashes[at[k] : at[k + 1]]
            if len(w):
                out[lo + k] = _fingerprint(w)
    return out


def _fingerprint(w: np.ndarray) -> np.ndarray:
    votes = np.zeros(BITS, np.float64)
    for terms, scale in ((w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:], 1.0), (w, 0.25)):
        terms = np.sort(terms)
        fresh = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else terms
        if not len(terms):
            continue
        weight = (1 + np.log(np.diff(np.append(fresh, len(terms))))).astype(np.float32) * np.float32(scale)
        for a in range(0, len(fresh), 1 << 12):
            x = mix(terms[fresh[a : a + (1 << 12)]])
            raw = np.stack([x, mix(x + np.uint64(0x51ED270B))], 1)
            bits = np.unpackbits(raw.view(np.uint8), axis=1)
            y = weight[a : a + (1 << 12)]
            votes += 2.0 * (y @ bits.astype(np.float32)) - y.sum(dtype=np.float64)
    return np.packbits(votes > 0).view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hex(fp: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in fp]


def _neighbour_rows(texts: list[str], after: list[str], own: np.ndarray, following: np.ndarray) -> dict[str, list]:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
    fp = np.concatenate([fingerprints(pa.array(edited[k : k + 256], pa.string())) for k in range(0, len(edited), 256)]) if edited else np.zeros((0, 2), np.uint64)
    return {"edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited], "edited_fingerprint": _hex(fp), "near_edited": likeness(own, fp).tolist(), "near_next": likeness(own, following).tolist()}


_ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hi bigint, lo bigint, part int, place string, text string"


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint every row of ``docs(doc_id, text, ...)`` and its text edited with the next document's.

    Order: descending doc_id, nulls last, ties by a hash of the text. Texts move once, range-partitioned; inside a
    partition a task streams over its sorted rows and holds one batch. Only the first and the last row
    of each partition keep their text, and are completed by joining each last row to the first row of
    the next partition that has rows.
    """
    spark = docs.sparkSession

    def run(batches):
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        fps = np.zeros((0, 2), np.uint64)
        first = True

        def rows(n, place, after, following):
            own = fps[:n]
            done = _neighbour_rows(texts[:n], after, own, following) if place == "row" else {k: [None] * n for k in ("edited_sha256", "edited_fingerprint", "near_edited", "near_next")}
            words = own.view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(done["edited_sha256"], pa.string()), pa.array(_hex(own)), pa.array(done["edited_fingerprint"], pa.string()), pa.array(done["near_edited"], pa.float64()), pa.array(done["near_next"], pa.float64()), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array([part] * n, pa.int32()), pa.array([place] * n), pa.array([None if place == "row" else t for t in texts[:n]], pa.string())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "hi", "lo", "part", "place", "text"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = ids + piece.column(0).to_pylist()
                texts = texts + [t or "" for t in piece.column(1).to_pylist()]
                fps = np.concatenate([fps, fingerprints(piece.column(1))])
                if first:
                    yield rows(1, "first", None, None)
                    first = False
                if len(texts) > 1:
                    yield rows(len(texts) - 1, "row", texts[1:], fps[1:])
                ids, texts, fps = ids[-1:], texts[-1:], fps[-1:]
        if texts:
            yield rows(1, "last", None, None)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    by = F.col("doc_id").desc_nulls_last()
    # rows that share an id are spread by the hash of their text
    ordered = rows.repartitionByRange(parts_for(spark), by, "t").sortWithinPartitions(by, "t").select("doc_id", "text")
    return written(ordered.mapInArrow(run, _ROW), "fingerprints")


def _ends(found: DataFrame) -> DataFrame:
    """The last row of every partition, completed with the first row of the next; two rows a partition."""
    import pandas as pd
    from pyspark.sql import Window

    first = found.where("place = 'first'").select(F.col("part").alias("at"), F.col("text").alias("next_text"), F.col("hi").alias("next_hi"), F.col("lo").alias("next_lo"))
    order = Window.orderBy("at")  # one small row a partition: no texts pass through the window
    after = first.select("at").select(F.col("at").alias("part"), F.coalesce(F.lead("at").over(order), F.min("at").over(Window.partitionBy())).alias("at"))
    paired = found.where("place = 'last'").join(after, "part").join(first, "at")

    def run(frames):
        for f in frames:
            own, following = f[["hi", "lo"]].to_numpy(np.int64).view(np.uint64), f[["next_hi", "next_lo"]].to_numpy(np.int64).view(np.uint64)
            done = _neighbour_rows(f.text.tolist(), f.next_text.tolist(), own, following)
            yield f.assign(**{k: pd.Series(v, index=f.index) for k, v in done.items()})[["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "hi", "lo"]]

    return paired.mapInPandas(run, _ROW[: _ROW.index(", part")])


def within_radius(queries: DataFrame, points: DataFrame, radius: int = 6, n_blocks: int = 8) -> DataFrame:
    """Per query fingerprint ``(hi, lo)``: ``n_within`` = sum of ``n`` over ``points(hi, lo, n)`` at most ``radius`` bits away.

    Both inputs hold distinct fingerprints. ``n_blocks - radius`` must be 2 or more. Two fingerprints that
    meet in several tables are counted in the first of them, so no pair has to be made twice or removed.
    """
    if n_blocks - radius < 2 or BITS % n_blocks:
        raise ValueError("blocks - radius must be at least 2, and blocks must divide the bits")
    width = BITS // n_blocks
    half = n_blocks // 2
    block = lambda hi, lo, k: F.shiftrightunsigned(hi if k < half else lo, width * (k % half)).bitwiseAND(F.lit((1 << width) - 1))
    tables = list(combinations(range(n_blocks), 2))

    def keyed(df, name):
        hi, lo = F.col("hi"), F.col("lo")
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.shiftleft(block(hi, lo, i), width).bitwiseOR(block(hi, lo, j)).alias("key")) for t, (i, j) in enumerate(tables)])
        own = [c for c in df.columns if c not in ("hi", "lo")]
        return df.select(F.col("hi").alias(f"{name}_hi"), F.col("lo").alias(f"{name}_lo"), *own, F.explode(keys).alias("k")).select(F.shiftleft(F.col("k.t").cast("bigint"), 2 * width).bitwiseOR(F.col("k.key")).alias("slot"), f"{name}_hi", f"{name}_lo", *own)

    q, p = keyed(queries.select("hi", "lo"), "q"), keyed(points.select("hi", "lo", "n"), "p")
    dh, dl = F.col("q_hi").bitwiseXOR(F.col("p_hi")), F.col("q_lo").bitwiseXOR(F.col("p_lo"))
    same = [block(dh, dl, k) == 0 for k in range(n_blocks)]
    first_table = F.coalesce(*[F.when(same[i] & same[j], F.lit(t)) for t, (i, j) in enumerate(tables)])
    close = F.bit_count(dh) + F.bit_count(dl) <= radius
    # sizes are estimated without the explode's factor of len(tables), so Spark would broadcast sides of many times its threshold
    met = q.join(p.hint("merge"), [q.slot == p.slot, close, first_table == F.shiftrightunsigned(q.slot, 2 * width)])
    return met.groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("n").alias("n_within"))


def document_fingerprints(docs: DataFrame, radius: int = 6, n_blocks: int = 8, query_every: int = 20) -> DataFrame:
    """Fingerprints of all rows of ``docs(doc_id, text, ...)`` with the neighbour search.

    ``n_within``: for rows whose doc_id is divisible by ``query_every``, the number of documents (itself and
    equal texts included) whose fingerprint is within ``radius`` bits; null for the others. Null and empty texts
    have fingerprint 0. A null doc_id comes last in the order. Repeated rows give repeated results; a single
    row is its own next document; an empty table gives an empty result.
    """
    found = with_next(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "hi", "lo"]
    rows = written(found.where("place = 'row'").select(*names).union(_ends(found).select(*names)), "rows")
    points = written(rows.groupBy("hi", "lo").agg(F.count("*").alias("n")), "points")
    asked = F.col("doc_id") % query_every == 0
    near = written(within_radius(rows.where(asked).select("hi", "lo").distinct(), points, radius, n_blocks), "near")
    plain = rows.where(~asked | F.col("doc_id").isNull()).withColumn("n_within", F.lit(None).cast("bigint"))
    searched = rows.where(asked).join(near, ["hi", "lo"], "left").select(*names, "n_within")
    return plain.union(searched).drop("hi", "lo")
