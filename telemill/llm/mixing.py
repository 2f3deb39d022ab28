"""Mix sources to target weights with a low-discrepancy schedule.

Slot i of the schedule takes the point frac(i * golden ratio) and maps it through the cumulative target
weights to a source, so every stretch of the schedule holds each source close to its weight. A source's
slots are ranked; slot r takes block r mod n of the source's n equal-token blocks, which are cut from its
documents in a shuffled (hashed) order. The r div n-th time is an epoch; there are never more than
``most_epochs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import parts_for, written

#: floor(2**32 / golden ratio): slot i takes the point (i * STEP mod 2**32) / 2**32, in exact integers
STEP = 2654435769
WHOLE = 1 << 32


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], most_epochs: int) -> list[tuple[str | None, int, float]]:
    """``(source, size, target)``: sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most_epochs`` times its source's size and the excess is shared again by weight.

    ``sizes`` has one entry a source: a list of sources is small configuration, not data.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = [weights[k % len(weights)] for k in range(len(order))]
    total = sum(n for _, n in order)
    target: dict[int, float] = {}
    free = list(range(len(order)))
    left = float(total)
    while free:
        share = left / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * share > most_epochs * order[k][1]]
        for k in over or free:
            target[k] = float(most_epochs * order[k][1]) if over else weight[k] * share
        if not over:
            break
        left -= sum(target[k] for k in over)
        free = [k for k in free if k not in over]
    return [(s, n, target[k]) for k, (s, n) in enumerate(order)]


def schedule(spark, shares: list[tuple[int, float]], slots: int, chunk: int = 1 << 16) -> DataFrame:
    """``(source_no, rank)`` of ``slots`` slots; ranks count up from 0 in each source, in slot order."""
    at, bounds = 0.0, []
    total = sum(t for _, t in shares) or 1.0
    for k, t in shares:
        at += t
        bounds.append((k, min(WHOLE, round(at / total * WHOLE))))
    bounds[-1] = (bounds[-1][0], WHOLE)
    low = F.col("id").bitwiseAND(F.lit(65535)) * F.lit(STEP)  # id * STEP mod 2**32 in halves, as the product can pass 2**63
    high = (F.shiftright("id", 16).bitwiseAND(F.lit(65535)) * F.lit(STEP)).bitwiseAND(F.lit(65535)) * F.lit(65536)
    point = (low + high).bitwiseAND(F.lit(WHOLE - 1))
    source = F.coalesce(*[F.when(point < F.lit(b), F.lit(k)) for k, b in bounds])
    drawn = spark.range(0, slots, 1, max(1, min(parts_for(spark) * 4, slots // chunk + 1))).select("id", F.expr(f"id div {chunk}").alias("chunk"), source.alias("source_no"))
    counted = written(drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n")), "slot_counts")
    before = counted.select("source_no", "chunk", (F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("n")).alias("base"))
    ranked = drawn.select("source_no", "chunk", (F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("id")) - 1).alias("own"))
    return ranked.join(before, ["source_no", "chunk"]).select("source_no", (F.col("base") + F.col("own")).alias("rank"))


def words_of(text) -> object:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


ROW = "__telemill_row"


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3, block_tokens: int = 32, seed: int = 17, ranges: int = 2048) -> DataFrame:
    """Per row of ``docs(doc_id, text, source, ...)``: ``doc_id, size, source_size, target, taken``.

    ``taken`` counts the words that the mix takes from the row, repeats counted, at most ``most_epochs`` times
    its size. A null source is a source of its own, the last. Rows without words take part with size 0. Rows that
    agree in doc_id and text are told apart by their place only. An empty table gives an empty result. Other columns
    are not looked at. Reruns agree, as the order is hashed from doc_id and text and all arithmetic is exact.
    """
    return _mixed(docs.withColumn(ROW, F.monotonically_increasing_id()), weights, most_epochs, block_tokens, seed, ranges).drop(ROW)


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """Every row of ``docs`` as many times as the mix takes it: its taken words over its size, rounded half up.

    Each row has its own key, made once, so null ids and repeated rows are mixed like any other. Rows without words
    are not taken. ``settings`` and the rest are as in ``mix_sources``.
    """
    keyed = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    times = F.expr("cast((2 * taken + size) div (2 * size) as int)")
    taken = _mixed(keyed, **settings).where("taken > 0").select(F.col(ROW), times.alias("__telemill_times")).where("__telemill_times > 0")
    each = keyed.join(written(taken, "taken"), ROW)
    return each.withColumn("__telemill_copy", F.explode(F.sequence(F.lit(1), F.col("__telemill_times")))).select(*docs.columns)


def _mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3, block_tokens: int = 32, seed: int = 17, ranges: int = 2048) -> DataFrame:
    """``mix_sources`` with the column ``ROW`` of ``docs``."""
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = written(docs.select(ROW, "doc_id", F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), key.alias("key")), "sized")
    per_source = [(r.source, r.size) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    if not per_source:
        return sized.select(ROW, "doc_id", "size", F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("taken"))
    plan = targets(per_source, weights, most_epochs)
    number = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(k)) for k, (s, _, _) in enumerate(plan)])
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("source_no") + 1)

    # place of every row in its source's shuffled stream: a prefix sum over hash ranges, then inside each range
    numbered = sized.withColumn("source_no", number).withColumn("range", F.expr(f"cast(shiftrightunsigned(key, 20) % {ranges} as int)"))
    sums = written(numbered.groupBy("source_no", "range").agg(F.sum("size").alias("n")), "range_sums")
    base = sums.select("source_no", "range", (F.sum("n").over(Window.partitionBy("source_no").orderBy("range")) - F.col("n")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source_no", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = numbered.select(ROW, "doc_id", "size", "source_no", "range", inside.alias("own")).join(base, ["source_no", "range"]).select(ROW, "doc_id", "size", "source_no", (F.col("base") + F.col("own")).alias("start"))
    placed = written(placed, "placed")

    blocks = {k: -(-n // block_tokens) for k, (_, n, _) in enumerate(plan)}
    total = sum(n for _, n, _ in plan)
    slots = schedule(spark, [(k, t) for k, (_, _, t) in enumerate(plan)], -(-total // block_tokens)) if total else None
    spans = placed.where("size > 0").select(ROW, "source_no", "start", (F.col("start") + F.col("size")).alias("end"), F.explode(F.sequence(F.expr(f"start div {block_tokens}"), F.expr(f"(start + size - 1) div {block_tokens}"))).alias("block"))
    overlap = F.least(F.col("end"), (F.col("block") + 1) * block_tokens) - F.greatest(F.col("start"), F.col("block") * block_tokens)
    if slots is None:
        taken = placed.select(ROW, F.lit(0).cast("bigint").alias("taken")).limit(0)
    else:
        n_blocks = pick([blocks[k] for k in range(len(plan))]).cast("bigint")
        times = slots.withColumn("n_blocks", n_blocks).where(F.col("rank") < most_epochs * F.col("n_blocks")).groupBy("source_no", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("times"))
        taken = spans.select(ROW, "source_no", "block", overlap.alias("words")).join(times, ["source_no", "block"]).groupBy(ROW).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = placed.join(taken, ROW, "left")
    return out.select(ROW, "doc_id", "size", pick([n for _, n, _ in plan]).cast("bigint").alias("source_size"), pick([t for _, _, t in plan]).alias("target"), F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
