"""Benchmark decontamination: windows of training tokens against a hash set of benchmark n-grams.

Benchmark items are normalised to words; their n-word windows (an item of fewer words is one window) form a
table keyed by a 64-bit hash. Each document's windows are hashed where they stand, looked up, and a hit is verified on
the words. Where the table is within ``broadcast_windows`` rows and ``BROADCAST_BYTES`` it is broadcast. Beyond that the
hashes alone are shuffled to it, and what is found goes back to the document, to be verified there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BROADCAST_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text) -> object:
    """A-Z lower-cased; runs of digits, letters and non-ASCII characters. Null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """``(width, key, phrase, window_no, item_id)``: one row for each item and distinct window of it."""
    split = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = split.select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("width")).select("item_id", "w", "width", F.explode(F.expr("sequence(1, size(w) - width + 1)")).alias("at"))
    phrase = F.slice("w", F.col("at"), F.col("width"))
    return cut.select("width", F.xxhash64(phrase).alias("key"), F.array_join(phrase, " ").alias("phrase"), F.xxhash64(F.array_join(phrase, " "), F.lit(1)).alias("window_no"), "item_id").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_windows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """``(per document, window to item)``.

    Per distinct ``(doc_id, text)``: ``doc_id, doc_key, n_words, copies, covered, windows`` where ``covered`` is the
    array of (start, width) in words of all occurring windows and ``windows`` the set of their numbers.
    """
    table = written(benchmark_windows(benchmark, width), "benchmark_windows")
    lookup = table.select("width", "key", "phrase", "window_no").distinct()
    lengths = sorted(r.width for r in table.select("width").distinct().collect()) or [width]  # at most ``width`` values
    held = lookup.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("phrase") + 32), F.lit(0)).alias("bytes")).first()
    split = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), words(F.col("text")).alias("w"))
    find = _looked_up if held.n <= broadcast_windows and held.bytes <= BROADCAST_BYTES else _shuffled
    return find(split, lookup, lengths), table.select("window_no", "item_id").distinct()


def _looked_up(split: DataFrame, lookup: DataFrame, lengths: list[int]) -> DataFrame:
    """The windows of ``split(doc_id, doc_key, w)`` in a broadcast table, in one pass."""
    # position 0 stands for the document itself, so documents without hits stay in the same pass
    at = split.select("doc_id", "doc_key", "w", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    if len(lengths) > 1:
        at = at.select("*", F.explode(F.array(*[F.lit(k) for k in lengths])).alias("width"))
        at = at.where(((F.col("at") == 0) & (F.col("width") == lengths[0])) | ((F.col("at") > 0) & (F.col("at") + F.col("width") - 1 <= F.col("n_words"))))
    else:
        at = at.withColumn("width", F.lit(lengths[0])).where((F.col("at") == 0) | (F.col("at") + F.col("width") - 1 <= F.col("n_words")))
    window = F.slice("w", F.greatest(F.col("at"), F.lit(1)), F.when(F.col("at") == 0, F.lit(0)).otherwise(F.col("width")))
    keyed = at.select("doc_id", "doc_key", "n_words", "at", F.col("width").alias("own_width"), "w", F.when(F.col("at") > 0, F.xxhash64(window)).alias("own_key"))
    same = (F.col("own_key") == F.col("key")) & (F.col("own_width") == F.col("width")) & (F.array_join(F.slice("w", F.greatest(F.col("at"), F.lit(1)), F.col("own_width")), " ") == F.col("phrase"))
    met = keyed.join(F.broadcast(lookup), same, "left").where((F.col("at") == 0) | F.col("key").isNotNull())
    return met.groupBy("doc_id", "doc_key", "n_words").agg(
        F.count(F.when(F.col("at") == 0, 1)).alias("copies"),
        F.collect_set(F.when(F.col("at") > 0, F.struct(F.col("at").alias("start"), F.col("own_width").alias("width")))).alias("covered"),
        F.collect_set("window_no").alias("windows"),
    )


def _shuffled(split: DataFrame, lookup: DataFrame, lengths: list[int]) -> DataFrame:
    """The same with any table: a position is sent as its hash, and the words stay with the document."""
    # the windows of one length of a text, as (place, length, hash)
    hashed = lambda k: F.transform(F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - k + 1)).otherwise(F.array().cast("array<int>")), lambda at: F.struct(at.alias("at"), F.lit(k).alias("width"), F.xxhash64(F.slice("w", at, k)).alias("key")))
    sent = split.select("doc_id", "doc_key", F.explode(F.concat(*[hashed(k) for k in lengths])).alias("x")).select("doc_id", "doc_key", "x.at", "x.width", "x.key")
    met = sent.join(lookup.hint("merge"), ["key", "width"]).groupBy(F.col("doc_id").alias("met_id"), F.col("doc_key").alias("met_key")).agg(F.collect_set(F.struct("at", "width", "phrase", "window_no")).alias("maybe"))
    each = split.join(met, (F.col("doc_key") == F.col("met_key")) & F.col("doc_id").eqNullSafe(F.col("met_id")), "left")
    true = F.filter(F.coalesce("maybe", F.array().cast("array<struct<at:int,width:int,phrase:string,window_no:bigint>>")), lambda x: F.array_join(F.slice("w", x["at"], x["width"]), " ") == x["phrase"])
    verified = each.select("doc_id", "doc_key", F.size("w").alias("n_words"), true.alias("true"))
    told = verified.select("doc_id", "doc_key", "n_words", F.array_distinct(F.transform("true", lambda x: F.struct(x["at"].alias("start"), x["width"].alias("width")))).alias("covered"), F.array_distinct(F.transform("true", lambda x: x["window_no"])).alias("windows"))
    return told.groupBy("doc_id", "doc_key", "n_words").agg(F.count("*").alias("copies"), F.first("covered").alias("covered"), F.first("windows").alias("windows"))


def covered_words(covered) -> object:
    """Number of words inside any of the (start, width) windows."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, x):
        end = F.greatest(acc["end"], x["start"] + x["width"] - 1)
        return F.struct(end.alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"] - 1))).alias("n"))

    return F.aggregate(F.array_sort(covered), start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_windows: int = 1_000_000) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, n_words, n_hit, n_items, item_ids, contaminated``.

    Null and empty texts have no words; items without words have no window, and an empty benchmark hits nothing.
    ``item_ids`` are the items with an occurring window, as strings, sorted. Repeated rows repeat their result; a
    null doc_id is kept, a null item_id counts as no item.
    """
    per, items = hits(docs, benchmark, width, broadcast_windows)
    per = written(per, "contamination")
    named = per.where(F.size("windows") > 0).select("doc_id", "doc_key", F.explode("windows").alias("window_no")).join(items.where("item_id is not null"), "window_no")
    grouped = named.groupBy("doc_key", F.col("doc_id").alias("named_id")).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    out = per.join(grouped, (per.doc_key == grouped.doc_key) & per.doc_id.eqNullSafe(grouped.named_id), "left").select(per.doc_id, "n_words", "copies", covered_words(F.col("covered")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    rows = out.withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))")))
    return rows.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.col("n_hit").cast("bigint").alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def _with_windows(docs: DataFrame, benchmark: DataFrame, width: int, broadcast_windows: int, how: str) -> DataFrame:
    """``docs`` joined to their windows by doc_id and text; columns that are added begin with ``__telemill_``."""
    per, _ = hits(docs, benchmark, width, broadcast_windows)
    bad = written(per.where(F.size("covered") > 0).select(F.col("doc_key").alias("__telemill_key"), F.col("doc_id").alias("__telemill_id"), F.col("covered").alias("__telemill_covered")), "contaminated")
    return docs.join(bad, (F.xxhash64("doc_id", "text") == F.col("__telemill_key")) & F.col("doc_id").eqNullSafe(F.col("__telemill_id")), how)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_windows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, whole, with all their columns.

    Null and empty texts stay, repeated rows share their fate, and null ids are kept.
    """
    return _with_windows(docs, benchmark, width, broadcast_windows, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_windows: int = 1_000_000) -> DataFrame:
    """``docs`` with the hit words cut out of their texts: the kept words keep what stands before them.

    A row without hits keeps its text as it is, also a null or empty one. Repeated rows and null ids are kept.
    """
    joined = _with_windows(docs, benchmark, width, broadcast_windows, "left")
    pieces = F.split("text", "(?<=[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])(?=[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])", -1)
    covered = F.col("__telemill_covered")
    hit = F.array_distinct(F.flatten(F.transform(covered, lambda x: F.sequence(x["start"], x["start"] + x["width"] - 1))))
    kept = F.filter(pieces, lambda p, k: ~F.array_contains(hit, k + 1))
    text = F.when(covered.isNotNull(), F.array_join(kept, "")).otherwise(F.col("text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
