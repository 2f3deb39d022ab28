"""Positions of regular-expression matches with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


_CHUNK = 256


def spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as ``array<struct(start, end, match)>``, in code points, end exclusive.

    The text is split at the matches; lengths of the pieces between them and of the matches add up to positions.
    They are added up in chunks and then over the chunks, as an array that grows is copied at each step.
    The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    step = F.arrays_zip(between.alias("gap"), found.alias("match"))
    size = lambda x: F.length(x["match"]).cast("bigint")

    def within(chunk: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

        def add(acc, x):
            begin = acc["at"] + x["gap"]
            return F.struct((begin + size(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), (begin + size(x)).alias("end"), x["match"].alias("match")))).alias("out"))

        return F.aggregate(chunk, start, add)

    steps = F.slice(step, F.lit(1), F.size(found))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _CHUNK).cast("int")), lambda c: within(F.slice(steps, c * _CHUNK + 1, F.lit(_CHUNK))))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def join(acc, c):
        moved = F.transform(c["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["match"].alias("match")))
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    return F.when(F.size(found) > 0, F.flatten(F.aggregate(chunks, begin, join, lambda acc: acc["out"]))).otherwise(F.array().cast(SPAN))


def spliced(text: Column, pattern: str, replaced: Column) -> Column:
    """``text`` with its k-th match of ``pattern`` replaced by the k-th entry of ``replaced``."""
    return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), replaced, lambda p, r: F.array(F.coalesce(p, F.lit("")), F.coalesce(r, F.lit(""))))), "")
