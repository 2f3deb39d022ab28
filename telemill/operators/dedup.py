"""Replay window per vehicle: NEW, DUPLICATE or STALE. One rule, run as a batch or as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW, DUPLICATE, STALE = 0, 1, 2
WINDOW = 64
_ALL = (1 << WINDOW) - 1


def window_step(top: int | None, mask: int, seq: int) -> tuple[int, int, int]:
    """(outcome, top, mask) after one sequence number. Bit k of ``mask`` says that ``top - k`` was seen.

    The window first slides up to the number, if that is new to it; then the number's own bit decides.
    """
    newest = seq if top is None else max(top, seq)
    slid = newest - top if top is not None else WINDOW
    mask = (mask << slid) & _ALL if slid < WINDOW else 0
    age = newest - seq
    if age >= WINDOW:
        return STALE, newest, mask
    return DUPLICATE if mask >> age & 1 else NEW, newest, mask | 1 << age


def replay_outcomes(events: DataFrame) -> DataFrame:
    """``events(vin, seq, part, off, ...)`` with ``outcome``, in arrival order per vehicle.

    A batch needs no state machine: the highest earlier number gives the window, and an earlier equal number
    inside it is the duplicate. Numbers that fell out of the window before are stale whatever was seen.
    """
    w = Window.partitionBy("vin").orderBy("part", "off").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("vin", "seq").orderBy("part", "off")
    top = F.max("seq").over(w)
    out = F.when(top.isNull() | (F.col("seq") > top), NEW).when(top - F.col("seq") >= WINDOW, STALE).when(F.row_number().over(same) > 1, DUPLICATE).otherwise(NEW)
    return events.withColumn("outcome", out)


def deduplicated(events: DataFrame) -> DataFrame:
    """Window first, then an exact set for the stale: the first arrival of every (vehicle, number) stays."""
    w = Window.partitionBy("vin", "seq").orderBy("part", "off")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reset_window(events: DataFrame, resets: DataFrame) -> DataFrame:
    """Events with ``epoch``: how many resets of their vehicle came before, so a restarted counter starts anew."""
    marks = resets.select("vin", "part", "off", F.lit(1).alias("_reset"))
    both = events.withColumn("_reset", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("vin").orderBy("part", "off", F.desc("_reset")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("epoch", F.sum("_reset").over(upto)).where("_reset = 0").drop("_reset")


STATE = "top bigint, mask string, stale array<bigint>, seen array<bigint>"
TTL_MS = 48 * 3_600_000


def stream_deduplicated(events: DataFrame, keep_stale: bool = False, known: Column | None = None, clock: str = "rx_ts", ttl_ms: int = TTL_MS) -> DataFrame:
    """Stateful form over a stream: state per vehicle is (top, mask) and the exact set of stale numbers.

    Inside a micro-batch rows are taken in arrival order; a task holds one vehicle's rows of a micro-batch, whose size
    the source bounds. A stale number is held for ``ttl_ms`` of ``clock``, so a vehicle's state holds what came in that
    time; one that falls silent keeps that until its next row (a processing-time timeout would let a stream that runs
    over what is available never end). With ``keep_stale`` stale rows pass as they are. Where ``known`` is given, rows for
    which it is not true pass unchecked.
    """
    schema = events.schema

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        top, mask, stale = None, 0, {}
        if state.exists:
            held = state.get
            top, mask, stale = held[0], int(held[1]), dict(zip(held[2], held[3]))
        rows = pd.concat(list(frames)).sort_values(["part", "off"], kind="stable")
        keep = []
        for seq, now in zip(rows["seq"].tolist(), rows[clock].tolist()):
            outcome, top, mask = window_step(top, mask, int(seq))
            if outcome == STALE and not keep_stale:
                outcome = DUPLICATE if stale.get(int(seq), now - ttl_ms - 1) >= now - ttl_ms else NEW
                if outcome == NEW:
                    stale[int(seq)] = int(now)
            keep.append(outcome != DUPLICATE)
        fresh = rows[clock].max() - ttl_ms
        stale = {k: t for k, t in stale.items() if t >= fresh}
        state.update((top, str(mask), list(stale), list(stale.values())))
        yield rows[pd.Series(keep, index=rows.index)]

    checked = events if known is None else events.where(known)
    out = checked.groupBy("vin").applyInPandasWithState(step, schema, STATE, "append", "NoTimeout")
    return out if known is None else out.union(events.where(~F.coalesce(known, F.lit(False))))
