"""Flow control as folds over ordered rows: back-pressure, token buckets, lag."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paused(lags: DataFrame, key: str, order: str, lag: str = "lag", high: int = 600_000, low: int = 200_000) -> DataFrame:
    """``lags`` with ``paused``: intake stops above ``high`` and goes on only below ``low``.

    What lies between the marks changes nothing, so the state is the last mark that was passed.
    """
    mark = F.when(F.col(lag) > high, True).when(F.col(lag) < low, False)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lags.withColumn("paused", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def token_bucket(requests: DataFrame, per_minute: int, burst: int | None = None, cost: float = 1.0) -> DataFrame:
    """``requests(key, ts)``, ts in ms, with ``ok`` and ``wait_s`` until a refused one would pass.

    A bucket holds ``burst`` tokens and fills at ``per_minute``. Requests of a key pass one task in order, which holds a
    batch and the bucket of the key at hand.
    """
    rate, full = per_minute / 60.0, float(burst or max(10, per_minute // 4))
    rows = requests.select("key", F.col("ts").cast("long").alias("ts"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "ts")

    def run(batches):
        own, tokens, last, first = None, full, 0, True
        for batch in batches:
            ok, wait = [], []
            for key, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first or key != own:
                    own, tokens, last, first = key, full, ts, False
                tokens, last = min(full, tokens + (ts - last) / 1000.0 * rate), ts
                ok.append(tokens >= cost)
                wait.append(0.0 if ok[-1] else (cost - tokens) / rate)
                tokens -= cost if ok[-1] else 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(wait, pa.float64())], ["key", "ts", "ok", "wait_s"])

    return ordered.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ts long, ok boolean, wait_s double")


def consumer_lag(ends: DataFrame, positions: DataFrame) -> DataFrame:
    """Records of each topic that are behind ``ends(topic, part, end)``; a partition without a position is read from 0."""
    both = ends.join(positions.select("topic", "part", "pos"), ["topic", "part"], "left")
    return both.groupBy("topic").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.coalesce("pos", F.lit(0)))).alias("lag"))
