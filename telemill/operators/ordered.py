"""Row numbers and running sums over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators.lineage import cut


def numbered(rows: DataFrame, *order: Column, total: Column | None = None) -> DataFrame:
    """``rows`` with ``_n``, their number in the order from 1 on, and with ``total`` also ``_sum``, its sum up to the row.

    The rows are range-partitioned and numbered inside each partition. What comes before a partition is one row for
    each of them, so that side is bounded by the number of partitions. The order must be total for ``_n`` to be defined.
    """
    own = rows.withColumn("_own", F.lit(1) if total is None else total)
    ranged = cut(own.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("_own").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_upto"))
    w = Window.partitionBy("_part").orderBy(*order)
    inside = ranged.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum("_own").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    placed = inside.join(F.broadcast(base), "_part").withColumn("_n", F.col("_n") + F.col("_before")).withColumn("_sum", F.col("_sum") + F.col("_upto"))
    return placed.drop("_own", "_part", "_before", "_upto", *([] if total is not None else ["_sum"]))
