"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``links(a, b)`` to ``(id, label)``: for every id in a link, the smallest id that it reaches.

    Each round every node takes the least label among its neighbours, then the label of its label, so
    the number of rounds is logarithmic on the chains that occur. A node with very many links is only
    ever reduced by a partially aggregated ``min`` or met in a sort-merge join that AQE splits; nothing
    is collected but one count a round. Ids must not be null; an empty table gives an empty result.
    """
    s = scratch or Scratch(links.sparkSession)
    both = s.write(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = s.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        offered = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(offered, "id").select("id", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = nearer.select(F.col("id").alias("to"), F.col("to").alias("label"))
        after = s.write(nearer.join(jump, "to").select("id", "label", (F.col("label") != F.col("was")).alias("moved")), "labels")
        s.drop(labels)
        labels = after
        if not after.where("moved").limit(1).count():
            s.drop(both)
            return after.select("id", "label")


def merged(label: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``label(id, label)`` after further ``links(a, b)``, written; ids that are not in ``label`` are their own label so far."""
    if label is None:
        return components(links, scratch)
    own = lambda side: label.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
    between = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    new = components(between, scratch)
    moved = label.join(new.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return scratch.write(moved.union(new.join(label, "id", "left_anti")), "merged")
