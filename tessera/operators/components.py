"""Connected components of an edge table by hooking and contraction, as DataFrame rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component_labels(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], max_rounds: int = 200) -> DataFrame:
    """(id, label) for every id in edges (a, b): label is the smallest id reachable.  Direction and repeats don't matter.

    cut: writes a round's table where all executors can read it and reads it back (no lineage grows over the rounds).
    Each round hooks every vertex to its smallest neighbour (or itself), by partial aggregation, so a hub costs no more
    than its edges; then the edges are contracted to the roots and made distinct, so later rounds touch only what is
    not settled yet.  A root that hooks on itself keeps an edge to its own root.  As roots only get smaller, the last
    label of an id is the smallest of its component.
    """
    def ordered(a, b) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    left = cut(edges.select(*ordered(F.col("a"), F.col("b"))).where("a <> b").distinct())
    labels = None
    for _ in range(max_rounds):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
        labels = cut(root.select("id", F.col("root").alias("label")) if labels is None else labels.join(root.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("root", "label").alias("label")))
        to = lambda end: root.select(F.col("id").alias(end), F.col("root").alias(f"r{end}"))
        moved = left.join(to("a"), "a").join(to("b"), "b").select(*ordered(F.col("ra"), F.col("rb")))
        chain = root.join(root.select(F.col("id").alias("root"), F.col("root").alias("next")), "root").select(*ordered(F.col("root"), F.col("next")))
        left = cut(moved.unionByName(chain).where("a <> b").distinct())
        if left.limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
