"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of links (a, b); root is the smallest id reachable.

    In a round each id takes the least label of its neighbours and then that
    label's own. Labels are checkpointed each round, so lineage stays short.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct()
    both = cut_lineage(both)
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("id"), "root")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        joined = labels.join(near.select(F.col("a").alias("id"), "near"), "id", "left").select("id", "root", F.least("root", "near").alias("next"))
        jumped = joined.join(labels.select(F.col("id").alias("next"), F.col("root").alias("far")), "next", "left").select("id", "root", F.least("next", "far").alias("next"))
        fresh = cut_lineage(jumped)
        changed = fresh.where("next < root").limit(1).count()
        labels = fresh.select("id", F.col("next").alias("root"))
        if not changed:
            break
    return labels
