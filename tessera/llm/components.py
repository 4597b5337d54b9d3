"""Connected components of a graph of ids, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise

#: Each round at least halves long chains, so this is far beyond what any graph needs.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in links (a, b): root is the smallest id reachable.

    Alternates large-star and small-star rounds, in which every id's larger
    (then: smaller or equal) neighbours are linked to its smallest neighbour,
    until nothing changes. A round's aggregation is pre-combined before its
    shuffle. Null ends are ignored. No links give no rows.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "links")
    state = None
    for _ in range(MOST_ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    ids = roots.select(F.col("u").alias("id"), "root")
    return ids.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
