"""Ranking metrics over rows of (query, rank, gain)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def precision_at(ranked: DataFrame, k: int, query: str = "query_id", relevant: str = "relevant") -> DataFrame:
    top = ranked.where(F.col("rank") <= k)
    return top.groupBy(query).agg((F.sum(F.col(relevant).cast("double")) / k).alias("precision"))


def ndcg_at(ranked: DataFrame, judged: DataFrame, k: int, query: str = "query_id", gain: str = "gain", graded: bool = False) -> DataFrame:
    """NDCG of the ranked rows; the ideal order comes from all judged rows of the query."""

    def value(c):
        return F.pow(F.lit(2.0), c.cast("double")) - 1 if graded else c.cast("double")

    got = ranked.where(F.col("rank") <= k).groupBy(query).agg(F.sum(value(F.col(gain)) * discount(F.col("rank"))).alias("dcg"))
    order = W.partitionBy(query).orderBy(F.col(gain).desc())
    ideal = judged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy(query).agg(F.sum(value(F.col(gain)) * discount(F.col("_r"))).alias("idcg"))
    joined = ideal.join(got, query, "left")
    return joined.select(query, F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def recall_at(ranked: DataFrame, relevant: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    hits = relevant.join(ranked.where(F.col("rank") <= k).select(query, item).withColumn("_hit", F.lit(1)), [query, item], "left")
    return hits.groupBy(query).agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("recall"))


def coverage(ranked: DataFrame, items: DataFrame, k: int, item: str = "item_id") -> DataFrame:
    shown = ranked.where(F.col("rank") <= k).agg(F.count_distinct(item).alias("shown"))
    return shown.crossJoin(items.agg(F.count_distinct(item).alias("total"))).select((F.col("shown") / F.col("total")).alias("coverage"))


def diversity_at(ranked: DataFrame, similarity: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """One minus the mean similarity of the top k's pairs; similarity: (a, b, similarity) with a < b, absent being 0."""
    top = ranked.where(F.col("rank") <= k).select(query, item)
    a, b = top.toDF(query, "a"), top.toDF(query, "b")
    pairs = a.join(b, query).where("a < b").join(similarity, ["a", "b"], "left")
    return pairs.groupBy(query).agg((1 - F.avg(F.coalesce("similarity", F.lit(0.0)))).alias("diversity"))


def time_split(events: DataFrame, at: str, start, end) -> tuple[DataFrame, DataFrame]:
    """Events before start, and those from start up to end."""
    return events.where(F.col(at) < F.lit(start)), events.where((F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(end)))


def rmse(frame: DataFrame, actual: str, predicted: str) -> DataFrame:
    return frame.agg(F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), F.lit(2.0)))).alias("rmse"))


def weight_sweep(parts: DataFrame, candidates: list[dict[str, float]], evaluate, score) -> list[tuple[dict, float]]:
    """Each candidate's weights and the metric that ``evaluate`` gives for rows scored with them; for ablations and grids."""
    return [(w, evaluate(parts.withColumn("score", score(w)))) for w in candidates]


def skill_coverage_at(ranked: DataFrame, user_skills: DataFrame, job_skills: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """The mean share of a shown item's skills that the user has, over the first k; an item without skills counts as 0.

    user_skills: (query, skills), job_skills: (item, skills), both arrays.
    """
    own = F.transform(F.coalesce("_own", F.array().cast("array<string>")), F.lower)
    wanted = F.array_distinct(F.transform(F.coalesce("_wanted", F.array().cast("array<string>")), F.lower))
    share = F.size(F.array_intersect(own, wanted)) / F.greatest(F.size(wanted), F.lit(1))
    top = ranked.where(F.col("rank") <= k).select(query, item)
    joined = top.join(user_skills.select(query, F.col("skills").alias("_own")), query, "left").join(job_skills.select(item, F.col("skills").alias("_wanted")), item, "left")
    return joined.groupBy(query).agg(F.avg(share).alias("skill_coverage"))


def oracle_precision_at(ranked: DataFrame, oracle: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """The share of the first k that an oracle's first k hold as well."""
    best = oracle.where(F.col("rank") <= k).select(query, item).withColumn("_hit", F.lit(1))
    return ranked.where(F.col("rank") <= k).select(query, item).join(best, [query, item], "left").groupBy(query).agg((F.sum(F.coalesce("_hit", F.lit(0))) / k).alias("oracle_precision"))


def cold_start_recall(ranked: DataFrame, relevant: DataFrame, warm: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """Over all queries: the share of relevant items without earlier events that are shown among the first k; null if there are none."""
    cold = relevant.select(query, item).join(warm.select(item).distinct(), item, "left_anti")
    shown = ranked.where(F.col("rank") <= k).select(query, item).withColumn("_hit", F.lit(1))
    return cold.join(shown, [query, item], "left").agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("cold_recall"))


def random_split(frame: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows by a seeded hash of their key: about ``share`` of them, and the others. Reruns agree."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**40))) / 2.0**40
    return frame.where(uniform < share), frame.where(uniform >= share)
