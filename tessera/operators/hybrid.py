"""Blending of content and collaborative scores, by user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def z_score(value: Column, group: list[str], active: Column | None = None) -> Column:
    """Standard score among the group's active rows (population deviation plus 1e-9); 0 if there is at most one."""
    w = W.partitionBy(*group)
    own = value if active is None else F.when(active, value)
    return F.when(F.count(own).over(w) <= 1, 0.0).otherwise((value - F.avg(own).over(w)) / (F.stddev_pop(own).over(w) + 1e-9))


def percentile_rank(value: Column, group: list[str]) -> Column:
    """The average rank among the group's values in percent, one decimal; null values have none and don't count."""
    w = W.partitionBy(*group)
    known = F.count(value).over(w)
    below = F.rank().over(w.orderBy(value.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(W.partitionBy(*group, value))
    return F.when(value.isNotNull(), F.round((below + (ties - 1) / 2) / known * 100, 1))


def min_max(value: Column, group: list[str]) -> Column:
    w = W.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value.isNotNull(), 0.0))


def hybrid_scores(scores: DataFrame, group: list[str], content: str = "cbf", collaborative: str = "cf", active: str = "is_active", share: float = 0.5) -> DataFrame:
    """hybrid: the blend of both standard scores; the content's alone where the other is unknown; minus infinity if expired."""
    on = F.col(active)
    a = z_score(F.col(content), group, on)
    b = z_score(F.col(collaborative), group, on & F.col(collaborative).isNotNull())
    value = F.when(F.col(collaborative).isNull(), a).otherwise((1 - share) * a + share * b)
    return scores.withColumn("hybrid", F.when(on, value).otherwise(F.lit(float("-inf"))))


def linear_blend(scores: DataFrame, group: list[str], weight: float, content: str = "cbf", collaborative: str = "cf", ranks: bool = True) -> DataFrame:
    """(1 - weight) * min-max of content + weight * percentile (unknown: one half) or min-max of the other."""
    other = F.coalesce(percentile_rank(F.col(collaborative), group) / 100, F.lit(0.5)) if ranks else F.coalesce(min_max(F.col(collaborative), group), F.lit(0.0))
    return scores.withColumn("blend", (1 - weight) * min_max(F.col(content), group) + weight * other)


def recommend(scores: DataFrame, seen: DataFrame, k: int = 10) -> DataFrame:
    """The k best unseen jobs of each user by hybrid score; a user without interactions gets the content's order.

    scores: user_id, job_id, cbf, cf, is_active. seen: user_id, job_id.
    """
    known = seen.select("user_id").distinct().withColumn("_known", F.lit(True))
    gated = scores.join(known, "user_id", "left").withColumn("cf", F.when(F.col("_known"), F.col("cf"))).drop("_known")
    ranked = hybrid_scores(gated, ["user_id"]).withColumn("cf_percentile", percentile_rank(F.col("cf"), ["user_id"]))
    left = ranked.join(seen, ["user_id", "job_id"], "left_anti").where("is_active")
    order = W.partitionBy("user_id").orderBy(F.col("hybrid").desc(), "job_id")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def three_way(semantic: Column, skills: Column, collaborative: Column) -> Column:
    """The older blend, in percent: .45, .30 and .25, unknown collaborative .68."""
    return F.round(F.least(F.greatest((0.45 * semantic + 0.30 * skills + 0.25 * F.coalesce(collaborative, F.lit(0.68))) * 100, F.lit(0.0)), F.lit(100.0)), 1)
