"""Simulated users, impressions and interactions, from hashes, so that reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .hybrid import z_score


def uniform(seed: int, *columns) -> Column:
    """A number in (0, 1) that depends on the columns only."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(2**53)) + 0.5) / 2.0**53


def normal(seed: int, *columns) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *columns))) * F.cos(2 * math.pi * uniform(seed + 1, *columns))


def utilities(affinity: DataFrame, seed: int = 1, hidden: float = 0.5) -> DataFrame:
    """utility of (user_id, job_id, content): standardised content and a hidden taste."""
    frame = affinity.withColumn("_taste", normal(seed, "user_id", "job_id"))
    return frame.withColumn("utility", (1 - hidden) * z_score(F.col("content"), ["user_id"]) + hidden * z_score(F.col("_taste"), ["user_id"])).drop("_taste")


def slates(scored: DataFrame, size: int = 10, seed: int = 11) -> DataFrame:
    """Positions 1..size of each user's slate, drawn at random."""
    order = W.partitionBy("user_id").orderBy(uniform(seed, "user_id", "job_id"), "job_id")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= size)


def funnel(shown: DataFrame, seed: int = 21, slope: float = 1.5, shifts: tuple[float, float, float] = (-1.5, -2.5, -3.0)) -> DataFrame:
    """Events of shown rows: a click depends on utility and position, a save on a click, an application on a save."""
    bias = 1 / F.log2(F.col("position") + 1)

    def happens(i):
        return uniform(seed + 10 * i, "user_id", "job_id") < 1 / (1 + F.exp(-(slope * F.col("utility") + shifts[i])))

    frame = shown.withColumn("_click", happens(0) & (uniform(seed + 5, "user_id", "job_id") < bias))
    frame = frame.withColumn("_save", F.col("_click") & happens(1)).withColumn("_apply", F.col("_save") & happens(2))
    kinds = F.filter(F.array(F.when(F.col("_click"), "click"), F.when(F.col("_save"), "save"), F.when(F.col("_apply"), "apply")), lambda k: k.isNotNull())
    return frame.select("user_id", "job_id", "position", F.explode(kinds).alias("event"))


def realism(impressions: DataFrame, events: DataFrame) -> DataFrame:
    """One row: rates, events a user (median, 90 %), and the share of the ten per cent most clicked jobs."""
    shown = impressions.agg(F.count("*").alias("impressions"), F.count_distinct("user_id").alias("users"))
    kinds = events.agg(F.count_if(F.col("event") == "click").alias("clicks"), F.count_if(F.col("event") == "apply").alias("applies"))
    by_user = impressions.select("user_id").distinct().join(events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    users = by_user.agg(F.percentile("n", 0.5).alias("median_events"), F.percentile("n", 0.9).alias("p90_events"), F.avg((F.col("n") == 0).cast("double")).alias("silent_users"))
    # jobs by their number of events: few different numbers, so the window is over a short table
    spread = events.groupBy("job_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("jobs"))
    before = F.coalesce(F.sum("jobs").over(W.partitionBy().orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = spread.withColumns({"_before": before, "_all": F.sum("jobs").over(W.partitionBy())})
    in_head = F.col("_before") < 0.1 * F.greatest(F.col("_all") - 1, F.lit(1))
    head = ranked.agg((F.sum(F.when(in_head, F.col("n") * F.col("jobs")).otherwise(0)) / F.sum(F.col("n") * F.col("jobs"))).alias("head_share"))
    one = shown.crossJoin(kinds).crossJoin(users).crossJoin(head)  # a row each
    return one.withColumns({"ctr": F.try_divide(F.col("clicks"), F.col("impressions")), "apply_rate": F.try_divide(F.col("applies"), F.col("clicks"))})
