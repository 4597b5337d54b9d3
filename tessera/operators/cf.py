"""Implicit-feedback recommenders over (user_id, job_id, weight) rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .relational import pairs_within
from .retrieval import dot
from .silver import numbered

# Fixed values.
EVENT_WEIGHTS = {"click": 1.0, "save": 3.0, "apply": 5.0}


def checked_events(events: DataFrame, kind: str = "event", allowed=tuple(EVENT_WEIGHTS)) -> DataFrame:
    """events; a kind outside the domain stops the query."""
    bad = ~F.coalesce(F.col(kind).isin(*allowed), F.lit(False))
    return events.withColumn(kind, F.when(bad, F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce(F.col(kind), F.lit("null")))).cast("string")).otherwise(F.col(kind)))


def interactions(events: DataFrame, weights: dict[str, float] = EVENT_WEIGHTS, kind: str = "event") -> DataFrame:
    """The greatest event weight of each user and job."""
    weight = F.coalesce(*[F.when(F.col(kind) == k, F.lit(w)) for k, w in weights.items()])
    return events.select("user_id", "job_id", weight.alias("weight")).where("weight is not null").groupBy("user_id", "job_id").agg(F.max("weight").alias("weight"))


def popularity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("job_id").agg(F.count_distinct("user_id").alias("users"))


def item_cosine(pairs: DataFrame) -> DataFrame:
    """job_a, job_b, similarity (both directions) of binary user sets, without the diagonal."""
    sets = pairs.select("user_id", "job_id").distinct()
    sizes = sets.groupBy("job_id").agg(F.count("*").alias("n"))
    common = pairs_within(sets, "user_id", "job_id").groupBy("a", "b").agg(F.count("*").alias("shared"))
    joined = common.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    similarity = (F.col("shared") / F.sqrt(F.col("na") * F.col("nb"))).alias("similarity")
    both = F.explode(F.array(F.struct(F.col("a").alias("job_a"), F.col("b").alias("job_b")), F.struct(F.col("b").alias("job_a"), F.col("a").alias("job_b")))).alias("_p")
    return joined.select(both, similarity).select("_p.job_a", "_p.job_b", "similarity")


def item_knn_scores(pairs: DataFrame, similarity: DataFrame) -> DataFrame:
    """user_id, job_id, score: the sum of similarities to the user's jobs."""
    own = pairs.select("user_id", F.col("job_id").alias("job_a")).distinct()
    return own.join(similarity, "job_a").groupBy("user_id", F.col("job_b").alias("job_id")).agg(F.sum("similarity").alias("score"))


def _solve(gram: np.ndarray, factors: np.ndarray, weights: np.ndarray, alpha: float, reg: float) -> np.ndarray:
    """x of (G + F'(C - I)F + reg I) x = F'c for confidences c = 1 + alpha * weight."""
    c = 1 + alpha * weights
    return np.linalg.solve(gram + (factors * (c - 1)[:, None]).T @ factors + reg * np.eye(gram.shape[0]), factors.T @ c)


def _gram(factors: DataFrame, k: int) -> np.ndarray:
    """The k by k sum of outer products; each task sends one matrix."""

    def partial(frames):
        total = np.zeros((k, k))
        for f in frames:
            if len(f):
                m = np.stack(f["factors"].to_numpy())
                total += m.T @ m
        yield pd.DataFrame({"at": np.arange(k * k), "v": total.ravel()})

    rows = factors.select("factors").mapInPandas(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k * k rows
    out = np.zeros(k * k)
    for r in rows:
        out[r["at"]] = r["v"]
    return out.reshape(k, k)


def _half_step(pairs: DataFrame, solve_for: str, given: str, factors: DataFrame, k: int, alpha: float, reg: float) -> DataFrame:
    """Factors of one side from the other's: normal equations as sums, so a hot user or job needs no task of its own.

    Every pair adds its k(k+1)/2 + k sums; these are combined before the shuffle.
    """
    gram = _gram(factors, k)
    joined = pairs.join(factors.withColumnRenamed("id", given), given).select(F.col(solve_for).alias("id"), "weight", "factors")

    def sums(frames):
        for f in frames:
            if not len(f):
                continue
            m, w = np.stack(f["factors"].to_numpy()), f["weight"].to_numpy()
            ids, place = np.unique(f["id"].to_numpy(), return_inverse=True)
            a, b = np.zeros((len(ids), k, k)), np.zeros((len(ids), k))
            np.add.at(a, place, alpha * w[:, None, None] * m[:, :, None] * m[:, None, :])
            np.add.at(b, place, (1 + alpha * w)[:, None] * m)
            yield pd.DataFrame({"id": ids, "s": [np.concatenate([x.ravel(), y]) for x, y in zip(a, b)]})

    kind = joined.schema["id"].dataType.simpleString()
    parts = joined.mapInPandas(sums, f"id {kind}, s array<double>")
    width = k * k + k
    totals = parts.select("id", *[F.get("s", F.lit(i)).alias(f"s{i}") for i in range(width)]).groupBy("id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])

    def solve(frames):
        for f in frames:
            s = f[[f"s{i}" for i in range(width)]].to_numpy()
            a = s[:, : k * k].reshape(-1, k, k) + gram + reg * np.eye(k)
            x = np.linalg.solve(a, s[:, k * k :, None])[:, :, 0] if len(s) else s[:, k * k :]
            yield pd.DataFrame({"id": f["id"], "factors": list(x)})

    return totals.mapInPandas(solve, f"id {kind}, factors array<double>")


def als(pairs: DataFrame, k: int = 8, reg: float = 0.1, alpha: float = 1.0, rounds: int = 12, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(user factors, job factors) as (id, factors) of implicit ALS with unscaled regularisation.

    Factors are checkpointed each half round, so lineage stays short.
    """
    uniform = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "job_id"), F.lit(2**40)) + 0.5) / 2.0**40 for i in range(2 * k)]
    normal = [F.sqrt(-2 * F.log(uniform[2 * i])) * F.cos(2 * np.pi * uniform[2 * i + 1]) * 0.01 for i in range(k)]
    jobs = pairs.select("job_id").distinct().select(F.col("job_id").alias("id"), F.array(*normal).alias("factors"))
    pairs = cut_lineage(pairs)
    users = None
    for _ in range(rounds):
        users = cut_lineage(_half_step(pairs, "user_id", "job_id", jobs, k, alpha, reg))
        jobs = cut_lineage(_half_step(pairs, "job_id", "user_id", users, k, alpha, reg))
    return users, jobs


def fold_in(pairs: DataFrame, jobs: DataFrame, k: int = 8, alpha: float = 1.0, reg: float = 0.1) -> DataFrame:
    """Factors of users, new ones too, from fixed job factors."""
    return _half_step(pairs, "user_id", "job_id", jobs, k, alpha, reg)


def als_library(pairs: DataFrame, k: int = 8, reg: float = 0.1, alpha: float = 1.0, rounds: int = 12, seed: int = 0):
    """Spark's own implicit ALS, for ids that are integers; its regularisation grows with the number of ratings."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=k, maxIter=rounds, regParam=reg, alpha=alpha, implicitPrefs=True, userCol="user_id", itemCol="job_id", ratingCol="weight", seed=seed).fit(pairs)


def cf_scores(pairs: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """score of (user_id, job_id) rows, null where either has no factors."""
    joined = pairs.join(users.toDF("user_id", "_x"), "user_id", "left").join(jobs.toDF("job_id", "_y"), "job_id", "left")
    return joined.withColumn("score", dot(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def similar_jobs(similarity: DataFrame, jobs: DataFrame, job_skills: DataFrame, target, k: int = 6, least: float = 0.05) -> DataFrame:
    """The k most similar jobs as percent between 50 and 98.5; if there are fewer, jobs sharing skills and level follow."""
    near = similarity.where((F.col("job_a") == target) & (F.col("similarity") > least)).select(F.col("job_b").alias("job_id"), F.least(F.greatest(F.round(F.col("similarity") * 100, 1), F.lit(50.0)), F.lit(98.5)).alias("match"), F.lit(0).alias("tier"))
    own = job_skills.where(F.col("job_id") == target).select("skill_id").distinct()
    level = jobs.where(F.col("job_id") == target).select(F.col("seniority").alias("_level"))
    shared = job_skills.where(F.col("job_id") != target).join(own, "skill_id", "left_semi").groupBy("job_id").agg(F.count_distinct("skill_id").alias("n"))
    other = shared.join(jobs.select("job_id", "seniority"), "job_id").crossJoin(F.broadcast(level.limit(1)))
    points = 2 * F.col("n") + (F.col("seniority") == F.col("_level")).cast("int")
    fallback = other.join(near.select("job_id"), "job_id", "left_anti").select("job_id", F.least(50.0 + points, F.lit(98.5)).cast("double").alias("match"), F.lit(1).alias("tier"))
    return near.unionByName(fallback).orderBy("tier", F.col("match").desc(), "job_id").limit(k)


def truncated_svd(pairs: DataFrame, k: int):
    """Singular values and job vectors of the binary user by job matrix (RowMatrix is an RDD API); jobs by position."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    index = numbered(pairs.select("job_id").distinct(), "at", ["job_id"]).withColumn("at", F.col("at") - 1)
    n = index.count()
    rows = pairs.join(index, "job_id").select("user_id", "at").distinct().groupBy("user_id").agg(F.array_sort(F.collect_list("at")).alias("at"))
    matrix = RowMatrix(rows.rdd.map(lambda r: Vectors.sparse(n, r["at"], [1.0] * len(r["at"]))))
    svd = matrix.computeSVD(k)
    return index, svd.s, svd.V


def pca(vectors: DataFrame, k: int = 2, vector_col: str = "embedding"):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    frame = vectors.withColumn("_v", array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="_v", outputCol="components").fit(frame).transform(frame).drop("_v")


def centroid_scores(user_factors: DataFrame, members: DataFrame, jobs: DataFrame, group: str) -> DataFrame:
    """Each group's mean user vector times each job's; members: (id, group)."""
    mean = members.join(user_factors, "id").select(group, F.posexplode("factors").alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("x"))
    vector = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("_c"))
    return jobs.toDF("job_id", "_y").crossJoin(F.broadcast(vector)).select(group, "job_id", dot(F.col("_c"), F.col("_y")).alias("score"))
