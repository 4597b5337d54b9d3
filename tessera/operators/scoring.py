"""Component scores of a posting for a profile, and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.skills import split_match

# Fixed values.
WEIGHTS = {"skills": 0.30, "text": 0.40, "exp": 0.10, "loc": 0.10, "sal": 0.10}
RELATED_CREDIT = 0.5


def skill_score(user: Column, job: Column, mode: str = "v3", groups: list[list[str]] = ()) -> Column:
    """Coverage of the job's skills times the evidence m / (m + 1); null (v1: one half) if the job lists none."""
    match = split_match(user, job, groups)
    n = F.size(match["exact"]) + F.size(match["related"]) + F.size(match["missing"])
    m = F.size(match["exact"]) + (F.size(match["related"]) * RELATED_CREDIT if mode == "v3" else F.lit(0))
    score = m / n if mode == "v1" else m / n * m / (m + 1)
    return F.when(n > 0, F.round(score, 3)).otherwise(F.lit(0.5 if mode == "v1" else None).cast("double"))


def experience_score(years: Column, low: Column, high: Column) -> Column:
    gap = years - low
    return F.when(low.isNull() | (low == 0), 1.0).when((gap >= 0) & (years > high + 3), 0.85).when(gap >= 0, 1.0).when(gap >= -1, 0.7).when(gap >= -2, 0.4).otherwise(0.1)


def place_score(user_city: Column, user_modes: Column, city: Column, mode: Column) -> Column:
    """Half for the city, half for the mode; "Tất cả" or nothing fits all."""
    m = F.lower(F.coalesce(mode, F.lit("")))
    wanted = F.transform(F.coalesce(user_modes, F.array().cast("array<string>")), F.lower)
    by_mode = (
        F.when((F.size(wanted) == 0) | F.array_contains(wanted, F.lit("tất cả")) | F.exists(wanted, lambda w: F.contains(m, w)), 1.0)
        .when(F.contains(m, F.lit("remote")), 0.9)
        .when(F.contains(m, F.lit("hybrid")) & F.exists(wanted, lambda w: F.contains(w, F.lit("remote"))), 0.8)
        .otherwise(0.2)
    )
    everywhere = F.coalesce(user_city, F.lit("")).isin("", "Tất cả")
    by_city = F.when(everywhere | (F.lower(city) == F.lower(user_city)) | F.contains(m, F.lit("remote")), 1.0).otherwise(0.1)
    return F.round(0.5 * by_city + 0.5 * by_mode, 3)


def salary_score(wanted: Column, low: Column, high: Column) -> Column:
    """Null without a salary; one if it is enough, else its share of what is wanted."""
    most = F.coalesce(high, low)
    return F.when(most.isNull(), None).when(F.coalesce(wanted, F.lit(0)) == 0, 1.0).when(most >= wanted, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), most / wanted), 3))


def combine(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the parts that aren't null; 0 if none has weight."""
    total = sum((F.when(parts[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return F.when(total > 0, F.round(value / total, 4)).otherwise(0.0)


def score_jobs(profiles: DataFrame, jobs: DataFrame, similarity: DataFrame, groups: list[list[str]] = (), weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Every job's score and component scores for each profile.

    profiles: profile_id, skills, years, city, modes, min_salary. jobs: job_id,
    required_skills, experience_min/max, city, work_mode, salary_min/max,
    is_active. similarity: profile_id, job_id, similarity. An expired job scores -1.
    The profiles are the stated queries; they are compared with all jobs.
    """
    p = profiles.select("profile_id", F.col("skills").alias("_skills"), F.col("years").alias("_years"), F.col("city").alias("_city"), F.col("modes").alias("_modes"), F.col("min_salary").alias("_wanted"))
    both = jobs.crossJoin(p).join(similarity, ["profile_id", "job_id"], "left")
    from .retrieval import normalise_peak

    both = normalise_peak(both.withColumn("s_text", F.coalesce("similarity", F.lit(0.0))), "profile_id", "s_text")
    both = both.withColumns({
        "s_skills": skill_score(F.col("_skills"), F.col("required_skills"), groups=groups), "s_exp": experience_score(F.col("_years"), F.col("experience_min"), F.col("experience_max")),
        "s_loc": place_score(F.col("_city"), F.col("_modes"), F.col("city"), F.col("work_mode")), "s_sal": salary_score(F.col("_wanted"), F.col("salary_min"), F.col("salary_max")),
    })
    score = combine({"skills": F.col("s_skills"), "text": F.col("s_text"), "exp": F.col("s_exp"), "loc": F.col("s_loc"), "sal": F.col("s_sal")}, weights)
    both = both.withColumn("score", F.when(F.coalesce("is_active", F.lit(True)), score).otherwise(-1.0))
    return both.select("profile_id", "job_id", "score", "s_skills", "s_text", "s_exp", "s_loc", "s_sal", F.col("_skills").alias("profile_skills"), "required_skills", F.coalesce("is_active", F.lit(True)).alias("is_active"))


def recommend(profiles: DataFrame, jobs: DataFrame, similarity: DataFrame, k: int = 10, groups: list[list[str]] = (), weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The k best jobs of each profile with all component scores; see score_jobs()."""
    from .relational import top_k

    scored = score_jobs(profiles, jobs, similarity, groups, weights)
    return top_k(scored.drop("profile_skills", "required_skills", "is_active"), k, "score", ["job_id"], ["profile_id"])


def fit_report(profiles: DataFrame, jobs: DataFrame, similarity: DataFrame, wanted: DataFrame, groups: list[list[str]] = (), weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """For each wanted (profile_id, job_id): its scores, its rank among the active jobs, their number, and the exact, related and missing skills."""
    scored = score_jobs(profiles, jobs, similarity, groups, weights)
    own = wanted.select("profile_id", "job_id").join(scored, ["profile_id", "job_id"])
    # scores have four digits, so a profile has about ten thousand different ones however many jobs there are
    counts = scored.groupBy("profile_id", "score").agg(F.count_if("is_active").alias("_n"))
    whole = W.partitionBy("profile_id")
    better = whole.orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.select("profile_id", "score", (F.coalesce(F.sum("_n").over(better), F.lit(0)) + 1).alias("rank"), F.sum("_n").over(whole).alias("active_jobs"))
    match = split_match(F.col("profile_skills"), F.col("required_skills"), groups)
    return own.join(placed, ["profile_id", "score"]).withColumn("_m", match).select("profile_id", "job_id", "score", "s_skills", "s_text", "s_exp", "s_loc", "s_sal", "rank", "active_jobs", "_m.exact", "_m.related", "_m.missing")
