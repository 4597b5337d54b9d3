"""Analytical aggregates over the star schema. Columns are named as in the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.parse import experience_bucket


def _avg0(c: str) -> Column:
    return F.round(F.avg(c), 0)


def _share(condition: Column) -> Column:
    return F.round(F.count_if(condition) * 100.0 / F.count("*"), 2)


def market_kpis(jobs: DataFrame, companies: DataFrame, job_skills: DataFrame) -> DataFrame:
    """One row: sizes, average salary bounds and shares of work modes; one pass over each table."""
    both = F.col("salary_min_vnd").isNotNull() & F.col("salary_max_vnd").isNotNull()
    j = jobs.agg(
        F.count("*").alias("total_jobs"), F.count_if("is_active").alias("active_jobs"),
        F.round(F.avg(F.when(both, F.col("salary_min_vnd"))), 0).alias("avg_salary_min"), F.round(F.avg(F.when(both, F.col("salary_max_vnd"))), 0).alias("avg_salary_max"),
        *[_share(F.col("work_mode") == m).alias(f"{m.lower()}_pct") for m in ("Remote", "Hybrid", "Onsite")],
    )
    c = companies.agg(F.count("*").alias("total_companies"))
    s = job_skills.agg(F.count_distinct("skill_id").alias("distinct_skills"))
    return j.crossJoin(c).crossJoin(s)  # a row each


def role_geo_matrix(jobs: DataFrame) -> DataFrame:
    keys = ["title", "seniority", "city", "work_mode", "employment_type"]
    return jobs.groupBy(*keys).agg(F.count("*").alias("job_count"), _avg0("salary_min_vnd").alias("avg_salary_min"), _avg0("salary_max_vnd").alias("avg_salary_max"))


def company_rankings(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    joined = jobs.join(companies, "company_id")
    return joined.groupBy("company_id", "company_name", F.coalesce("industry", F.lit("Chưa rõ")).alias("industry")).agg(
        F.count("*").alias("total_jobs"), F.count_if("is_active").alias("active_jobs"), _avg0("salary_max_vnd").alias("avg_salary_max")
    )


def skill_demand(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, denominator: int | None = None) -> DataFrame:
    """Demand of each skill; penetration in percent of all jobs, or of a given number. Skills are few: AQE broadcasts them by size."""
    joined = job_skills.join(jobs, "job_id").join(skills, "skill_id")
    total = jobs.agg(F.count("*").alias("_jobs")) if denominator is None else None
    out = joined.groupBy("skill_id", "skill_name", "skill_category").agg(
        F.count("*").alias("demand"), F.count_if(F.col("skill_type") == "required").alias("required_count"), F.count_if(F.col("skill_type") == "preferred").alias("preferred_count"),
        _avg0("salary_max_vnd").alias("avg_salary_max"),
    )
    out = out.crossJoin(F.broadcast(total)) if total is not None else out.withColumn("_jobs", F.lit(denominator))
    return out.withColumn("penetration_pct", F.round(F.col("demand") * 100.0 / F.col("_jobs"), 2)).drop("_jobs")


def skill_cooccurrence(job_skills: DataFrame, skills: DataFrame, least: int = 5) -> DataFrame:
    """Pairs of skills in one job, with their names and categories. A job's skills are few and distinct, so the pairs of a job are as well."""
    pairs = job_skills.select("job_id", "skill_id").distinct().groupBy("job_id").agg(F.array_sort(F.collect_list("skill_id")).alias("own"))
    left = pairs.select("own", F.posexplode("own").alias("at", "skill_a"))
    both = left.select("skill_a", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("skill_b"))
    counted = both.groupBy("skill_a", "skill_b").agg(F.count("*").alias("pair_count")).where(F.col("pair_count") >= least)
    for side in "ab":
        counted = counted.join(skills.select(F.col("skill_id").alias(f"skill_{side}"), F.col("skill_name").alias(f"name_{side}"), F.col("skill_category").alias(f"category_{side}")), f"skill_{side}")
    return counted


def salary_experience_matrix(jobs: DataFrame) -> DataFrame:
    bucket = experience_bucket(F.col("experience_min"), F.col("experience_max")).alias("experience_bucket")
    medians = [F.round(F.percentile(c, 0.5), 0).alias(n) for c, n in (("salary_min_vnd", "median_salary_min"), ("salary_max_vnd", "median_salary_max"))]
    return jobs.groupBy("seniority", bucket, "city", "salary_type").agg(F.count("*").alias("job_count"), _avg0("salary_min_vnd").alias("avg_salary_min"), _avg0("salary_max_vnd").alias("avg_salary_max"), *medians)


def rollup_average(frame: DataFrame, key: str) -> DataFrame:
    """Sum of counts and the plain average of the groups' averages, in millions."""
    return frame.groupBy(key).agg(F.sum("job_count").alias("job_count"), F.round(F.avg("avg_salary_min") / 1e6, 1).alias("avg_min_m"), F.round(F.avg("avg_salary_max") / 1e6, 1).alias("avg_max_m"))


def tech_stack(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, least: int = 10, names: int = 5) -> DataFrame:
    """Jobs, average salary and the first names of each category. Names come from the distinct skills in use, ``names`` of them a category."""
    joined = job_skills.join(jobs, "job_id").join(skills, "skill_id")
    out = joined.groupBy("skill_category").agg(F.count_distinct("job_id").alias("job_count"), _avg0("salary_max_vnd").alias("avg_salary_max")).where(F.col("job_count") >= least)
    used = joined.select("skill_category", "skill_name").where("skill_name is not null").distinct()
    first = used.withColumn("_n", F.row_number().over(W.partitionBy("skill_category").orderBy("skill_name"))).where(F.col("_n") <= names)
    listed = first.groupBy("skill_category").agg(F.array_join(F.array_sort(F.collect_list("skill_name")), ", ").alias("top_skills"))
    return out.join(listed, "skill_category", "left").withColumn("top_skills", F.coalesce("top_skills", F.lit("")))


def highest_paying(demand: DataFrame, k: int = 15, least: int = 8) -> DataFrame:
    return demand.where((F.col("demand") >= least) & (F.col("avg_salary_max") > 0)).orderBy(F.col("avg_salary_max").desc(), "skill_id").limit(k)


def skills_per_job(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """Each job's distinct skill names as sorted text, empty without any."""
    named = job_skills.join(skills, "skill_id").groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("skill_name")), ", ").alias("skills"))
    return jobs.select("job_id").join(named, "job_id", "left").withColumn("skills", F.coalesce("skills", F.lit("")))


def skill_share_of_active(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, k: int = 15) -> DataFrame:
    active = jobs.where("is_active").select("job_id")
    counted = job_skills.join(active, "job_id", "left_semi").join(skills, "skill_id").groupBy("skill_id", "skill_name", "skill_category").agg(F.count("*").alias("n"))
    out = counted.crossJoin(F.broadcast(active.agg(F.count("*").alias("_all"))))
    return out.withColumn("pct", F.round(F.col("n") * 100.0 / F.col("_all"), 2)).drop("_all").orderBy(F.col("n").desc(), "skill_id").limit(k)


def salary_by_seniority(jobs: DataFrame) -> DataFrame:
    full = jobs.where("is_active and salary_min_vnd is not null and salary_max_vnd is not null")
    return full.groupBy("seniority").agg(F.count("*").alias("n"), F.round(F.avg("salary_min_vnd") / 1e6, 1).alias("avg_min_m"), F.round(F.avg("salary_max_vnd") / 1e6, 1).alias("avg_max_m"))


def time_to_close(snapshots: DataFrame, key: str = "job_id", at: str = "observed_at") -> DataFrame:
    """Days between the first and the last observation of what was seen more than once."""
    seconds = F.unix_timestamp(F.max(at).cast("timestamp")) - F.unix_timestamp(F.min(at).cast("timestamp"))
    return snapshots.groupBy(key).agg(F.count("*").alias("observations"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.round(seconds / 86400, 1).alias("days")).where("observations > 1")


def filter_options(jobs: DataFrame, column: str, last: str = "Khác", first: str = "Tất cả") -> DataFrame:
    """Distinct values of active jobs in order, ``first`` before and ``last`` after all."""
    values = jobs.where("is_active").select(F.col(column).alias("option")).where("option is not null").distinct()
    ranked = values.withColumn("position", F.when(F.col("option") == last, 2).otherwise(1))
    return ranked.unionByName(jobs.sparkSession.createDataFrame([(first, 0)], "option string, position int")).orderBy("position", "option")


def search(jobs: DataFrame, keyword: str | None = None, columns=("title", "company_name", "city"), active: bool | None = True, **equal) -> DataFrame:
    """Jobs whose columns hold the keyword, in any case, and equal the given values."""
    out = jobs if active is None else jobs.where(F.col("is_active") == active)
    if keyword:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(keyword.lower()))
        out = out.where(hit)
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def entry_level(jobs: DataFrame, levels=("Intern", "Fresher"), words=("intern", "fresher", "thực tập")) -> DataFrame:
    hit = F.col("seniority").isin(*levels) | (F.col("experience_min") == 0)
    for w in words:
        hit = hit | F.ilike("title", F.lit(f"%{w}%"))
    return jobs.where(hit)
