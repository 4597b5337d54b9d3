"""Rules over the star tables, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from .relational import orphans


def _long(c: str, least: int) -> Column:
    return F.length(strip(F.coalesce(F.col(c), F.lit("")))) >= least


def evaluate(merged: DataFrame, jobs: DataFrame, companies: DataFrame, descriptions: DataFrame, snapshots: DataFrame, job_skills: DataFrame, skills: DataFrame, source_records: DataFrame, source_names: dict[int, str]) -> DataFrame:
    """rule_name, entity_type, severity, source_id, total, passed, pass_rate, status.

    Eleven rules, and one for each source that has records. Each table is
    aggregated once, to one row. A failed CRITICAL or ERROR rule is FAILED,
    another WARNING.
    """
    content = _long("responsibilities_raw", 11) | _long("requirements_raw", 11)
    one = merged.agg(
        F.count("*").alias("n"), F.count_if(_long("title_raw", 2)).alias("titles"), F.count_if(_long("company_name_raw", 2)).alias("names"), F.count_if(content).alias("contents"),
        F.count_if(F.coalesce(F.col("job_url"), F.lit("")).rlike("^https?://")).alias("urls"), F.count_distinct(F.struct(F.coalesce("source_id", F.lit(-1)), F.coalesce("source_job_id", F.lit("\0")))).alias("distinct_ids"),
    )
    parts = [
        orphans(jobs, companies, "company_id", "company_id").agg(F.count("*").alias("lost_companies")),
        jobs.join(descriptions.select("job_id"), "job_id").agg(F.count("*").alias("matched")),
        jobs.agg(F.count_if(F.col("salary_min_vnd") > F.col("salary_max_vnd")).alias("inverted"), F.count_if(F.col("deadline") < "2020-01-01").alias("old")),
        snapshots.agg(F.count("*").alias("snaps")),
        orphans(job_skills, skills, "skill_id", "skill_id").agg(F.count("*").alias("lost_skills")),
        job_skills.agg(F.count("*").alias("links")),
    ]
    for p in parts:
        one = one.crossJoin(p)  # a row each
    n = F.col("n")
    # Names, entities and severities.
    rules = [
        ("CHK_TITLE_NOT_EMPTY", "job", "CRITICAL", n, F.col("titles")),
        ("CHK_COMPANY_NAME_NOT_EMPTY", "company", "CRITICAL", n, F.col("names")),
        ("CHK_JD_CONTENT_NOT_EMPTY", "job_description", "CRITICAL", n, F.col("contents")),
        ("CHK_VALID_JOB_URL_FORMAT", "job_source_record", "ERROR", n, F.col("urls")),
        ("CHK_UNIQUE_SOURCE_JOB_ID", "job_source_record", "CRITICAL", n, F.col("distinct_ids")),
        ("CHK_FK_COMPANY_INTEGRITY", "job", "CRITICAL", n, n - F.col("lost_companies")),
        ("CHK_JOB_DESCRIPTION_1TO1_MATCH", "job_description", "CRITICAL", n, F.col("matched")),
        ("CHK_SALARY_RANGE_LOGIC", "job", "ERROR", n, n - F.col("inverted")),
        ("CHK_DEADLINE_REASONABLE", "job", "WARNING", n, n - F.col("old")),
        ("CHK_SNAPSHOT_COMPLETENESS", "job_snapshot", "CRITICAL", n, F.least(F.col("snaps"), n)),
        ("CHK_SKILL_FK_INTEGRITY", "job_skill", "CRITICAL", F.col("links"), F.col("links") - F.col("lost_skills")),
    ]
    rows = F.array(*[F.struct(F.lit(a).alias("rule_name"), F.lit(b).alias("entity_type"), F.lit(c).alias("severity"), F.lit(None).cast("int").alias("source_id"), t.cast("long").alias("total"), p.cast("long").alias("passed")) for a, b, c, t, p in rules])
    fixed = one.select(F.explode(rows).alias("r")).select("r.*")
    names = F.create_map(*[F.lit(x) for k, v in source_names.items() for x in (k, v)])
    counts = source_records.groupBy("source_id").agg(F.count("*").alias("total")).where(names[F.col("source_id")].isNotNull())
    by_source = counts.select(
        F.concat(F.lit("CHK_SOURCE_INGESTION_"), F.upper(names[F.col("source_id")])).alias("rule_name"), F.lit("job_source_record").alias("entity_type"), F.lit("INFO").alias("severity"),
        F.col("source_id").cast("int").alias("source_id"), F.col("total").cast("long").alias("total"), F.col("total").cast("long").alias("passed"),
    )
    status = F.when(F.col("passed") == F.col("total"), "PASSED").when(F.col("severity").isin("CRITICAL", "ERROR"), "FAILED").otherwise("WARNING")
    rate = F.when(F.col("total") > 0, F.round(100.0 * F.col("passed") / F.col("total"), 2)).otherwise(100.0)
    return fixed.unionByName(by_source).withColumns({"pass_rate": rate, "status": status})


def rollup(results: DataFrame, key: str) -> DataFrame:
    """By severity or entity type: rules, totals and the mean pass rate."""
    return results.groupBy(key).agg(F.count("*").alias("rules"), F.sum("total").alias("total"), F.sum("passed").alias("passed"), F.round(F.avg("pass_rate"), 2).alias("mean_pass_rate"))


def breakdown(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Failed rules by source, rule and severity."""
    joined = results.join(sources.select("source_id", "source_name"), "source_id", "left")
    return joined.groupBy("source_name", "rule_name", "severity").agg(F.count_if(F.col("status") == "FAILED").alias("failed"))
