"""Builders of the star tables from joined raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import categorize as cat, parse, text
from ..functions.skills import layered_evidence
from .relational import lookup_codes

# Fixed values.
SOURCE_IDS = {"topcv": 1, "topdev": 2, "vietnamworks": 3, "itviec": 4}
DEFAULT_COMPANY = 1


def numbered(frame: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Ids 1..n in a stated order without sorting all rows in one task.

    Rows are range-partitioned by the order; a partition's ids start after the
    rows of those before it, whose counts are one row a partition.
    """
    placed = frame.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    placed = placed.persist()
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start", "_first")
    joined = placed.join(F.broadcast(starts), "_part")  # a row a partition
    return joined.withColumn(name, F.col("_start") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_start", "_first")


def companies(records: DataFrame) -> DataFrame:
    """The golden record of each normalised name: of each attribute the first that isn't blank, in the order of source and id."""
    name = text.clean_company_name_star(F.col("company_name_raw"))
    frame = records.withColumns({"company_name_normalized": name, "_key": F.lower(name)})
    order = F.struct(F.col("source"), F.col("source_job_id"))

    def first(c: Column) -> Column:
        return F.min_by(c, F.when(~text.blank(c.cast("string")), order))

    golden = frame.groupBy("_key").agg(
        F.min_by("company_name_raw", order).alias("company_name_raw"), F.min_by("company_name_normalized", order).alias("company_name_normalized"),
        *[first(F.col(c)).alias(c) for c in ("company_url", "company_logo_url", "company_size_raw", "company_location_raw", "industry_raw", "location_raw")],
    )
    size = parse.parse_company_size(F.col("company_size_raw"))
    golden = golden.withColumns({"website_domain": parse.website_domain(F.col("company_url")), "company_size_min": size["min"], "company_size_max": size["max"], "company_city": cat.city_star(F.col("company_location_raw"), F.col("location_raw"), "Khác / Chưa rõ")})
    return numbered(golden, "company_id", ["_key"])


def canonical_ids(jobs: DataFrame, key: list[str] = ("company_id", "title"), id_col: str = "job_id") -> DataFrame:
    """canonical_job_id: the smallest id among jobs of one company and title; null for that one itself. Two levels, so hot keys are pre-aggregated."""
    keys = {f"_k{i}": F.lower(F.col(k).cast("string")) for i, k in enumerate(key)}
    keyed = jobs.withColumns(keys)
    first = keyed.groupBy(*keys).agg(F.min(id_col).alias("_first"))
    joined = keyed.join(first.select(*[F.col(k).alias(f"{k}r") for k in keys], "_first"), [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys])
    return joined.withColumn("canonical_job_id", F.when(F.col(id_col) != F.col("_first"), F.col("_first"))).select(*jobs.columns, "canonical_job_id")


def jobs(records: DataFrame, company_table: DataFrame, today: Column) -> DataFrame:
    lookup = company_table.select(F.col("_key").alias("_company"), "company_id")
    frame = records.withColumn("_name", F.lower(text.clean_company_name_star(F.col("company_name_raw")))).join(lookup, F.col("_name") == F.col("_company"), "left")
    salary, years = parse.parse_salary_star(F.col("salary_raw")), parse.parse_experience_star(F.col("experience_raw"))
    frame = frame.withColumns({"_salary": salary, "_years": years})
    deadline = parse.clean_date(F.col("deadline_raw"))
    out = frame.select(
        "source", "source_job_id", F.coalesce("company_id", F.lit(DEFAULT_COMPANY)).alias("company_id"), lookup_codes(F.lower("source"), SOURCE_IDS, 1).alias("source_id"),
        "title_raw", text.clean_job_title_star(F.col("title_raw")).alias("title"), cat.seniority(F.col("title_raw"), F.col("experience_raw")).alias("seniority"),
        cat.city_star(F.col("location_raw"), F.col("work_mode_raw")).alias("city"), cat.work_mode(F.col("work_mode_raw"), F.col("location_raw")).alias("work_mode"), F.lit("Full-time").alias("employment_type"),
        "salary_raw", "_salary.*", F.col("_years.min").alias("experience_min"), F.col("_years.max").alias("experience_max"), cat.education(F.col("education_raw")).alias("education"),
        parse.clean_date(F.col("published_at_raw")).alias("published_at"), deadline.alias("deadline"),
        F.coalesce(F.substring(deadline, 1, 10) >= F.date_format(today, "yyyy-MM-dd"), F.lit(True)).alias("is_active"),
    )
    return canonical_ids(numbered(out, "job_id", ["source", "source_job_id"]))


def job_descriptions(records: DataFrame) -> DataFrame:
    """records need job_id."""
    overview = text.clean_html(text.first_present(F.col("responsibilities_raw"), F.col("overview_raw")))
    requirements, benefits = text.clean_html(F.col("requirements_raw")), text.clean_html(F.col("benefits_raw"))
    language = cat.language_star(F.concat_ws(" ", overview, requirements))
    return records.select("job_id", "overview_raw", "responsibilities_raw", "requirements_raw", "benefits_raw", overview.alias("description_clean"), requirements.alias("requirements_clean"), benefits.alias("benefits_clean"), language.alias("language"), text.content_hash(overview, requirements, benefits).alias("text_hash"))


def skills(names: DataFrame) -> DataFrame:
    """names: skill_name, skill_category, parent_name. Ids by category and name; the parent's id by its name."""
    own = numbered(names.withColumn("skill_normalized", F.lower("skill_name")), "skill_id", ["skill_category", "skill_name"])
    parents = own.select(F.col("skill_name").alias("parent_name"), F.col("skill_id").alias("parent_id"))
    return own.join(parents, "parent_name", "left").drop("parent_name")


def job_skills(records: DataFrame, skill_patterns: DataFrame) -> DataFrame:
    """One row for each job and skill of the taxonomy (skill_id, skill_name, pattern) found in any layer. The taxonomy is small and sent to every task."""
    crossed = records.select("job_id", "title_raw", "requirements_raw", "responsibilities_raw", "required_tags", "preferred_tags").crossJoin(F.broadcast(skill_patterns))
    found = layered_evidence(F.col("skill_name"), F.col("pattern"), F.col("required_tags"), F.col("preferred_tags"), F.col("title_raw"), F.col("requirements_raw"), F.col("responsibilities_raw"))
    return crossed.withColumn("_e", found).where("_e is not null").select("job_id", "skill_id", F.col("_e.type").alias("skill_type"), F.col("_e.method").alias("extraction_method"), F.col("_e.confidence").alias("confidence"), F.col("_e.evidence").alias("evidence_text"))


def source_records(records: DataFrame, today: Column) -> DataFrame:
    frame = records.select("job_id", "source", "source_job_id", "job_url", "crawled_at").withColumn("source_id", lookup_codes(F.lower("source"), SOURCE_IDS, 1))
    frame = frame.withColumn("batch_id", parse.batch_id(F.col("crawled_at"), F.date_format(today, "yyyy-MM-dd")))
    return numbered(frame.dropDuplicates(["source_id", "source_job_id"]), "source_record_id", ["source_id", "source_job_id"])


def snapshots(records: DataFrame, today: Column) -> DataFrame:
    """One row for each job and crawl, with a hash of what may change."""
    parts = [F.coalesce(F.col(c), F.lit("None")) for c in ("title_raw", "salary_raw", "location_raw", "requirements_raw")]
    frame = records.withColumns({"batch_id": parse.batch_id(F.col("crawled_at"), F.date_format(today, "yyyy-MM-dd")), "content_hash": F.sha2(F.concat_ws("|", *parts), 256), "observed_at": F.col("crawled_at")})
    return numbered(frame.select("job_id", "observed_at", "batch_id", "title_raw", "location_raw", "salary_raw", "content_hash"), "snapshot_id", ["job_id", "observed_at"])


def clean_flat(records: DataFrame, listings: DataFrame, today: Column, dictionary: dict[str, str], junk: str, ambiguous: frozenset[str] = frozenset(), trade_pattern: str = cat.TRADE_TITLE, core: tuple[str, ...] = cat.CORE_SKILLS) -> DataFrame:
    """The flat path's clean table. A logo is looked for by address, then by company name, among listings."""
    from ..functions.skills import preferred_skills, skills_and_tags

    logos = listings.where(~text.blank(F.col("company_logo_url")))
    by_url = logos.groupBy("job_url").agg(F.min("company_logo_url").alias("_logo_url"))
    by_name = logos.groupBy(F.lower("company_name_raw").alias("_lower")).agg(F.min("company_logo_url").alias("_logo_name"))
    company = text.clean_company_name(F.col("company_name_raw"))
    frame = records.withColumn("company_name", company).join(by_url, "job_url", "left").join(by_name, F.lower("company_name") == F.col("_lower"), "left")
    description = text.description(*[text.clean_html(F.col(c)) for c in ("overview_raw", "responsibilities_raw", "requirements_raw", "benefits_raw")])
    frame = frame.withColumns({"description_clean": description, "title": text.clean_job_title(F.col("title_raw"))})
    frame = frame.withColumns({
        "_found": skills_and_tags(F.col("skills_raw"), F.col("description_clean"), dictionary, junk, ambiguous), "_salary": parse.parse_salary_vnd(F.col("salary_raw"), F.col("title_raw")),
        "_years": parse.parse_experience(F.col("experience_raw")), "_deadline": parse.parse_deadline(F.col("deadline_raw"), today),
    })
    required = F.col("_found.skills")
    return frame.select(
        F.col("detail_id").alias("job_id"), "source", "job_url", "title", "company_name", text.unwrap_logo(F.coalesce("_logo_url", "_logo_name", F.lit(""))).alias("company_logo_url"),
        cat.extract_city(F.col("location_raw")).alias("city"), text.squeeze(F.coalesce("location_raw", F.lit(""))).alias("location"), cat.work_mode(F.col("work_mode_raw"), F.col("location_raw")).alias("work_mode"),
        cat.employment_type(F.col("employment_type_raw"), F.col("title_raw")).alias("employment_type"), required.alias("required_skills"),
        preferred_skills(F.col("preferred_skills_raw"), F.col("description_clean"), required, dictionary).alias("preferred_skills"), F.col("_found.tags").alias("job_tags"),
        F.col("_years.min").alias("experience_min"), F.col("_years.max").alias("experience_max"), F.col("_salary.min").alias("salary_min"), F.col("_salary.max").alias("salary_max"),
        F.col("_deadline.deadline").alias("deadline"), F.col("_deadline.is_active").alias("is_active"), "description_clean", cat.is_trade_job(F.col("title"), required, trade_pattern, core).alias("is_it"),
    )
