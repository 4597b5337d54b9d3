"""From raw drops to masters, the clean table, the star and the gold tables, one table after the other.

Every table is written as Parquet to {out}/{batch}/{name} and read again by
those that need it, so a run can be taken up at any table, and one table can be
built anew by itself. Masters start from those of the previous batch. A table's
own folder is overwritten, which makes a repeated build harmless.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import categorize as cat
from ..functions.skills import split_tags
from ..operators import dedup, gold, quality, relational as rel, silver, upsert
from ..sources import raw

STATUSES = ("valid", "quarantine", "invalid")


@dataclasses.dataclass
class Run:
    """One batch: where raw drops lie, where tables go, the day, and the caller's dictionary of skills.

    dictionary: lower-case spelling -> skill name. taxonomy: rows of
    (skill_name, skill_category, parent_name); without one the dictionary's
    names, in one category.
    """

    spark: SparkSession
    raw: str
    out: str
    batch: str
    today: dt.date
    dictionary: dict[str, str]
    taxonomy: DataFrame | None = None
    previous: str | None = None

    def path(self, name: str, batch: str | None = None) -> str:
        return f"{self.out.rstrip('/')}/{batch or self.batch}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @property
    def day(self):
        return F.lit(self.today)


def _details(run: Run) -> DataFrame:
    """Routed details with their master key; rows without any key can be in no master and count as invalid in the summary only."""
    found = quality.route(raw.read_raw(run.spark, run.raw, "details").drop("dq_status", "dq_errors"), F.lit(run.today).cast("timestamp"))
    return found.withColumn("record_key", upsert.record_key()).withColumn("position", F.concat_ws("|", F.coalesce("crawled_at", F.lit("")), "raw_date", "raw_file_name"))


def _master(run: Run, status: str) -> DataFrame:
    routed = run.table("routed").where("record_key is not null")
    masters = {s: run.spark.read.parquet(run.path(f"master_{s}", run.previous)) if run.previous else routed.limit(0) for s in STATUSES}
    return upsert.exclusive_masters(masters, routed, "record_key", "position")[status]


def _joined(run: Run) -> DataFrame:
    """Valid details with their listings; of columns that both have the details' value counts."""
    details, listings, keys = run.table("master_valid"), run.table("listings"), ["source", "source_job_id"]
    shared = [c for c in details.columns if c in listings.columns and c not in keys]
    return rel.coalesced_join(details, listings, keys, shared, dedupe_right=True)


def _with_ids(run: Run) -> DataFrame:
    ids = run.table("jobs").select("source", "source_job_id", "job_id")
    tags = {"required_tags": split_tags(F.col("skills_raw")), "preferred_tags": split_tags(F.col("preferred_skills_raw"))}
    return run.table("records").join(ids, ["source", "source_job_id"]).withColumns(tags)


def _skills(run: Run) -> DataFrame:
    names = run.taxonomy
    if names is None:
        names = run.spark.createDataFrame([(n, "other", None) for n in sorted(set(run.dictionary.values()))], "skill_name string, skill_category string, parent_name string")
    return silver.skills(names)


def _job_skills(run: Run) -> DataFrame:
    spellings: dict[str, list[str]] = {}
    for key, name in run.dictionary.items():
        spellings.setdefault(name, []).append(key)
    patterns = [(name, rf"(?<![\w+#.])(?:{'|'.join(re.escape(k) for k in sorted(keys))})(?![\w+#])") for name, keys in spellings.items()]
    known = run.spark.createDataFrame(patterns, "skill_name string, pattern string")
    return silver.job_skills(_with_ids(run), run.table("skills").join(known, "skill_name").select("skill_id", "skill_name", "pattern"))


def _clean(run: Run) -> DataFrame:
    return silver.clean_flat(run.table("master_valid"), run.table("listings"), run.day, run.dictionary, cat.JUNK_TAGS, cat.AMBIGUOUS_SKILLS)


def _companies(run: Run) -> DataFrame:
    return run.table("companies").select("company_id", F.col("company_name_normalized").alias("company_name"), F.col("industry_raw").alias("industry"))


#: Every table in the order in which a run builds them; a builder reads only tables that stand before its own.
TABLES: dict[str, Callable[[Run], DataFrame]] = {
    "listings": lambda run: raw.read_raw(run.spark, run.raw, "listings"),
    "routed": _details,
    "summary": lambda run: quality.summary(run.table("routed")),
    **{f"master_{s}": (lambda s: lambda run: _master(run, s))(s) for s in STATUSES},
    "clean_all": _clean,
    "clean": lambda run: dedup.deduplicate(run.table("clean_all"))[0],
    "duplicates": lambda run: dedup.deduplicate(run.table("clean_all"))[1],
    "records": _joined,
    "companies": lambda run: silver.companies(run.table("records")),
    "jobs": lambda run: silver.jobs(run.table("records"), run.table("companies"), run.day),
    "job_descriptions": lambda run: silver.job_descriptions(_with_ids(run)),
    "skills": _skills,
    "job_skills": _job_skills,
    "source_records": lambda run: silver.source_records(_with_ids(run), run.day),
    "snapshots": lambda run: silver.snapshots(_with_ids(run), run.day),
    "market_kpis": lambda run: gold.market_kpis(run.table("jobs"), _companies(run), run.table("job_skills")),
    "role_geo_matrix": lambda run: gold.role_geo_matrix(run.table("jobs")),
    "company_rankings": lambda run: gold.company_rankings(run.table("jobs"), _companies(run)),
    "skill_demand": lambda run: gold.skill_demand(run.table("jobs"), run.table("job_skills"), run.table("skills")),
    "skill_cooccurrence": lambda run: gold.skill_cooccurrence(run.table("job_skills"), run.table("skills")),
    "salary_experience_matrix": lambda run: gold.salary_experience_matrix(run.table("jobs")),
    "tech_stack": lambda run: gold.tech_stack(run.table("jobs"), run.table("job_skills"), run.table("skills")),
}


def build(run: Run, name: str) -> DataFrame:
    """Builds and writes one table, and returns it as read again."""
    TABLES[name](run).write.mode("overwrite").parquet(run.path(name))
    return run.table(name)


def refresh(run: Run, first: str | None = None) -> list[str]:
    """Builds all tables, or those from ``first`` on, and returns their names."""
    names = list(TABLES)
    for name in (chosen := names[names.index(first) :] if first else names):
        build(run, name)
    return chosen
