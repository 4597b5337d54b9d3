"""Profiles of crawled listings and details."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.categorize import language_profile, salary_kind
from ..functions.parse import parse_date
from ..functions.text import blank, match_key

# The fields whose gaps are counted.
FIELDS = ("title_raw", "company_name_raw", "location_raw", "salary_raw", "experience_raw", "deadline_raw", "responsibilities_raw", "requirements_raw", "benefits_raw", "job_url")


def _filled(name: str, frame: DataFrame):
    return ~blank(F.col(name)) if name in frame.columns else F.lit(False)


def profile_sources(listings: DataFrame, details: DataFrame, fields=FIELDS) -> DataFrame:
    """One row for each source: listing states, repeated addresses and ids, gaps, salaries, deadlines and languages. Each table is read once."""
    status = F.col("detail_status")
    left = listings.groupBy("source").agg(
        F.count("*").alias("total_listings"), F.count_if(status == "success").alias("success"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "pending").alias("pending"), F.count_if(status == "expired").alias("expired"),
        *[(F.count(F.when(~blank(F.col(c)), F.col(c))) - F.count_distinct(F.when(~blank(F.col(c)), F.col(c)))).alias(n) for c, n in (("job_url", "duplicate_urls"), ("source_job_id", "duplicate_job_ids"))],
    )
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title_raw", "responsibilities_raw", "requirements_raw") if c in details.columns])
    prepared = details.withColumns({"_language": language_profile(text), "_salary": salary_kind(F.col("salary_raw")), "_deadline": parse_date(F.col("deadline_raw"))})
    n = F.count("*")
    right = prepared.groupBy("source").agg(
        n.alias("total_details"),
        *[x for c in fields for x in (F.count_if(~_filled(c, details)).alias(f"missing_{c}"), F.round(100 * F.count_if(~_filled(c, details)) / n, 1).alias(f"missing_{c}_pct"))],
        *[F.count_if(F.col("_salary") == k).alias(f"salary_{k}") for k in ("missing", "negotiable", "numeric")],
        F.count_if(blank(F.col("deadline_raw"))).alias("deadline_missing"), F.count_if(F.col("_deadline").isNotNull()).alias("deadline_valid"), F.count_if(~blank(F.col("deadline_raw")) & F.col("_deadline").isNull()).alias("deadline_malformed"),
        *[F.count_if(F.col("_language") == k).alias(f"language_{k}") for k in ("vi", "en", "mixed", "unknown")],
    )
    return left.join(right, "source", "full")


def overall(profile: DataFrame) -> DataFrame:
    """The counts summed over all sources."""
    return profile.agg(*[F.sum(c).alias(c) for c in profile.columns if c != "source" and not c.endswith("_pct")])


def dominant_language(profile: DataFrame) -> DataFrame:
    """Each source's most frequent language; of equal ones the first of vi, en, mixed, unknown."""
    pairs = F.array(*[F.struct(F.col(f"language_{k}").alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("language")) for i, k in enumerate(("vi", "en", "mixed", "unknown"))])
    return profile.select("source", F.array_max(pairs)["language"].alias("dominant_language"))


def cross_portal(records: DataFrame, company: str = "company_name_raw", title: str = "title_raw", samples: int = 10) -> tuple[DataFrame, DataFrame]:
    """(groups of postings with one company and title on several sources, a few of them)."""
    keyed = records.select(match_key(F.col(company)).alias("company"), match_key(F.col(title)).alias("title"), "source").where("company <> '' and title <> ''")
    groups = keyed.groupBy("company", "title").agg(F.count_distinct("source").alias("sources"), F.array_sort(F.collect_set("source")).alias("source_list")).where("sources > 1")
    return groups, groups.orderBy("company", "title").limit(samples)


def schema_comparison(raw: DataFrame, source: str = "source", json: str = "json") -> DataFrame:
    """key, sources (which have it), uniform (all do), from records as JSON text."""
    keys = raw.select(source, F.explode(F.json_object_keys(F.col(json))).alias("key")).distinct()
    total = raw.agg(F.count_distinct(source).alias("_n"))
    found = keys.groupBy("key").agg(F.array_sort(F.collect_set(source)).alias("sources"))
    return found.crossJoin(F.broadcast(total)).select("key", "sources", (F.size("sources") == F.col("_n")).alias("uniform"))


def report(profile: DataFrame) -> str:
    """A Markdown table of the profile; one row a source reaches the driver."""
    rows = [r.asDict() for r in profile.orderBy("source").collect()]
    if not rows:
        return "No data.\n"
    names = [c for c in rows[0] if c != "source"]
    lines = ["| metric | " + " | ".join(str(r["source"]) for r in rows) + " |", "|" + "---|" * (len(rows) + 1)]
    for c in names:
        cells = ["-" if r[c] is None else f"{r[c]:.1f}%" if c.endswith("_pct") else f"{r[c]:,}" for r in rows]
        lines.append(f"| {c} | " + " | ".join(cells) + " |")
    return "\n".join(lines) + "\n"
