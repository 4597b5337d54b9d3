"""The three-way quality router: valid, quarantine, invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parse import parse_date, salary_range_raw
from ..functions.text import blank, strip

# Codes in the order in which they are reported.
INVALID_CODES = ("ERR_MISSING_JOB_ID", "ERR_MISSING_JOB_URL", "ERR_MISSING_TITLE", "ERR_MISSING_SOURCE", "ERR_CONTENT_TOO_SHORT")
SOURCES = ("topcv", "topdev", "vietnamworks")
MIN_CONTENT = 100
#: Ties of crawl time go to the higher rank.
STATUS_RANK = {"valid": 0, "quarantine": 1, "invalid": 2}


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name).cast("string"), F.lit("")))


def invalid_errors(sources=SOURCES, min_content: int = MIN_CONTENT) -> Column:
    url = _text("job_url")
    content = strip(F.concat_ws(" ", *[_text(c) for c in ("overview_raw", "responsibilities_raw", "requirements_raw", "benefits_raw")]))
    broken = {
        "ERR_MISSING_JOB_ID": blank(F.col("source_job_id")) & blank(F.col("detail_id")),
        "ERR_MISSING_JOB_URL": ~url.rlike(r"^https?://[^/?#\s]+"),
        "ERR_MISSING_TITLE": F.length(_text("title_raw")) < 2,
        "ERR_MISSING_SOURCE": ~F.lower(_text("source")).isin(*sources),
        "ERR_CONTENT_TOO_SHORT": F.length(content) < min_content,
    }
    return F.filter(F.array(*[F.when(broken[c], c) for c in INVALID_CODES]), lambda e: e.isNotNull())


def salary_errors(salary: Column) -> Column:
    found = salary_range_raw(salary)
    most = F.greatest(found["low"], found["high"])
    limit = F.when(found["unit"] == "usd", 50_000).when(found["unit"] == "trieu", 1_000).when(found["unit"] == "vnd", 1_000_000_000)
    codes = F.array(
        F.when((found["low"] < 0) | (found["high"] < 0), "ERR_SALARY_NEGATIVE"),
        F.when(found["low"] > found["high"], "ERR_SALARY_INVERTED"),
        F.when(most > limit, "ERR_SALARY_OUTLIER"),
    )
    return F.filter(codes, lambda e: e.isNotNull())


def date_errors(published: Column, deadline: Column) -> Column:
    days = [parse_date(c) for c in (published, deadline)]
    codes = [F.when(blank(c), None).when(d.isNull(), "ERR_DATE_MALFORMED").when(F.year(d) < 2020, "ERR_DATE_FAR_PAST") for c, d in zip((published, deadline), days)]
    codes.append(F.when(F.to_date(days[1]) < F.to_date(days[0]), "ERR_DATE_DEADLINE_BEFORE_PUBLISHED"))
    return F.filter(F.array(*codes), lambda e: e.isNotNull())


def route(records: DataFrame, checked_at: Column | None = None, sources=SOURCES, min_content: int = MIN_CONTENT) -> DataFrame:
    """records with dq_status, dq_errors and dq_checked_at. Any invalid code makes a record invalid, and then only those codes are listed."""
    frame = records.withColumn("_invalid", invalid_errors(sources, min_content))
    frame = frame.withColumn("_odd", F.concat(salary_errors(F.col("salary_raw")), date_errors(F.col("published_at_raw"), F.col("deadline_raw"))))
    status = F.when(F.size("_invalid") > 0, "invalid").when(F.size("_odd") > 0, "quarantine").otherwise("valid")
    errors = F.when(F.size("_invalid") > 0, F.col("_invalid")).otherwise(F.col("_odd"))
    return frame.withColumns({"dq_status": status, "dq_errors": errors, "dq_checked_at": F.current_timestamp() if checked_at is None else checked_at}).drop("_invalid", "_odd")


def split(routed: DataFrame) -> dict[str, DataFrame]:
    return {s: routed.where(F.col("dq_status") == s) for s in STATUS_RANK}


def valid_or_not(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two-way form: quarantine counts as invalid."""
    return routed.where("dq_status = 'valid'"), routed.where("dq_status <> 'valid'")


def summary(routed: DataFrame) -> DataFrame:
    """One row: total, and for each status its count and its rate in percent, 0 if there are no rows."""
    counts = [F.count_if(F.col("dq_status") == s).alias(s) for s in STATUS_RANK]
    one = routed.agg(F.count("*").alias("total"), *counts)
    rates = {f"{s}_rate": F.when(F.col("total") > 0, F.round(100 * F.col(s) / F.col("total"), 2)).otherwise(0.0) for s in STATUS_RANK}
    return one.withColumns(rates)


def error_histogram(routed: DataFrame) -> DataFrame:
    return routed.select(F.explode("dq_errors").alias("error_code")).groupBy("error_code").agg(F.count("*").alias("n"))
