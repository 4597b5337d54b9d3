"""Postings from web pages and API items."""

from __future__ import annotations

import html as entities
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_html, present, squeeze, strip


def html_title(html: Column) -> Column:
    return strip(squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


JOB_POSTING = (
    "title string, description string, datePosted string, validThrough string, employmentType string, hiringOrganization struct<name:string,sameAs:string,logo:string>, "
    "jobLocation array<struct<address:struct<streetAddress:string,addressLocality:string,addressRegion:string>>>, baseSalary struct<currency:string,value:struct<minValue:double,maxValue:double,value:double,unitText:string>>, "
    "experienceRequirements struct<monthsOfExperience:double>, skills string"
)


def json_ld(html: Column) -> Column:
    """The page's JobPosting object as a struct, null without one."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    posting = F.get(F.filter(blocks, lambda b: b.rlike(r'"@type"\s*:\s*"JobPosting"')), F.lit(0))
    return F.from_json(posting, JOB_POSTING)


def posting_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """Columns of a detail record from JSON-LD, else from the page's title and text; months of experience as years."""
    frame = pages.withColumn("_p", json_ld(F.col(html)))
    p = F.col("_p")
    place = F.get(p["jobLocation"], F.lit(0))["address"]
    salary = p["baseSalary"]["value"]
    months = p["experienceRequirements"]["monthsOfExperience"]
    from ..functions.parse import json_ld_salary

    return frame.withColumns({
        "title_raw": F.coalesce(present(p["title"]), html_title(F.col(html))), "company_name_raw": p["hiringOrganization"]["name"], "company_url": p["hiringOrganization"]["sameAs"], "company_logo_url": p["hiringOrganization"]["logo"],
        "location_raw": F.concat_ws(", ", place["streetAddress"], place["addressLocality"], place["addressRegion"]), "salary_raw": json_ld_salary(salary["minValue"], salary["maxValue"], salary["value"], p["baseSalary"]["currency"]),
        "experience_raw": F.when(months >= 12, F.format_string("%s năm", F.round(months / 12, 1).cast("string"))).when(months.isNotNull(), F.format_string("%d tháng", months.cast("int"))),
        "published_at_raw": p["datePosted"], "deadline_raw": p["validThrough"], "skills_raw": p["skills"], "description_raw": clean_html(F.coalesce(p["description"], F.lit(""))),
    }).drop("_p")


def sections(text: Column) -> Column:
    """struct(responsibilities, requirements, benefits): what stands between the usual headings of a description."""

    def part(heading, *others):
        return strip(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?isU)(?:{heading})\s*:?\s*\n(.*?)(?=\n\s*(?:{'|'.join(others)})\s*:?\s*\n|\z)", 1))

    duties, needs, gains = r"mô tả công việc|job description|responsibilities", r"yêu cầu(?: ứng viên| công việc)?|requirements", r"quyền lợi|benefits"
    return F.struct(part(duties, needs, gains).alias("responsibilities"), part(needs, duties, gains).alias("requirements"), part(gains, duties, needs).alias("benefits"))


_CARD = re.compile(r"<div\b[^>]*\bdata-job-id\s*=\s*[\"']?([^\"'\s>]+)[^>]*>", re.I)
_LINK = re.compile(r"<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", re.I | re.S)
_CLASS = r"<(?:[a-z0-9]+)\b[^>]*class\s*=\s*[\"'][^\"']*\b{}\b[^\"']*[\"'][^>]*>(.*?)</"
_TAGS = re.compile(r"<[^>]+>")


def _plain(markup: str) -> str:
    return re.sub(r"\s+", " ", entities.unescape(_TAGS.sub(" ", markup))).strip()


def parse_cards(html: str | None) -> list[dict]:
    """Job cards of a list page; addresses without their query, tags without repeats and cut-off ones."""
    found = list(_CARD.finditer(html or ""))
    out = []
    for i, m in enumerate(found):
        body = html[m.end() : found[i + 1].start() if i + 1 < len(found) else len(html)]
        link = _LINK.search(body)

        def text(name):
            hit = re.search(_CLASS.format(name), body, re.I | re.S)
            return _plain(hit[1]) if hit else ""

        tags = dict.fromkeys(t for t in map(_plain, re.findall(_CLASS.format("tag"), body, re.I | re.S)) if t and "…" not in t and "..." not in t)
        out.append({"source_job_id": m[1], "job_url": (link[1].split("?")[0] if link else ""), "title_raw": _plain(link[2]) if link else "", "company_name_raw": text("company"), "salary_raw": text("salary"), "location_raw": text("address"), "tags_raw": list(tags)})
    return out


CARD = "array<struct<source_job_id:string,job_url:string,title_raw:string,company_name_raw:string,salary_raw:string,location_raw:string,tags_raw:array<string>>>"


def listing_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each card of the pages."""

    @F.pandas_udf(CARD)
    def cards(pages: pd.Series) -> pd.Series:
        return pages.map(parse_cards)

    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.explode(cards(F.col(html))).alias("_c")).select(*kept, "_c.*")


_PUSH = re.compile(r'self\.__next_f\.push\(\[1,\s*("(?:[^"\\]|\\.)*")\]\)', re.S)
_JOB = re.compile(r'\{"id":\d+,"title":"')


def decode_stream(html: str | None) -> str:
    """The text of all chunks that a streamed page pushes."""
    parts = []
    for m in _PUSH.finditer(html or ""):
        try:
            parts.append(json.loads(m[1], strict=False))
        except ValueError:
            continue
    return "".join(parts)


def embedded_objects(text: str) -> list[str]:
    """The JSON objects with an id and a title in decoded text, each id once."""
    decoder, seen, at = json.JSONDecoder(strict=False), {}, 0
    while (m := _JOB.search(text, at)) is not None:
        try:
            value, at = decoder.raw_decode(text, m.start())
            seen.setdefault(value["id"], json.dumps(value, ensure_ascii=False))
        except ValueError:
            at = m.end()
    return list(seen.values())


def streamed_objects(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each embedded object, as JSON text."""

    @F.pandas_udf("array<string>")
    def objects(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: embedded_objects(decode_stream(p)))

    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.explode(objects(F.col(html))).alias("json"))


ITEM = (
    "jobId bigint, jobTitle string, jobUrl string, companyName string, companyUrl string, companyLogo string, prettySalary string, yearsOfExperience int, approvedOn string, expiredOn string, typeWorkingId int, highestDegreeId int, "
    "skills array<struct<skillName:string>>, workingLocations array<struct<address:string,cityNameVI:string>>, jobDescription string, jobRequirement string, benefits array<struct<benefitValue:string>>"
)
# Codes of the API.
WORKING_TYPES = {1: "Full-time", 2: "Part-time", 3: "Intern", 4: "Contract"}
DEGREES = {1: "Trung học", 2: "Trung cấp", 3: "Cao đẳng", 4: "Đại học", 5: "Thạc sĩ", 6: "Tiến sĩ"}


def api_items(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Detail columns from API items as JSON text, without Python."""
    from ..operators.relational import lookup_codes

    i = F.from_json(F.col(json_col), ITEM)
    frame = raw.withColumn("_i", i)
    item = F.col("_i")

    def joined(values, by):
        return F.array_join(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (strip(v) != ""))), by)

    address = F.transform(item["workingLocations"], lambda p: F.coalesce(present(p["address"]), p["cityNameVI"]))
    return frame.select(
        item["jobId"].cast("string").alias("source_job_id"), item["jobTitle"].alias("title_raw"), item["jobUrl"].alias("job_url"), item["companyName"].alias("company_name_raw"), item["companyUrl"].alias("company_url"), item["companyLogo"].alias("company_logo_url"),
        joined(address, "; ").alias("location_raw"), item["prettySalary"].alias("salary_raw"), F.when(item["yearsOfExperience"] > 0, F.concat(item["yearsOfExperience"].cast("string"), F.lit(" năm"))).alias("experience_raw"),
        lookup_codes(item["typeWorkingId"], WORKING_TYPES, "Full-time").alias("employment_type_raw"), lookup_codes(item["highestDegreeId"], DEGREES, "").alias("education_raw"),
        joined(F.transform(item["skills"], lambda s: s["skillName"]), ", ").alias("skills_raw"), clean_html(item["jobDescription"]).alias("responsibilities_raw"), clean_html(item["jobRequirement"]).alias("requirements_raw"),
        joined(F.transform(item["benefits"], lambda b: b["benefitValue"]), "\n").alias("benefits_raw"), item["approvedOn"].alias("published_at_raw"), item["expiredOn"].alias("deadline_raw"),
    )
