"""Parsing, cleaning and category functions over every order, whose raw texts are dealt from lists of known inputs.

The tables have no such raw columns. Each order gets the input of its number;
the SQL has the known result of each input, so that every row is held against it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import categorize as cat, parse, skills as sk, text
from .queries import query

M, USD = 1_000_000, 25_400


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value}::DOUBLE" if isinstance(value, float) else str(value)


def golden(name: str, function, cases: list[tuple], columns: dict[str, str]) -> None:
    """Registers a query: ``function`` of each case's first value gives the further ones, under the names and SQL types of columns."""
    values = ", ".join(f"({i}, {', '.join(_literal(v) for v in case[1:])})" for i, case in enumerate(cases))
    typed = ", ".join(f"v.{c}::{kind} AS {c}" for c, kind in columns.items())

    def run(t):
        raw = F.element_at(F.array(*[F.lit(case[0]).cast("string") for case in cases]), (F.col("o_orderkey") % len(cases) + 1).cast("int"))
        out = function(F.col("raw"))
        found = out if isinstance(out, dict) else {next(iter(columns)): out}
        return t.table("orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", *[found[c].alias(c) for c in columns])

    run.__name__ = name
    query(f"SELECT o_orderkey, {typed} FROM orders JOIN (VALUES {values}) v(i, {', '.join(columns)}) ON o_orderkey % {len(cases)} = v.i")(run)


def _both(c: Column, round_to: int | None = 2) -> dict[str, Column]:
    return {"low": F.round(c["min"], round_to), "high": F.round(c["max"], round_to)}


golden("salary_texts", lambda c: _both(parse.parse_salary_vnd(c)), [
    ("15 - 20 triệu", 15.0 * M, 20.0 * M), ("Tới 30 triệu", None, 30.0 * M), ("Từ 10 triệu", 10.0 * M, None), ("15tr-20tr", 15.0 * M, 20.0 * M), ("$ 1,000 - 2,000", 1000.0 * USD, 2000.0 * USD), ("Thỏa thuận", None, None),
    ("", None, None), (None, None, None), ("14000000 - 18000000 MONTH", 14.0 * M, 18.0 * M), ("500 - 2000", 500.0 * USD, 2000.0 * USD), ("Lên tới 3000", None, 3000.0 * USD), ("$ 1-1 /tháng", None, None),
    ("S$ 110,000-220,000 /tháng", None, None), ("23000", None, None), ("500000", None, None), ("Tới 0.5 triệu", None, None), ("$ 24,000-29,000 /năm", 2000.0 * USD, 61383333.33),
], {"low": "DOUBLE", "high": "DOUBLE"})


def _star(c: Column) -> dict[str, Column]:
    found = parse.parse_salary_star(c)
    return {"kind": found["salary_type"], "currency": found["salary_currency"], "low": found["salary_min_vnd"].cast("double"), "high": found["salary_max_vnd"].cast("double")}


golden("salary_types", _star, [
    ("15 - 20 triệu", "range", "VND", 15.0 * M, 20.0 * M), ("$ 1,000 - 2,000", "range", "USD", 1000.0 * USD, 2000.0 * USD), ("Up to $2000", "max_only", "USD", None, 2000.0 * USD), ("Thương lượng", "negotiable", "VND", None, None),
    (None, "undisclosed", "VND", None, None), ("10,000,000 - 18,000,000", "range", "VND", 10.0 * M, 18.0 * M), ("Từ 10 triệu", "min_only", "VND", 10.0 * M, None), ("$ 1-1", "negotiable", "USD", None, None), ("500", "fixed", "USD", 500.0 * USD, 500.0 * USD),
], {"kind": "VARCHAR", "currency": "VARCHAR", "low": "DOUBLE", "high": "DOUBLE"})

golden("experience_texts", lambda c: {k: v.cast("double") for k, v in _both(parse.parse_experience(c), 2).items()}, [
    ("2 - 3 năm", 2.0, 3.0), ("Trên 5 năm", 5.0, None), ("dưới 1 năm", 0.0, 1.0), ("6 tháng", 0.5, 0.5), ("Không yêu cầu", 0.0, 0.0), ("3 năm", 3.0, 3.0), ("", None, None), ("fresher", 0.0, 0.0), ("2 năm trở lên", 2.0, None),
], {"low": "DOUBLE", "high": "DOUBLE"})

golden("company_sizes", lambda c: {k: v.cast("int") for k, v in _both(parse.parse_company_size(c), 0).items()}, [
    ("100-499", 100, 499), ("1.000+", 1000, None), ("hơn 500", 500, None), ("< 20", 1, 20), ("ít hơn 20", 20, None), ("dưới 20", None, None),
], {"low": "INTEGER", "high": "INTEGER"})

golden("cities", cat.extract_city, [
    ("hanoi", "Hà Nội"), ("Ha Noi, Vietnam", "Hà Nội"), ("Cầu Giấy, Hà Nội", "Hà Nội"), ("district 1, ho chi minh city, vietnam", "Hồ Chí Minh"), ("Sài Gòn", "Hồ Chí Minh"), ("Quận Hải Châu, Đà Nẵng", "Đà Nẵng"),
    ("Hà Nội; Hồ Chí Minh", "Hà Nội"), ("Hồ Chí Minh; Hà Nội", "Hồ Chí Minh"), ("kcn Quế Võ, Bắc Ninh", "Khác"), ("Thanh Hóa", "Khác"), ("remote vietnam", "Toàn quốc"), ("", "Toàn quốc"), (None, "Toàn quốc"),
], {"city": "VARCHAR"})

golden("star_cities", cat.city_star, [("TP.HCM", "Hồ Chí Minh"), ("Hải Phòng", "Hải Phòng"), ("x", "Khác"), ("HN", "Hà Nội")], {"city": "VARCHAR"})

golden("seniorities", cat.seniority, [("Giám đốc", "Director"), ("Senior Team Lead", "Lead"), ("Thực tập sinh", "Intern"), ("Dev", "Undetermined"), ("Senior Dev", "Senior")], {"level": "VARCHAR"})

golden("work_modes", cat.work_mode, [("Làm từ xa", "Remote"), ("Hybrid", "Hybrid"), (None, "Onsite")], {"mode": "VARCHAR"})

golden("employment_types", cat.employment_type, [("Thực tập", "Intern"), ("bán thời gian", "Part-time"), ("freelance", "Contract"), (None, "Full-time")], {"kind": "VARCHAR"})

golden("educations", cat.education, [("Cử nhân CNTT", "Đại học"), ("Cao đẳng", "Cao đẳng"), (None, "Không yêu cầu")], {"degree": "VARCHAR"})

golden("salary_kinds", cat.salary_kind, [("20 triệu", "numeric"), ("Thỏa thuận", "negotiable"), (" ", "missing")], {"kind": "VARCHAR"})

golden("clean_companies", lambda c: {"flat": text.clean_company_name(c), "star": text.clean_company_name_star(c)}, [
    ("Công ty TNHH ABC", "ABC", "ABC"), (None, "Không rõ", "Unknown Company"), ("", "Không rõ", "Unknown Company"),
], {"flat": "VARCHAR", "star": "VARCHAR"})

golden("clean_titles", text.clean_job_title, [("[HCM] Tuyển gấp Java Dev (Hà Nội) - Lương 20 triệu", "Java Dev"), (None, "")], {"title": "VARCHAR"})

golden("plain_texts", lambda c: {"plain": text.strip_accents(c), "fixed": text.fix_encoding(c)}, [("ĐẶNG Thị Ước", "dang thi uoc", "ĐẶNG Thị Ước"), ("Café", "cafe", "Café"), ("  Software    Engineer   \t\n  ", "  software    engineer   \t\n  ", "Software Engineer")], {"plain": "VARCHAR", "fixed": "VARCHAR"})

golden("relative_deadlines", lambda c: parse.parse_relative_deadline(c, F.lit("2026-10-11").cast("date")), [
    ("Hạn nộp hồ sơ: Còn 15 ngày", "2026-10-26"), ("Urgent: 5 days left", "2026-10-16"), ("Hôm nay hết hạn", "2026-10-11"), ("Hạn chót: 30/11/2026", "2026-11-30"), ("Còn 3 giờ", "2026-10-11"), ("x", ""), (None, ""),
], {"deadline": "VARCHAR"})


def _deadline(c: Column) -> dict[str, Column]:
    found = parse.parse_deadline(c, F.lit("2026-10-01").cast("date"))
    return {"deadline": found["deadline"], "active": found["is_active"]}


golden("deadlines", _deadline, [("2026-09-30", "2026-09-30", False), ("2026-10-01T10:00:00", "2026-10-01", True), ("soon enough", "soon enoug", True), (None, None, True)], {"deadline": "VARCHAR", "active": "BOOLEAN"})

golden("tech_tokens", lambda c: F.array_join(text.tokens(c), " "), [("C++ C# .NET CI/CD Node.js", "cpp csharp dotnet cicd nodejs"), ("kinh nghiệm lập trình", "kinh nghiệm lập trình")], {"words": "VARCHAR"})

golden("bigrams", lambda c: F.array_join(text.ngrams(text.tokens(c)), "|"), [("aa bb cc", "aa|bb|cc|aa bb|bb cc"), ("aa", "aa"), ("", "")], {"grams": "VARCHAR"})

_SKILLS = {"c++": "C++", "c#": "C#", ".net": ".NET", "ci/cd": "CI/CD", "cv": "Computer Vision", "go": "Golang", "python": "Python"}

golden("text_skills", lambda c: F.array_join(sk.scan_text(c, _SKILLS, cat.AMBIGUOUS_SKILLS), "|"), [("C++, C#, .NET Core, CI/CD. Gửi CV. Go to market", "C++|C#|.NET|CI/CD"), (None, "")], {"skills": "VARCHAR"})


def _tags(c: Column) -> dict[str, Column]:
    found = sk.skills_and_tags(c, F.lit("go with python"), _SKILLS, cat.JUNK_TAGS, cat.AMBIGUOUS_SKILLS)
    return {"skills": F.array_join(found["skills"], "|"), "tags": F.array_join(found["tags"], "|")}


golden("tag_skills", _tags, [("C++; Thưởng tết | Fintech, c++", "C++|Python", "Fintech"), ("Bảo hiểm, CV", "Computer Vision|Python", ""), (None, "Python", "")], {"skills": "VARCHAR", "tags": "VARCHAR"})
