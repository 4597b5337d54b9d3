"""Golden values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import categorize, formats, parse, skills, text

M, USD = 1_000_000, 25_400


def one(spark, expression, schema, *values):
    return spark.createDataFrame([values], schema).select(expression.alias("v")).first().v


def table(spark, expression, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.v for r in frame.orderBy("i").select(expression.alias("v")).collect()]


C = F.col


def test_salaries(spark):
    cases = {
        "15 - 20 triệu": (15 * M, 20 * M), "Tới 30 triệu": (None, 30 * M), "Từ 10 triệu": (10 * M, None), "15tr-20tr": (15 * M, 20 * M), "$ 1,000 - 2,000": (1000 * USD, 2000 * USD),
        "Thỏa thuận": (None, None), "": (None, None), None: (None, None), "14000000 - 18000000 MONTH": (14 * M, 18 * M), "200tr-500tr ₫/năm": (200 * M / 12, 500 * M / 12), "$ 24,000-29,000 /năm": (2000 * USD, 29000 * USD / 12),
        "500 - 2000": (500 * USD, 2000 * USD), "Lên tới 3000": (None, 3000 * USD), "$ 1-1 /tháng": (None, None), "S$ 110,000-220,000 /tháng": (None, None), "23000": (None, None), "500000": (None, None), "Tới 0.5 triệu": (None, None),
    }
    got = table(spark, parse.parse_salary_vnd(C("c")), list(cases))
    assert [(g.min, g.max) for g in got] == [tuple(None if v is None else pytest.approx(v) for v in e) for e in cases.values()]
    both = parse.parse_salary_vnd(C("a"), C("b"))
    for salary, title, expected in (("20 - 30 triệu", "Dev 10 - 15M", (20 * M, 30 * M)), ("Thỏa thuận", "Backend Dev 15 - 20M", (15 * M, 20 * M)), ("", "Dev 3 - 5 Mobile", (None, None))):
        got = one(spark, both, "a string, b string", salary, title)
        assert (got.min, got.max) == expected


def test_star_salaries(spark):
    values = ["15 - 20 triệu", "$ 1,000 - 2,000", "Up to $2000", "Thương lượng", None, "10,000,000 - 18,000,000", "Từ 10 triệu", "$ 1-1", "500"]
    got = table(spark, parse.parse_salary_star(C("c")), values)
    assert [(g.salary_type, g.salary_currency, g.salary_min_vnd, g.salary_max_vnd) for g in got] == [
        ("range", "VND", 15 * M, 20 * M), ("range", "USD", 1000 * USD, 2000 * USD), ("max_only", "USD", None, 2000 * USD), ("negotiable", "VND", None, None), ("undisclosed", "VND", None, None),
        ("range", "VND", 10 * M, 18 * M), ("min_only", "VND", 10 * M, None), ("negotiable", "USD", None, None), ("fixed", "USD", 500 * USD, 500 * USD),
    ]


def test_cities(spark):
    cases = {
        "hanoi": "Hà Nội", "Ha Noi, Vietnam": "Hà Nội", "Cầu Giấy, Hà Nội": "Hà Nội", "district 1, ho chi minh city, vietnam": "Hồ Chí Minh", "Sài Gòn": "Hồ Chí Minh", "Quận Hải Châu, Đà Nẵng": "Đà Nẵng", "Hà Nội; Hồ Chí Minh": "Hà Nội",
        "Hồ Chí Minh; Hà Nội": "Hồ Chí Minh", "kcn Quế Võ, Bắc Ninh": "Khác", "Thanh Hóa": "Khác", "remote vietnam": "Toàn quốc", "": "Toàn quốc", None: "Toàn quốc",
    }
    assert table(spark, categorize.extract_city(C("c")), list(cases)) == list(cases.values())
    assert table(spark, categorize.city_star(C("c")), ["TP.HCM", "Hải Phòng", "x", "HN"]) == ["Hồ Chí Minh", "Hải Phòng", "Khác", "Hà Nội"]


def test_company_and_title_keys(spark):
    a, b = table(spark, text.company_key(C("c")), ["Thương Mại và Truyền Thông HTC", "Truyền thông & Thương mại HTC"])
    assert a == b
    pair = "a string, b string"
    fits = text.companies_compatible(text.company_tokens(C("a")), text.company_tokens(C("b")))
    assert one(spark, fits, pair, "MBBANK", "NGÂN HÀNG TMCP QUÂN ĐỘI – MBBANK") and not one(spark, fits, pair, "FPT Software", "Viettel")
    assert table(spark, text.title_key(C("c")), ["FullStack Developer (2025TD943)", None]) == ["fullstack developer", ""]
    assert table(spark, text.clean_company_name(C("c")), ["Công ty TNHH ABC", "XYZ JSC", "", None]) == ["ABC", "XYZ", "Không rõ", "Không rõ"]
    assert table(spark, text.clean_company_name_star(C("c")), ["CÔNG TY CỔ PHẦN Đất Việt - Chi nhánh HN", None]) == ["Đất Việt", "Unknown Company"]
    assert table(spark, text.clean_job_title(C("c")), ["[HCM] Tuyển gấp Java Dev (Hà Nội) - Lương 20 triệu", None]) == ["Java Dev", ""]
    assert table(spark, text.strip_accents(C("c")), ["ĐẶNG Thị Ước", "Café"]) == ["dang thi uoc", "cafe"]


def test_html_and_white_space(spark):
    raw = "<div><p>Hello <b>World</b></p><br/><ul><li>Item 1</li><li>• Item 2</li></ul></div>&amp;"
    assert table(spark, text.clean_html(C("c")), [raw, None]) == ["Hello World\nItem 1\n- Item 2\n&", ""]
    assert table(spark, text.fix_encoding(C("c")), ["  Software    Engineer   \t\n  "]) == ["Software Engineer"]


def test_tokens(spark):
    got = table(spark, text.tokens(C("c")), ["C++ C# .NET CI/CD Node.js", "kinh nghiệm lập trình"])
    assert got == [["cpp", "csharp", "dotnet", "cicd", "nodejs"], ["kinh", "nghiệm", "lập", "trình"]]
    assert table(spark, text.ngrams(C("c")), [["a", "b", "c"], ["a"], []], "array<string>") == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_skills(spark):
    names = {"c++": "C++", "c#": "C#", ".net": ".NET", "ci/cd": "CI/CD", "cv": "Computer Vision", "go": "Golang", "python": "Python"}
    found = table(spark, skills.scan_text(C("c"), names, frozenset({"cv", "go"})), ["C++, C#, .NET Core, CI/CD. Gửi CV. Go to market", None])
    assert found == [["C++", "C#", ".NET", "CI/CD"], []]
    tagged = one(spark, skills.skills_and_tags(C("c"), F.lit("knows python"), names, "thưởng|bảo hiểm"), "c string", "C++; Thưởng tết | Fintech, c++")
    assert tagged.skills == ["C++", "Python"] and tagged.tags == ["Fintech"]
    groups = [["PostgreSQL", "MySQL"], ["Vue", "React"]]
    match = one(spark, skills.split_match(C("a"), C("b"), groups), "a array<string>, b array<string>", ["PostgreSQL", "Vue"], ["MySQL", "React", "Docker"])
    assert (match.exact, match.related, match.missing) == ([], ["mysql", "react"], ["docker"])
    layer = skills.layered_evidence(F.lit("Python"), F.lit(r"\bpython\b"), C("a"), C("b"), C("c"), C("d"), C("e"))
    schema = "a array<string>, b array<string>, c string, d string, e string"
    cases = [((["python"], None, None, None, None), ("required", "tag")), ((None, ["Python"], "Python dev", None, None), ("preferred", "tag")), ((None, None, "Python dev", "", ""), ("required", "title")), ((None, None, "Dev", "Ưu tiên biết Python", ""), ("preferred", "requirements")), ((None, None, "Dev", "", "write Python"), ("required", "responsibilities"))]
    for values, expected in cases:
        got = one(spark, layer, schema, *values)
        assert (got.type, got.method) == expected
    assert one(spark, layer, schema, None, None, "x", "y", "z") is None


def test_trade_filter(spark):
    check = categorize.is_trade_job(C("a"), C("b"))
    schema = "a string, b array<string>"
    assert one(spark, check, schema, "Senior Backend Developer", None) and one(spark, check, schema, "Chuyên viên", ["Python", "SQL"])
    assert not one(spark, check, schema, "Nhân viên thiết kế đồ họa", ["Photoshop"]) and not one(spark, check, schema, None, None)
    for title in ("Lập trình viên", "QA", "Data Scientist", "AI Researcher", "Chuyên viên PHẦN MỀM", "Nhân viên IT", "DBA/ETL", "kỹ sư cầu nối BrSE", ".NET", "low-code"):
        assert one(spark, check, schema, title, None), title
    for title in ("E-learning content writer", "Machine operator", "Writer", "Nhân viên kinh doanh", "Maid", "Database".replace("Data", "Gym")):
        assert not one(spark, check, schema, title, None), title
    assert not one(spark, check, schema, "x", ["Python", "python ", "PYTHON"]) and one(spark, check, schema, "x", ["Python ", "CI/CD"])
    assert one(spark, categorize.is_trade_job(C("a"), C("b"), "baker", ("bread",), 1), schema, "x", ["Bread"])
    names = {"python": "Python", "go": "Golang"}
    tagged = one(spark, skills.skills_and_tags(C("c"), F.lit("go python"), names, categorize.JUNK_TAGS, categorize.AMBIGUOUS_SKILLS), "c string", "Bảo hiểm | Fintech | Du lịch hè | Team  building")
    assert tagged.skills == ["Python"] and tagged.tags == ["Fintech"]


def test_dates(spark):
    base = F.lit(dt.date(2026, 10, 11))
    values = ["Hạn nộp hồ sơ: Còn 15 ngày", "Urgent: 5 days left", "Hôm nay hết hạn", "Hạn chót: 30/11/2026", "Còn 3 giờ", "x", None]
    assert table(spark, parse.parse_relative_deadline(C("c"), base), values) == ["2026-10-26", "2026-10-16", "2026-10-11", "2026-11-30", "2026-10-11", "", ""]
    got = table(spark, parse.parse_deadline(C("c"), F.lit(dt.date(2026, 10, 1))), ["2026-09-30", "2026-10-01T10:00:00", "soon enough", None])
    assert [(g.deadline, g.is_active) for g in got] == [("2026-09-30", False), ("2026-10-01", True), ("soon enoug", True), (None, True)]
    fresh = parse.refresh_is_active(C("a"), C("b"), F.lit(dt.date(2026, 10, 1)))
    rows = [("2026-09-30", True), ("2026-10-01", False), ("bad", True), (None, False), (None, None)]
    assert [one(spark, fresh, "a string, b boolean", *r) for r in rows] == [False, True, True, False, True]


def test_experience_and_size(spark):
    got = table(spark, parse.parse_experience(C("c")), ["2 - 3 năm", "Trên 5 năm", "dưới 1 năm", "6 tháng", "Không yêu cầu", "3 năm", "", "fresher", "2 năm trở lên"])
    assert [(g.min, g.max) for g in got] == [(2, 3), (5, None), (0, 1), (0.5, 0.5), (0, 0), (3, 3), (None, None), (0, 0), (2, None)]
    got = table(spark, parse.parse_company_size(C("c")), ["100-499", "1.000+", "hơn 500", "< 20", "ít hơn 20", "dưới 20"])
    assert [(g.min, g.max) for g in got] == [(100, 499), (1000, None), (500, None), (1, 20), (20, None), (None, None)]
    got = table(spark, parse.website_domain(C("c")), ["https://www.ABC.com:8080/x", "abc.vn", "https://topcv.vn/c", "localhost", None])
    assert got == ["abc.com:8080", "abc.vn", None, None, None]


def test_categories(spark):
    assert table(spark, categorize.seniority(C("c")), ["Giám đốc", "Senior Team Lead", "Thực tập sinh", "Dev", "Senior Dev"]) == ["Director", "Lead", "Intern", "Undetermined", "Senior"]
    assert table(spark, categorize.work_mode(C("c")), ["Làm từ xa", "Hybrid", None]) == ["Remote", "Hybrid", "Onsite"]
    assert table(spark, categorize.employment_type(C("c")), ["Thực tập", "bán thời gian", "freelance", None]) == ["Intern", "Part-time", "Contract", "Full-time"]
    assert table(spark, categorize.education(C("c")), ["Cử nhân CNTT", "Cao đẳng", None]) == ["Đại học", "Cao đẳng", "Không yêu cầu"]
    vi, en = "Chúng tôi cần tuyển lập trình viên có kinh nghiệm", "We are looking for a developer with experience, team skills"
    assert table(spark, categorize.language_profile(C("c")), [vi, en, "short", vi + " " + en]) == ["vi", "en", "unknown", "mixed"]
    assert table(spark, categorize.language_star(C("c")), [vi, en + " and the requirements", None]) == ["vi", "en", "vi"]
    assert table(spark, categorize.salary_kind(C("c")), ["20 triệu", "Thỏa thuận", " "]) == ["numeric", "negotiable", "missing"]


def test_formats(spark):
    assert one(spark, formats.salary_text(C("a"), C("b")), "a double, b double", 15e6, 20.5e6) == "15 - 20.5 triệu"
    assert one(spark, formats.salary_text(C("a"), C("b")), "a double, b double", None, None) == "Thỏa thuận"
    assert table(spark, formats.day_text(C("c")), ["2026-11-30", None]) == ["30/11/2026", ""]
    assert table(spark, text.snippet(C("c"), 3), ["abcd", "abc", None]) == ["abc...", "abc", ""]
