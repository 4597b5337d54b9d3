"""Typed values from free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank, contains_any, present, strip

# Fixed values.
VND_PER_USD = 25_400
MONTHLY_MIN, MONTHLY_MAX = 1_000_000, 300_000_000
NEGOTIABLE = ("thương lượng", "cạnh tranh", "thoa thuan", "thỏa thuận", "negotiable", "deal")
AT_MOST = ("tới", "up to", "dưới", "<", "tối đa")
AT_LEAST = ("từ", "trên", ">=", "tối thiểu", "from", ">")
NUMBER = r"\d+(?:,\d+)*(?:\.\d+)?"
PORTALS = ("topcv.vn", "vietnamworks.com", "topdev.vn", "saramin.vn", "itviec.com")


def _numbers(c: Column, pattern: str = NUMBER, comma: str = "") -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(comma)).try_cast("double"))


def _bounds(low, high) -> Column:
    return F.struct(low.cast("double").alias("min"), high.cast("double").alias("max"))


def _none() -> Column:
    return F.lit(None).cast("double")


def salary_from_title(title: Column) -> Column:
    """struct(min, max) of a range with a unit, as in "15 - 20M"."""
    pattern = r"(?iU)(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*(m|tr|triệu|usd|\$)(?![a-zà-ỹ])"
    low, high = (F.regexp_extract(title, pattern, i).try_cast("double") for i in (1, 2))
    factor = F.when(F.lower(F.regexp_extract(title, pattern, 3)).isin("usd", "$"), VND_PER_USD).otherwise(1_000_000)
    return _bounds(F.least(low, high) * factor, F.greatest(low, high) * factor)


def parse_salary_vnd(salary: Column, title: Column | None = None) -> Column:
    """struct(min, max) in VND a month; the title's range counts only if the text has neither bound; bounds that no monthly salary has are null."""
    s = F.lower(strip(salary))
    numbers = _numbers(s)
    million = s.rlike(r"(?U)\d\s*(?:tr|triệu|trieu|m)\b") | F.contains(s, F.lit("triệu"))
    usd = (F.contains(s, F.lit("$")) | F.contains(s, F.lit("usd"))) & ~million
    bare = ~s.rlike(r"(?U)₫|vnd|đ\b")
    factor = (
        F.when(usd, VND_PER_USD)
        .when(million, 1_000_000)
        .when(bare & F.forall(numbers, lambda n: n < 100), 1_000_000)
        .when(bare & F.forall(numbers, lambda n: n.between(100, 20_000)), VND_PER_USD)
        .otherwise(1)
    )
    year = F.when(s.rlike(r"/\s*năm|/\s*year|per year|annual|/\s*yr"), 12).otherwise(1)
    a, b = (F.get(numbers, F.lit(i)) * factor / year for i in (0, 1))
    read = (
        F.when(blank(salary) | contains_any(s, NEGOTIABLE) | (F.size(numbers) == 0), _bounds(_none(), _none()))
        .when(F.size(numbers) >= 2, _bounds(F.least(a, b), F.greatest(a, b)))
        .when(contains_any(s, AT_MOST), _bounds(_none(), a))
        .when(contains_any(s, AT_LEAST), _bounds(a, _none()))
        .otherwise(_bounds(a, a))
    )
    if title is not None:
        other = salary_from_title(title)
        read = F.when(read["min"].isNull() & read["max"].isNull(), other).otherwise(read)

    def plausible(v):
        return F.when(v.between(MONTHLY_MIN, MONTHLY_MAX), v)

    return _bounds(plausible(read["min"]), plausible(read["max"]))


def parse_salary_star(salary: Column) -> Column:
    """The star path's seven fields: salary_min, salary_max, salary_currency, salary_period, salary_type, salary_min_vnd, salary_max_vnd.

    Any "m" or "tr" makes the amounts millions, as that path has it.
    """
    raw, s = strip(salary), F.lower(strip(salary))
    yearly = contains_any(s, ("/năm", "năm", "year"))
    period = F.when(yearly, "yearly").otherwise("monthly")

    def fields(low, high, kind, currency="VND", factor=F.lit(1.0), when=period):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            low.cast("double").alias("salary_min"), high.cast("double").alias("salary_max"), F.lit(currency).alias("salary_currency"),
            when.alias("salary_period"), kind.alias("salary_type"), (low * factor).cast("double").alias("salary_min_vnd"), (high * factor).cast("double").alias("salary_max_vnd"),
        )

    nothing = fields(_none(), _none(), "undisclosed", when=F.lit("monthly"))
    at_most, at_least = contains_any(s, AT_MOST), contains_any(s, AT_LEAST)
    is_usd = (F.contains(s, F.lit("$")) | F.contains(s, F.lit("usd"))) & ~F.contains(s, F.lit("tr"))
    n = _numbers(raw)
    a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    rate = F.when(yearly, F.lit(VND_PER_USD / 12)).otherwise(F.lit(float(VND_PER_USD)))
    up_to = contains_any(s, AT_MOST[:4])
    usd = (
        F.when((F.size(n) >= 2) & (a <= 10) & (b <= 10), fields(_none(), _none(), "negotiable", "USD"))
        .when(F.size(n) >= 2, fields(F.least(a, b), F.greatest(a, b), "range", "USD", rate))
        .when(a <= 10, fields(_none(), _none(), "negotiable", "USD"))
        .when(up_to, fields(_none(), a, "max_only", "USD", rate))
        .otherwise(fields(a, a, "fixed", "USD", rate))
    )
    m = F.transform(_numbers(raw, r"\d+(?:[.,]\d+)?", "."), lambda v: F.when(v > 1000, v / 1_000_000).otherwise(v))
    c, d = F.get(m, F.lit(0)) * 1_000_000, F.get(m, F.lit(1)) * 1_000_000
    same = F.when(c == d, "fixed").otherwise("range")

    def single(v, otherwise="fixed"):
        return F.when(at_least, fields(v, _none(), "min_only")).when(at_most, fields(_none(), v, "max_only")).otherwise(fields(v, v, otherwise))

    million = F.when(F.size(m) >= 2, fields(F.least(c, d), F.greatest(c, d), same)).otherwise(single(c))
    plain = F.filter(_numbers(raw, r"\d+(?:,\d{3})*(?:\.\d+)?"), lambda v: v > 100)
    e, f = F.get(plain, F.lit(0)), F.get(plain, F.lit(1))
    vnd = (
        F.when(F.size(plain) >= 2, fields(F.least(e, f), F.greatest(e, f), F.when(e == f, "fixed").otherwise("range")))
        .when(e <= 1000, fields(e, e, "fixed", "USD", F.lit(float(VND_PER_USD))))
        .when(F.size(plain) == 1, single(e))
        .otherwise(fields(_none(), _none(), "undisclosed"))
    )
    return (
        F.when(salary.isNull() | (salary == ""), nothing)
        .when(contains_any(s, NEGOTIABLE), fields(_none(), _none(), "negotiable", when=F.lit("monthly")))
        .when(is_usd & (F.size(n) > 0), usd)
        .when(contains_any(s, ("tr", "m")) & (F.size(m) > 0), million)
        .otherwise(vnd)
    )


def salary_range_raw(salary: Column) -> Column:
    """struct(low, high, unit) of the first "a - b", for sanity checks; null without one or if negotiable. Signs are kept."""
    s = F.lower(strip(salary))
    clean = F.replace(s, F.lit(","), F.lit(""))
    pattern = r"(?U)(-?\d+(?:\.\d+)?)\s*(?:-|đến|to)\s*(-?\d+(?:\.\d+)?)"
    low, high = (F.regexp_extract(clean, pattern, i).try_cast("double") for i in (1, 2))
    unit = (
        F.when(F.greatest(F.abs(low), F.abs(high)) >= 500_000, "vnd")
        .when(contains_any(s, ("$", "usd", "đô")), "usd")
        .when(F.contains(s, F.lit("triệu")) | s.rlike(r"(?U)\b(?:tr|m)\b|\d+\s*(?:tr|m)\b"), "trieu")
        .when(contains_any(s, ("vnd", "vnđ", "đồng")), "vnd")
        .otherwise("unknown")
    )
    fits = low.isNotNull() & high.isNotNull() & ~contains_any(s, ("thỏa thuận", "thoả thuận", "thương lượng", "negotiable", "cạnh tranh"))
    return F.when(fits, F.struct(low.alias("low"), high.alias("high"), unit.alias("unit")))


def _experience(c: Column, none_words, months: bool) -> Column:
    s = F.lower(strip(c))

    def group(pattern, i=1):
        return F.regexp_extract(s, f"(?U){pattern}", i).try_cast("double")

    # The forms of required years.
    between = r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*năm"
    least = r"(?:trên|từ|tối thiểu|\+)\s*(\d+(?:\.\d+)?)\s*năm|(\d+(?:\.\d+)?)\s*(?:\+|năm trở lên)"
    most = r"dưới\s*(\d+(?:\.\d+)?)\s*năm"
    exact = r"(\d+(?:\.\d+)?)\s*năm"
    zero = F.lit(0.0)
    found = (
        F.when(c.isNull() | (c == ""), _bounds(_none(), _none()))
        .when(contains_any(s, none_words), _bounds(zero, zero))
        .when(group(between).isNotNull(), _bounds(group(between), group(between, 2)))
        .when(s.rlike(f"(?U){least}"), _bounds(F.coalesce(group(least), group(least, 2)), _none()))
        .when(group(most).isNotNull(), _bounds(zero, group(most)))
    )
    if months:
        m = F.bround(group(r"(\d+)\s*tháng") / 12, 1)
        found = found.when(m.isNotNull(), _bounds(m, m))
    return found.otherwise(_bounds(group(exact), group(exact)))


def parse_experience(c: Column) -> Column:
    """struct(min, max) in years, the flat path's rule."""
    return _experience(c, ("không yêu cầu", "chưa có kinh nghiệm", "không cần", "fresher", "intern"), True)


def parse_experience_star(c: Column) -> Column:
    return _experience(c, ("không yêu cầu", "chưa có kinh nghiệm", "không cần"), False)


def experience_bucket(low: Column, high: Column) -> Column:
    """Ranges of required years; the first that fits."""
    return (
        F.when((low == 0) & (high.isNull() | (high <= 1)), "0 năm (Fresher/Intern)")
        .when((low == 1) | (high == 1), "1 năm")
        .when(low.between(2, 3), "2 - 3 năm")
        .when((low > 3) & (low <= 5), "3 - 5 năm")
        .when(low > 5, "Trên 5 năm")
        .otherwise("Không yêu cầu / Chưa rõ")
    )


def parse_company_size(c: Column) -> Column:
    """struct(min, max) of employees."""
    s = F.replace(strip(c), F.lit("."), F.lit(""))

    def number(pattern, i=1):
        return F.regexp_extract(s, f"(?iU){pattern}", i).try_cast("int")

    def pair(a, b):
        return F.struct(a.cast("int").alias("min"), b.cast("int").alias("max"))

    none = F.lit(None).cast("int")
    between, plus, more, less = r"(\d+)\s*[-–]\s*(\d+)", r"(\d+)\s*\+", r"(?:hơn|trên)\s*(\d+)", r"(?:ít hơn|dưới|<\s*)(\d+)"
    return (
        F.when(number(between).isNotNull(), pair(number(between), number(between, 2)))
        .when(number(plus).isNotNull(), pair(number(plus), none))
        .when(number(more).isNotNull(), pair(number(more), none))
        .when(number(less).isNotNull(), pair(F.lit(1), number(less)))
        .otherwise(pair(none, none))
    )


def parse_date(c: Column) -> Column:
    """The timestamp of an ISO string, or of yyyy-MM-dd, dd/MM/yyyy or yyyy/MM/dd at its start."""
    s = strip(c)
    start = F.substring(s, 1, 10)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(s))
    formats = [F.try_to_timestamp(start, F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd")]
    return F.coalesce(iso, *formats)


def parse_deadline(c: Column, today: Column) -> Column:
    """struct(deadline as text, is_active); what can't be read keeps its first ten characters and is active."""
    start = F.substring(strip(c), 1, 10)
    day = F.when(start.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(start))
    text = F.when(c.isNull() | (c == ""), None).otherwise(F.coalesce(F.date_format(day, "yyyy-MM-dd"), start))
    return F.struct(text.alias("deadline"), F.coalesce(day >= today, F.lit(True)).alias("is_active"))


def refresh_is_active(deadline: Column, is_active: Column, today: Column) -> Column:
    """A readable deadline decides; otherwise the old flag, null being true."""
    day = F.try_to_date(F.substring(deadline, 1, 10))
    return F.coalesce(day >= today, is_active, F.lit(True))


def parse_relative_deadline(c: Column, base: Column) -> Column:
    """yyyy-MM-dd from days left, "expires today", hours left, or a written day dd/mm/yyyy; empty for anything else."""
    text = F.coalesce(c, F.lit(""))

    def number(pattern):
        return F.regexp_extract(text, f"(?iU){pattern}", 1).try_cast("int")

    days = F.coalesce(number(r"(?:còn lại|còn|hết hạn trong|hạn nộp)\s*(\d+)\s*ngày"), number(r"(\d+)\s*days?\s*left"))
    today = text.rlike(r"(?iU)hôm nay hết hạn|hết hạn hôm nay|expires today|(?:còn|hết hạn trong)\s*\d+\s*(?:giờ|hours?)")
    day, month, year = (F.regexp_extract(text, r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", i) for i in (1, 2, 3))
    written = F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    return F.coalesce(F.date_format(F.date_add(base, days), "yyyy-MM-dd"), F.when(today, F.date_format(base, "yyyy-MM-dd")), written, F.lit(""))


def clean_date(c: Column) -> Column:
    """Dates of fewer than eight characters are missing."""
    return F.when(F.length(strip(c)) >= 8, strip(c))


def batch_id(crawled_at: Column, fallback: Column) -> Column:
    day = F.coalesce(F.when(F.length(crawled_at) >= 10, F.substring(crawled_at, 1, 10)), fallback)
    return F.concat(F.lit("batch_"), F.replace(day, F.lit("-"), F.lit("")))


def website_domain(url: Column) -> Column:
    """The host (and port) of an address without www; null for job portals and for hosts without a dot."""
    s = strip(present(url))
    full = F.when(s.rlike("^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    host = F.regexp_replace(F.lower(F.regexp_extract(full, r"^https?://([^/?#]*)", 1)), r"^www\.", "")
    return F.when(F.contains(host, F.lit(".")) & ~host.isin(*PORTALS), host)


def json_ld_salary(low: Column, high: Column, value: Column, currency: Column) -> Column:
    """The salary text of a JSON-LD posting."""
    money = F.coalesce(currency, F.lit("VND"))

    def shown(v):
        return F.format_number(v, 0)

    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(shown(low), F.lit(" - "), shown(high), F.lit(" "), money))
        .when(low.isNotNull(), F.concat(F.lit("Từ "), shown(low), F.lit(" "), money))
        .when(high.isNotNull(), F.concat(F.lit("Tới "), shown(high), F.lit(" "), money))
        .when(value.isNotNull(), F.concat(shown(value), F.lit(" "), money))
    )
