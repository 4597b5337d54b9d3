"""Values as text for people."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def millions(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0)) / 1_000_000, 1)


def compact_millions(c: Column) -> Column:
    """Millions without decimals where they are within 0.05 of a whole number."""
    m = c / 1_000_000
    return F.when(F.abs(m - F.round(m)) < 0.05, F.format_string("%d", F.round(m).cast("long"))).otherwise(F.format_string("%.1f", m))


def salary_text(low: Column, high: Column) -> Column:
    a, b = compact_millions(low), compact_millions(high)
    unit = F.lit(" triệu")
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, F.concat(a, unit)).otherwise(F.concat(a, F.lit(" - "), b, unit)))
        .when(low.isNotNull(), F.concat(F.lit("Từ "), a, unit))
        .when(high.isNotNull(), F.concat(F.lit("Tới "), b, unit))
        .otherwise("Thỏa thuận")
    )


def day_text(c: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_date(F.substring(c.cast("string"), 1, 10)), "dd/MM/yyyy"), F.lit(""))


def embedding_text(title: Column, company: Column, seniority: Column, skills: Column, requirements: Column, description: Column) -> Column:
    """Labelled parts for an encoder; requirements up to 450 and description up to 350 characters, unknown seniority left out."""
    known = F.when(~seniority.isin("Chưa xác định", "Undetermined"), F.concat(F.lit("Cấp bậc: "), seniority))
    parts = [F.concat(F.lit("Vị trí: "), title), F.concat(F.lit("Công ty: "), company), known, F.concat(F.lit("Kỹ năng: "), F.nullif(skills, F.lit(""))), F.concat(F.lit("Yêu cầu: "), F.substring(requirements, 1, 450)), F.concat(F.lit("Mô tả: "), F.substring(description, 1, 350))]
    return F.concat_ws(". ", *parts)


def rationale(match: Column, text_score: Column, cf_percentile: Column | None = None) -> Column:
    """Why a job was recommended, from a skills.split_match() struct."""
    parts = [
        F.when(F.size(match["exact"]) > 0, F.concat(F.lit("Khớp: "), F.array_join(F.slice(match["exact"], 1, 5), ", "))),
        F.when(F.size(match["related"]) > 0, F.concat(F.lit("Gần: "), F.array_join(F.slice(match["related"], 1, 3), ", "))),
        F.when(F.size(match["missing"]) > 0, F.concat(F.lit("Thiếu: "), F.array_join(F.slice(match["missing"], 1, 3), ", "))),
        F.when(text_score >= 0.5, F.lit("Nội dung rất gần hồ sơ")),
    ]
    if cf_percentile is not None:
        parts.append(F.when(cf_percentile >= 80, F.lit("Người dùng tương tự quan tâm")))
    return F.concat_ws(" · ", *parts)
