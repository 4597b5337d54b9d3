"""Filters, statistics and reports of the market analyses that are not part of the star's gold layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank, strip, word_count

# What salaries count as plausible.
MOST_SALARY = 80_000_000
MIN_RANGE_M, MAX_RANGE_M = (5, 150), (5, 200)
MOST_EXPERIENCE = 10


def plausible_salary(low: Column, high: Column, strict: bool = False) -> Column:
    """Whether the upper bound is positive and at most MOST_SALARY; strict: whether both bounds lie in their ranges of millions. Null is implausible."""
    if strict:
        return F.coalesce((low / 1e6).between(*MIN_RANGE_M) & (high / 1e6).between(*MAX_RANGE_M), F.lit(False))
    return F.coalesce((high > 0) & (high <= MOST_SALARY), F.lit(False))


def within_experience(frame: DataFrame, column: str = "experience_min", most: float = MOST_EXPERIENCE) -> DataFrame:
    return frame.where(F.col(column) <= most)


def matching_rows(frame: DataFrame, column: str, pattern: str, order: list[str], n: int, **equal) -> DataFrame:
    """The first n rows, in the given order, whose column matches the pattern and whose others equal the given values."""
    out = frame.where(F.col(column).rlike(pattern))
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out.orderBy(*order).limit(n)


def active_in(opened: Column, closed: Column, start: Column, end: Column) -> Column:
    """Whether a posting is open at some time from start up to end."""
    return (closed >= start) & (opened < end)


def alive_on(opened: Column, closed: Column, day: Column) -> Column:
    return day.between(opened, closed)


def with_records(jobs: DataFrame, records: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """Jobs that have a source record which meets the condition, with its columns."""
    return jobs.join(records if condition is None else records.where(condition), key)


def reindexed(frame: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of frame in the roles of ids, and the ids that frame lacks, which should be none."""
    return ids.select(key).join(frame, key), ids.select(key).join(frame.select(key), key, "left_anti")


def skill_lists(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """Each job's distinct skill names as a sorted array, empty without any."""
    named = job_skills.join(skills, "skill_id", "left").groupBy("job_id").agg(F.array_sort(F.collect_set("skill_name")).alias("skills"))
    return jobs.select("job_id").join(named, "job_id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def median_in_millions(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.round(F.percentile(F.col(column).cast("double"), 0.5) / 1e6, 1).alias("median_m"))


def skill_frequency(frame: DataFrame, column: str, k: int | None = None, separator: str = ",") -> DataFrame:
    """How many rows name each skill of a separated text, the share of all rows in percent, most frequent first."""
    names = F.filter(F.transform(F.split(F.col(column), separator), lambda s: strip(s)), lambda s: s != "")
    counts = frame.select(F.explode(F.array_distinct(names)).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    out = counts.crossJoin(F.broadcast(frame.agg(F.count("*").alias("_all"))))  # one row
    out = out.select("skill", "n", F.round(100 * F.col("n") / F.col("_all"), 2).alias("pct")).orderBy(F.col("n").desc(), "skill")
    return out if k is None else out.limit(k)


def skill_density(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Distinct skills a job: mean, median, most, and the share of jobs with any, in percent."""
    counts = jobs.select("job_id").join(job_skills.groupBy("job_id").agg(F.count_distinct("skill_id").alias("n")), "job_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    # the counts are few different numbers, so the median comes from a table of them
    spread = counts.groupBy("n").agg(F.count("*").alias("jobs"))
    return spread.agg(
        F.round(F.sum(F.col("n") * F.col("jobs")) / F.sum("jobs"), 2).alias("mean"), F.percentile("n", 0.5, F.col("jobs")).alias("median"),
        F.max("n").alias("most"), F.round(100 * F.sum(F.when(F.col("n") > 0, F.col("jobs")).otherwise(0)) / F.sum("jobs"), 2).alias("with_any_pct"),
    )


def binned(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval (edges[i], edges[i + 1]] that holds the value; null outside of all."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((c > low) & (c <= high), label)
    return out


def bin_counts(frame: DataFrame, column: str, edges: list[float], labels: list[str]) -> DataFrame:
    return frame.groupBy(binned(F.col(column), edges, labels).alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")


def average_by_date(frame: DataFrame, at: str, column: str) -> DataFrame:
    return frame.groupBy(F.to_date(at).alias("day")).agg(F.count(column).alias("n"), F.round(F.avg(column), 0).alias("average"))


def top_components(scored: DataFrame, parts: list[str], k: int = 10, by: str = "score", ties: str = "job_id") -> DataFrame:
    """The component columns' means over the k best rows."""
    return scored.orderBy(F.col(by).desc(), ties).limit(k).agg(*[F.round(F.avg(p), 4).alias(p) for p in parts])


def source_contribution(records: DataFrame, source: str, url: str) -> DataFrame:
    """Records of each source, their share in percent, and one URL as a sample (the least)."""
    counts = records.groupBy(source).agg(F.count("*").alias("n"), F.min(url).alias("sample_url"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumn("pct", F.round(100 * F.col("n") / F.col("_all"), 2)).drop("_all")


def pattern_coverage(docs: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """How many documents match each named pattern, and their share in percent; one pass for all patterns."""
    counted = docs.agg(F.count("*").alias("_all"), *[F.count_if(F.coalesce(F.col(column).rlike(p), F.lit(False))).alias(f"n{i}") for i, p in enumerate(patterns.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, name in enumerate(patterns)])
    flat = counted.select("_all", F.explode(rows).alias("r"))
    return flat.select("r.name", "r.n", F.when(F.col("_all") > 0, F.round(100 * F.col("r.n") / F.col("_all"), 2)).otherwise(0.0).alias("pct"))


def word_count_summary(frame: DataFrame, columns: list[str]) -> DataFrame:
    """For each text column: rows that aren't blank, mean, standard deviation, quartiles and extremes of their word counts."""
    long = frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(~blank(F.col(c)), word_count(F.col(c))).alias("words")) for c in columns])).alias("r")).select("r.*")
    # word counts are few different numbers: quantiles come from their table
    spread = long.where("words is not null").groupBy("column_name", "words").agg(F.count("*").alias("times"))
    words, times = F.col("words").cast("double"), F.col("times")
    n, mean = F.sum(times), F.sum(words * times) / F.sum(times)
    deviation = F.sqrt(F.greatest(F.sum(words * words * times) - n * mean * mean, F.lit(0.0)) / (n - 1))
    quartiles = [F.percentile("words", q, F.col("times")).alias(name) for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return spread.groupBy("column_name").agg(n.alias("n"), F.round(mean, 4).alias("mean"), F.round(F.when(n > 1, deviation), 4).alias("std"), F.min("words").alias("min"), *quartiles, F.max("words").alias("max"))


def rank_of(scored: DataFrame, wanted: DataFrame, query: str = "query_id", item: str = "job_id", score: str = "score") -> DataFrame:
    """The rank of each wanted (query, item): one more than the items of its query that score higher."""
    own = wanted.join(scored, [query, item]).select(query, item, F.col(score).alias("_own"))
    counts = scored.select(query, score).join(own, query).groupBy(query, item).agg((F.count_if(F.col(score) > F.col("_own")) + 1).alias("rank"))
    return counts


def extreme_pairs(pairs: DataFrame, by: str, ties: list[str], k: int = 3) -> DataFrame:
    """The k pairs of the largest value and the k of the least, as end "most" or "least"."""
    most = pairs.orderBy(F.col(by).desc(), *ties).limit(k).withColumn("end", F.lit("most"))
    return most.unionByName(pairs.orderBy(F.col(by), *ties).limit(k).withColumn("end", F.lit("least")))


def both_bounds(frame: DataFrame, low: str, high: str, name: str = "salary") -> DataFrame:
    """The values of both columns under each other; nulls are left out. One pass."""
    return frame.select(F.explode(F.array(low, high)).alias(name)).where(F.col(name).isNotNull())


def snapshot_date(jobs: DataFrame, deadline: str = "deadline", active: str = "is_active") -> DataFrame:
    """The day on which is_active was computed: that after the last deadline of inactive jobs, else the first deadline of active ones, else null."""
    day, is_active = F.try_to_date(F.col(deadline), "yyyy-MM-dd"), F.coalesce(F.col(active), F.lit(False))
    found = jobs.agg(F.max(F.when(~is_active, day)).alias("last"), F.min(F.when(is_active, day)).alias("first"))
    return found.select(F.coalesce(F.date_add("last", 1), F.col("first")).alias("snapshot"))


def checks(frame: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Each named aggregate condition and whether it holds; null does not."""
    one = frame.agg(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("passed")) for i, n in enumerate(conditions)])).alias("r")).select("r.*")


def infer_persona(skills: Column, text: Column, personas: dict[str, tuple[list[str], list[str]]], clue_weight: float = 1.5) -> Column:
    """The persona of the greatest skill overlap plus clue_weight times the clues found in the text; of equals the first.

    personas: name -> (skills, clues). Null without any overlap or clue.
    """
    own = F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.lower(s))
    low = F.lower(F.coalesce(text, F.lit("")))
    rows = []
    for i, (name, (wanted, clues)) in enumerate(personas.items()):
        overlap = F.size(F.array_intersect(own, F.array(*[F.lit(w.lower()) for w in wanted]).cast("array<string>")))
        hits = sum((F.contains(low, F.lit(c.lower())).cast("int") for c in clues), F.lit(0))
        rows.append(F.struct((overlap + clue_weight * hits).alias("points"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*rows))
    return F.when(best["points"] > 0, best["name"])
