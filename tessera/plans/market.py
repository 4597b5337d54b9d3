"""Queries of the market analyses, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categorize as cat, dom, text
from ..operators import gold, insights as ins, metrics, relational as rel, scoring
from .queries import _MATRIX, query

#: Titles and skill lists that stand for columns which the tables lack; a part has those of its key.
TITLES = (
    "Senior Backend Developer", "Lập trình viên Java", "Nhân viên kinh doanh", "E-learning content writer", "QA", "Machine operator", "Data Scientist", "Chuyên viên phần mềm", "Kế toán trưởng", "AI Researcher",
    "Nhân viên IT", "Maid", "DBA", "Chuyên viên", "Nhân viên thiết kế đồ họa", "low-code consultant", "ESG advisor", ".NET dev", "Trưởng phòng nhân sự", "Item manager",
)
SKILLS = ("Python, SQL", "Photoshop, Illustrator", "", "python,  Docker , Fintech", "Excel", "C++, c++", "Git, CI/CD, Excel")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _postings(t):
    own = t.table("part")

    def pick(values):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))

    return own.select(F.col("p_partkey").alias("job_id"), pick(TITLES).alias("title"), pick(SKILLS).alias("skills"))


_POSTINGS = f"""SELECT p_partkey AS job_id, {_sql_list(TITLES)}[p_partkey % {len(TITLES)} + 1] AS title, {_sql_list(SKILLS)}[p_partkey % {len(SKILLS)} + 1] AS skills FROM part"""


@query(f"""WITH p AS ({_POSTINGS}), l AS (SELECT *, list_distinct(list_transform(string_split(skills, ','), lambda s: lower(trim(s)))) AS own FROM p)
 SELECT job_id, regexp_matches(title, '(?i)(?:{cat.TRADE_TITLE})') OR len(list_intersect(own, {_sql_list(cat.CORE_SKILLS)})) >= 2 AS is_trade FROM l""")
def trade_filter(t):
    return _postings(t).select("job_id", cat.is_trade_job(F.col("title"), F.split("skills", ",")).alias("is_trade"))


@query(f"""WITH p AS ({_POSTINGS}), x AS (SELECT job_id, unnest(list_distinct(list_filter(list_transform(string_split(skills, ','), lambda s: trim(s)), lambda s: s <> ''))) AS skill FROM p)
 SELECT skill, count(*) AS n, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM p), 2) AS pct FROM x GROUP BY 1""")
def skill_frequency(t):
    return ins.skill_frequency(_postings(t), "skills")


@query("""WITH c AS (SELECT j.job_id, count(DISTINCT skill_id) AS n FROM jobs j LEFT JOIN job_skills s ON s.job_id = j.job_id GROUP BY 1)
 SELECT round(avg(n), 2) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS most, round(100 * count(*) FILTER (WHERE n > 0)::DOUBLE / count(*), 2) AS with_any_pct FROM c""")
def skill_density(t):
    return ins.skill_density(t.jobs, t.job_skills)


_EDGES, _LABELS = [0, 10, 25, 50], ["small", "middle", "large"]


@query("SELECT CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 25 THEN 'middle' ELSE 'large' END AS bin, count(*) AS n FROM part WHERE p_size > 0 AND p_size <= 50 GROUP BY 1")
def binned_sizes(t):
    return ins.bin_counts(t.table("part"), "p_size", _EDGES, _LABELS)


@query("SELECT o_orderdate::DATE AS day, count(o_totalprice) AS n, round(avg(o_totalprice), 0) AS average FROM orders GROUP BY 1")
def average_by_date(t):
    return ins.average_by_date(t.table("orders"), "o_orderdate", "o_totalprice")


@query("""SELECT o_orderpriority AS source, count(*) AS n, min(o_clerk_url) AS sample_url, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM orders), 2) AS pct
 FROM (SELECT o_orderpriority, 'https://example.com/' || o_orderkey AS o_clerk_url FROM orders) GROUP BY 1""")
def source_contribution(t):
    records = t.table("orders").select(F.col("o_orderpriority").alias("source"), F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string")).alias("url"))
    return ins.source_contribution(records, "source", "url")


_COVERAGE = {"idiot": r"\bidiot\b", "numbers": r"[0-9]{4,}", "address": r"[a-z0-9.]+@[a-z0-9]+", "none": r"\bqqzzqq\b", "words with the": r"(^|\s)the(\s|$)"}


@query("WITH " + ", ".join(f"c{i} AS (SELECT '{n}' AS name, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS n, count(*) AS every FROM documents)" for i, (n, p) in enumerate(_COVERAGE.items()))
       + " SELECT name, n, round(100 * n::DOUBLE / every, 2) AS pct FROM (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(_COVERAGE))) + ")")
def pattern_coverage(t):
    return ins.pattern_coverage(t.table("documents"), "text", _COVERAGE)


@query("""SELECT job_id, salary_min_vnd, salary_max_vnd FROM (SELECT job_id, salary_min_vnd * 200 AS salary_min_vnd, salary_max_vnd * 200 AS salary_max_vnd, experience_min FROM jobs)
 WHERE salary_max_vnd > 0 AND salary_max_vnd <= 80000000 AND salary_min_vnd / 1e6 BETWEEN 5 AND 150 AND salary_max_vnd / 1e6 BETWEEN 5 AND 200 AND experience_min <= 10""")
def plausible_salaries(t):
    jobs = t.jobs.select("job_id", (F.col("salary_min_vnd") * 200).alias("salary_min_vnd"), (F.col("salary_max_vnd") * 200).alias("salary_max_vnd"), "experience_min")
    low, high = F.col("salary_min_vnd"), F.col("salary_max_vnd")
    return ins.within_experience(jobs.where(ins.plausible_salary(low, high) & ins.plausible_salary(low, high, strict=True))).drop("experience_min")


@query("SELECT o_orderkey, o_comment FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority AS o_comment FROM orders) WHERE regexp_matches(o_comment, '^[0-9]+') AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")
def matching_rows(t):
    rows = t.table("orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("o_comment"))
    return ins.matching_rows(rows, "o_comment", "^[0-9]+", ["o_orderkey"], 50, o_orderstatus="F").drop("o_orderstatus")


@query("""SELECT job_id, published_at::DATE <= DATE '1996-07-01' AND DATE '1996-07-01' <= published_at::DATE + 45 AS alive FROM jobs
 WHERE published_at::DATE + 45 >= DATE '1996-01-01' AND published_at::DATE < DATE '1997-01-01'""")
def active_window(t):
    jobs = t.jobs.withColumn("opened", F.to_date("published_at")).withColumn("closed", F.date_add("opened", 45))
    day, opened, closed = F.lit("1996-07-01").cast("date"), F.col("opened"), F.col("closed")
    inside = ins.active_in(opened, closed, F.lit("1996-01-01").cast("date"), F.lit("1997-01-01").cast("date"))
    return jobs.where(inside).select("job_id", ins.alive_on(opened, closed, day).alias("alive"))


@query("SELECT j.job_id, skill_id, confidence FROM jobs j JOIN job_skills s USING (job_id) WHERE skill_type = 'preferred' AND confidence > 0.05")
def jobs_with_records(t):
    return ins.with_records(t.jobs, t.job_skills, "job_id", F.expr("skill_type = 'preferred' and confidence > 0.05")).select("job_id", "skill_id", "confidence")


@query("""SELECT 'found' AS part, count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem) l JOIN part ON p_partkey = l_partkey
 UNION ALL SELECT 'missing', count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem) l WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def reindexed_parts(t):
    ids = t.table("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    found, missing = ins.reindexed(t.table("part"), ids, "p_partkey")
    return found.agg(F.count("*").alias("n")).select(F.lit("found").alias("part"), "n").unionByName(missing.agg(F.count("*").alias("n")).select(F.lit("missing").alias("part"), "n"))


@query("""SELECT j.job_id, array_to_string(coalesce(list_sort(list_distinct(list(skill_name) FILTER (WHERE skill_name IS NOT NULL))), []), '|') AS skills
 FROM jobs j LEFT JOIN job_skills s ON s.job_id = j.job_id LEFT JOIN skills k ON k.skill_id = s.skill_id GROUP BY 1""")
def skill_lists(t):
    return ins.skill_lists(t.jobs, t.job_skills, t.skills).select("job_id", F.array_join("skills", "|").alias("skills"))


@query("SELECT round(quantile_cont(salary_max_vnd, 0.5) / 1e6::DOUBLE, 1) AS median_m FROM jobs")
def median_salary(t):
    return ins.median_in_millions(t.jobs, "salary_max_vnd")


@query("""SELECT CASE WHEN experience_min = 0 AND (experience_max IS NULL OR experience_max <= 1) THEN '0 năm (Fresher/Intern)' WHEN experience_min = 1 OR experience_max = 1 THEN '1 năm' WHEN experience_min BETWEEN 2 AND 3 THEN '2 - 3 năm'
  WHEN experience_min > 3 AND experience_min <= 5 THEN '3 - 5 năm' WHEN experience_min > 5 THEN 'Trên 5 năm' ELSE 'Không yêu cầu / Chưa rõ' END AS experience_bucket, count(*) AS jobs FROM jobs GROUP BY 1""")
def experience_rollup(t):
    rolled = gold.rollup_average(gold.salary_experience_matrix(t.jobs), "experience_bucket")
    return rolled.select("experience_bucket", F.col("job_count").alias("jobs"))


@query("""SELECT source, column_name, count(words) AS n, round(avg(words), 4) AS mean, round(stddev_samp(words), 4) AS std, min(words) AS min, quantile_cont(words, 0.25)::DOUBLE AS p25, quantile_cont(words, 0.5)::DOUBLE AS p50, quantile_cont(words, 0.75)::DOUBLE AS p75, max(words) AS max
 FROM (SELECT 'all' AS source, 'text' AS column_name, len(regexp_extract_all(text, '[^\\s]+'))::INTEGER AS words FROM benchmark UNION ALL SELECT 'all', 'item', 1 FROM benchmark) GROUP BY 1, 2""")
def word_count_summary(t):
    frame = t.table("benchmark").select("text", F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("item"))
    return ins.word_count_summary(frame, ["text", "item"]).withColumn("source", F.lit("all"))


@query("""WITH s AS (SELECT o_custkey AS query_id, o_orderkey AS job_id, o_totalprice AS score FROM orders), w AS (SELECT query_id, min(job_id) AS job_id FROM s GROUP BY 1)
 SELECT w.query_id, w.job_id, count(*) FILTER (WHERE s.score > o.score) + 1 AS rank FROM w JOIN s o USING (query_id, job_id) JOIN s ON s.query_id = w.query_id GROUP BY 1, 2""")
def rank_of_item(t):
    scored = t.table("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").alias("score"))
    return ins.rank_of(scored, scored.groupBy("query_id").agg(F.min("job_id").alias("job_id")))


@query("""WITH p AS (SELECT o_orderkey AS a, o_custkey AS b, o_totalprice AS similarity FROM orders)
 SELECT * FROM (SELECT *, 'most' AS "end" FROM p ORDER BY similarity DESC, a LIMIT 3) UNION ALL SELECT * FROM (SELECT *, 'least' FROM p ORDER BY similarity, a LIMIT 3)""")
def extreme_pairs(t):
    pairs = t.table("orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), F.col("o_totalprice").alias("similarity"))
    return ins.extreme_pairs(pairs, "similarity", ["a"])


@query("SELECT count(*) AS n, round(sum(salary), 2) AS total FROM (SELECT salary_min_vnd AS salary FROM jobs UNION ALL SELECT salary_max_vnd FROM jobs) WHERE salary IS NOT NULL")
def both_bounds(t):
    return ins.both_bounds(t.jobs, "salary_min_vnd", "salary_max_vnd").agg(F.count("*").alias("n"), F.round(F.sum("salary"), 2).alias("total"))


@query("SELECT max(published_at::DATE) FILTER (WHERE NOT is_active) + 1 AS snapshot FROM jobs")
def snapshot_date(t):
    return ins.snapshot_date(t.jobs.withColumn("deadline", F.date_format("published_at", "yyyy-MM-dd")))


@query("""SELECT 'more jobs than companies' AS name, (SELECT count(*) FROM jobs) > 10 AS passed UNION ALL SELECT 'no negative salary', (SELECT min(salary_min_vnd) FROM jobs) >= 0
 UNION ALL SELECT 'all active', (SELECT bool_and(is_active) FROM jobs) UNION ALL SELECT 'nothing known', false""")
def named_checks(t):
    return ins.checks(t.jobs, {"more jobs than companies": F.count("*") > 10, "no negative salary": F.min("salary_min_vnd") >= 0, "all active": F.min("is_active"), "nothing known": F.max(F.lit(None).cast("int")) > 0})


@query("SELECT round(avg(a), 4) AS a, round(avg(b), 4) AS b FROM (SELECT o_totalprice / 1000 AS a, o_custkey / 10.0::DOUBLE AS b FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
def top_components(t):
    scored = t.table("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").alias("score"), (F.col("o_totalprice") / 1000).alias("a"), (F.col("o_custkey") / 10.0).alias("b"))
    return ins.top_components(scored, ["a", "b"])


_RANKED = """r AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS oracle_rank FROM orders)"""


def _orders(t):
    o = t.table("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), "o_totalprice")
    ranked = rel.top_k(o, 5, "o_totalprice", ["item_id"], ["query_id"]).select("query_id", "item_id", "rank")
    oracle = rel.top_k(o.withColumn("minus", -F.col("item_id")), 5, "minus", ["item_id"], ["query_id"]).select("query_id", "item_id", "rank")
    return o, ranked, oracle


@query(f"WITH {_RANKED} SELECT query_id, count(*) FILTER (WHERE oracle_rank <= 5) / 5.0::DOUBLE AS oracle_precision FROM r WHERE rank <= 5 GROUP BY 1")
def oracle_precision(t):
    _, ranked, oracle = _orders(t)
    return metrics.oracle_precision_at(ranked, oracle, 5)


@query(f"""WITH {_RANKED} SELECT round(count(*) FILTER (WHERE rank <= 5)::DOUBLE / count(*), 6) AS cold_recall FROM r WHERE item_id NOT IN (SELECT job_id FROM ev WHERE job_id IS NOT NULL)""")
def cold_start_recall(t):
    o, ranked, _ = _orders(t)
    warm = t.events.where("job_id is not null").select(F.col("job_id").alias("item_id"))
    return metrics.cold_start_recall(ranked, o, warm, 5).select(F.round("cold_recall", 6).alias("cold_recall"))


@query(f"""WITH {_RANKED}, w AS (SELECT job_id AS item_id, list_distinct(list(lower(skill_category))) AS wanted FROM job_skills JOIN skills USING (skill_id) GROUP BY 1), u AS (SELECT o_custkey AS query_id, list_distinct(list(lower(p_type))) AS own FROM orders JOIN part ON p_partkey = o_custkey GROUP BY 1)
 SELECT query_id, round(avg(coalesce(len(list_intersect(own, wanted)), 0)::DOUBLE / greatest(coalesce(len(wanted), 0), 1)), 6) AS skill_coverage FROM r LEFT JOIN w USING (item_id) LEFT JOIN u USING (query_id) WHERE rank <= 5 GROUP BY 1""")
def skill_coverage(t):
    o, ranked, _ = _orders(t)
    wanted = t.job_skills.join(t.skills, "skill_id").groupBy(F.col("job_id").alias("item_id")).agg(F.collect_set("skill_category").alias("skills"))
    own = o.select("query_id").distinct().join(t.table("part"), F.col("query_id") == F.col("p_partkey")).select("query_id", F.array("p_type").alias("skills"))
    return metrics.skill_coverage_at(ranked, own, wanted, 5).select("query_id", F.round("skill_coverage", 6).alias("skill_coverage"))


@query("SELECT count(*) AS rows, true AS disjoint, true AS near_share FROM orders")
def random_split(t):
    """Both parts hold every row once, about four fifths of them in the first."""
    one, two = metrics.random_split(t.table("orders"), "o_orderkey")
    both = one.agg(F.count("*").alias("a")).crossJoin(two.agg(F.count("*").alias("b"))).crossJoin(one.join(two, "o_orderkey").agg(F.count("*").alias("shared")))  # a row each
    return both.select((F.col("a") + F.col("b")).alias("rows"), (F.col("shared") == 0).alias("disjoint"), (F.abs(F.col("a") / (F.col("a") + F.col("b")) - 0.8) < 0.1).alias("near_share"))


@query(f"""WITH p AS ({_POSTINGS}), l AS (SELECT job_id, lower(title) AS t, list_distinct(list_transform(string_split(skills, ','), lambda s: lower(trim(s)))) AS own FROM p),
 s AS (SELECT job_id, len(list_intersect(own, ['python', 'sql'])) + 1.5 * contains(t, 'data')::INT AS a, len(list_intersect(own, ['photoshop', 'illustrator'])) + 1.5 * contains(t, 'thiết kế')::INT + 1.5 * contains(t, 'writer')::INT AS b FROM l)
 SELECT job_id, CASE WHEN a > 0 AND a >= b THEN 'Data' WHEN b > 0 THEN 'Design' END AS persona FROM s""")
def personas(t):
    table = {"Data": (["Python", "SQL"], ["data"]), "Design": (["Photoshop", "Illustrator"], ["thiết kế", "writer"])}
    skills = F.transform(F.split("skills", ","), lambda s: F.trim(s))
    return _postings(t).select("job_id", ins.infer_persona(skills, F.col("title"), table).alias("persona"))


@query("""SELECT doc_id, 'Dev Dev Dev ' || lang || ' ' || lang || ' ' || lang || ' ' || lang || ' ' || source AS soup FROM (SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)""")
def profile_soups(t):
    docs = t.table("documents").where("lang is not null and source is not null")
    return docs.select("doc_id", text.profile_soup(F.lit("Dev"), F.array("lang"), F.col("source")).alias("soup"))


@query()
def page_lines(t):
    """The pages' text by elements; tests compare it with a parser's."""
    return t.table("pages").select("page_id", dom.clean_html_dom(F.col("html")).alias("lines"))


@query("""WITH b AS (SELECT o_orderkey AS job_id, (o_orderkey % 7)::DOUBLE AS e, o_totalprice * 100 AS hi FROM orders WHERE o_orderkey % 5 <> 3), k AS (SELECT job_id, round(CASE WHEN e = 0 THEN 1.0 WHEN 2 - e >= 0 AND 2 > e + 5 THEN 0.85 WHEN 2 - e >= 0 THEN 1.0 WHEN 2 - e >= -1 THEN 0.7 WHEN 2 - e >= -2 THEN 0.4 ELSE 0.1 END::DOUBLE, 3) AS s_exp,
  CASE WHEN hi >= 15000000 THEN 1.0 ELSE round(hi / 15000000::DOUBLE, 3) END::DOUBLE AS s_sal FROM b), c AS (SELECT *, round((0.4 * 0 + 0.1 * s_exp + 0.1 * 1.0 + 0.1 * s_sal)::DOUBLE / 0.7, 4) AS score FROM k)
 SELECT w.job_id, w.score, (SELECT count(*) FROM c o WHERE o.score > w.score) + 1 AS rank, (SELECT count(*) FROM c) AS active_jobs FROM c w WHERE w.job_id % 1000 = 0""")
def fit_report(t):
    """Postings without skills or text for one profile; the reported ones are those whose number is divisible by 1000."""
    spark = t.spark
    jobs = t.table("orders").where("o_orderkey % 5 <> 3").select(
        F.col("o_orderkey").alias("job_id"), F.array().cast("array<string>").alias("required_skills"), (F.col("o_orderkey") % 7).cast("double").alias("experience_min"), (F.col("o_orderkey") % 7 + 2).cast("double").alias("experience_max"),
        F.lit("Hà Nội").alias("city"), F.lit("Onsite").alias("work_mode"), F.lit(None).cast("double").alias("salary_min"), (F.col("o_totalprice") * 100).alias("salary_max"), F.lit(True).alias("is_active"),
    )
    profiles = spark.createDataFrame([(1, ["python"], 2.0, "", [], 15_000_000.0)], "profile_id int, skills array<string>, years double, city string, modes array<string>, min_salary double")
    similarity = spark.createDataFrame([], "profile_id int, job_id long, similarity double")
    wanted = jobs.where("job_id % 1000 = 0").select(F.lit(1).alias("profile_id"), "job_id")
    return scoring.fit_report(profiles, jobs, similarity, wanted).select("job_id", "score", "rank", "active_jobs")
