"""Queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import categorize as cat, parse, skills as sk, text
from ..operators import cf, dedup, dq, gold, graph, hybrid, metrics, quality, relational as rel, retrieval as ret, scoring, simulate, upsert
from ..sources import pages as src
from ..streaming import events as stream
from .roles import ROLES, WEIGHTS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name; SQL may use the roles' names."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, base: f(Tables(spark, base))
        if sql:
            ORACLES[f.__name__] = f"WITH {ROLES}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {ROLES} {sql}"
        return f

    return register


_DEMAND = """
SELECT s.skill_id, skill_name, skill_category, count(*) AS demand, count(*) FILTER (WHERE skill_type = 'required') AS required_count,
       count(*) FILTER (WHERE skill_type = 'preferred') AS preferred_count, round(avg(salary_max_vnd), 0) AS avg_salary_max,
       round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM jobs), 2) AS penetration_pct
FROM job_skills js JOIN jobs j USING (job_id) JOIN skills s ON js.skill_id = s.skill_id GROUP BY 1, 2, 3"""


@query(_DEMAND)
def skill_demand(t):
    return gold.skill_demand(t.jobs, t.job_skills, t.skills)


@query("""SELECT j.*, c.*, s.* FROM
 (SELECT count(*) AS total_jobs, count(*) FILTER (WHERE is_active) AS active_jobs, round(avg(salary_min_vnd), 0) AS avg_salary_min, round(avg(salary_max_vnd), 0) AS avg_salary_max,
   round(count(*) FILTER (WHERE work_mode = 'Remote') * 100.0::DOUBLE / count(*), 2) AS remote_pct, round(count(*) FILTER (WHERE work_mode = 'Hybrid') * 100.0::DOUBLE / count(*), 2) AS hybrid_pct,
   round(count(*) FILTER (WHERE work_mode = 'Onsite') * 100.0::DOUBLE / count(*), 2) AS onsite_pct FROM jobs) j,
 (SELECT count(*) AS total_companies FROM companies) c, (SELECT count(DISTINCT skill_id) AS distinct_skills FROM job_skills) s""")
def market_kpis(t):
    return gold.market_kpis(t.jobs, t.companies, t.job_skills)


_MATRIX = "SELECT title, seniority, city, work_mode, employment_type, count(*) AS job_count, round(avg(salary_min_vnd), 0) AS avg_salary_min, round(avg(salary_max_vnd), 0) AS avg_salary_max FROM jobs GROUP BY 1, 2, 3, 4, 5"


@query(_MATRIX)
def role_geo_matrix(t):
    return gold.role_geo_matrix(t.jobs)


@query("""SELECT j.company_id, c.company_name, coalesce(industry, 'Chưa rõ') AS industry, count(*) AS total_jobs, count(*) FILTER (WHERE is_active) AS active_jobs, round(avg(salary_max_vnd), 0) AS avg_salary_max
 FROM jobs j JOIN companies c ON j.company_id = c.company_id GROUP BY 1, 2, 3""")
def company_rankings(t):
    return gold.company_rankings(t.jobs.drop("company_name"), t.companies)


@query("""WITH p AS (SELECT a.skill_id AS skill_a, b.skill_id AS skill_b, count(*) AS pair_count FROM job_skills a JOIN job_skills b ON a.job_id = b.job_id AND a.skill_id < b.skill_id GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT p.*, x.skill_name AS name_a, x.skill_category AS category_a, y.skill_name AS name_b, y.skill_category AS category_b FROM p JOIN skills x ON x.skill_id = skill_a JOIN skills y ON y.skill_id = skill_b""")
def skill_cooccurrence(t):
    return gold.skill_cooccurrence(t.job_skills, t.skills, 2)


@query("""SELECT seniority, CASE WHEN experience_min = 0 AND (experience_max IS NULL OR experience_max <= 1) THEN '0 năm (Fresher/Intern)' WHEN experience_min = 1 OR experience_max = 1 THEN '1 năm' WHEN experience_min BETWEEN 2 AND 3 THEN '2 - 3 năm'
  WHEN experience_min > 3 AND experience_min <= 5 THEN '3 - 5 năm' WHEN experience_min > 5 THEN 'Trên 5 năm' ELSE 'Không yêu cầu / Chưa rõ' END AS experience_bucket,
 city, salary_type, count(*) AS job_count, round(avg(salary_min_vnd), 0) AS avg_salary_min, round(avg(salary_max_vnd), 0) AS avg_salary_max, round(quantile_cont(salary_min_vnd, 0.5), 0) AS median_salary_min, round(quantile_cont(salary_max_vnd, 0.5), 0) AS median_salary_max FROM jobs GROUP BY ALL""")
def salary_experience_matrix(t):
    return gold.salary_experience_matrix(t.jobs)


@query(f"WITH m AS ({_MATRIX}) SELECT seniority, sum(job_count)::BIGINT AS job_count, round(avg(avg_salary_min) / 1e6::DOUBLE, 1) AS avg_min_m, round(avg(avg_salary_max) / 1e6::DOUBLE, 1) AS avg_max_m FROM m GROUP BY 1")
def seniority_rollup(t):
    return gold.rollup_average(gold.role_geo_matrix(t.jobs), "seniority")


@query(f"WITH m AS ({_MATRIX}) SELECT city, sum(job_count)::BIGINT AS job_count FROM m GROUP BY 1")
def geo_distribution(t):
    return gold.role_geo_matrix(t.jobs).groupBy("city").agg(F.sum("job_count").alias("job_count"))


@query("""SELECT skill_category, count(DISTINCT j.job_id) AS job_count, round(avg(salary_max_vnd), 0) AS avg_salary_max, array_to_string(list_sort(array_agg(DISTINCT skill_name))[1:5], ', ') AS top_skills
 FROM job_skills js JOIN jobs j USING (job_id) JOIN skills s ON js.skill_id = s.skill_id GROUP BY 1 HAVING count(DISTINCT j.job_id) >= 10""")
def tech_stack(t):
    return gold.tech_stack(t.jobs, t.job_skills, t.skills)


@query(f"WITH d AS ({_DEMAND}) SELECT * FROM d WHERE demand >= 8 AND avg_salary_max > 0 ORDER BY avg_salary_max DESC, skill_id LIMIT 15")
def highest_paying(t):
    return gold.highest_paying(skill_demand(t))


@query("""SELECT j.job_id, coalesce(string_agg(DISTINCT skill_name, ', ' ORDER BY skill_name), '') AS skills FROM jobs j LEFT JOIN job_skills js ON j.job_id = js.job_id LEFT JOIN skills s ON js.skill_id = s.skill_id GROUP BY 1""")
def skills_per_job(t):
    return gold.skills_per_job(t.jobs, t.job_skills, t.skills)


@query("""SELECT s.skill_id, skill_name, skill_category, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM jobs WHERE is_active), 2) AS pct
 FROM job_skills js JOIN jobs j USING (job_id) JOIN skills s ON js.skill_id = s.skill_id WHERE is_active GROUP BY 1, 2, 3 ORDER BY n DESC, s.skill_id LIMIT 15""")
def skill_share_of_active(t):
    return gold.skill_share_of_active(t.jobs, t.job_skills, t.skills)


@query("SELECT seniority, count(*) AS n, round(avg(salary_min_vnd) / 1e6::DOUBLE, 1) AS avg_min_m, round(avg(salary_max_vnd) / 1e6::DOUBLE, 1) AS avg_max_m FROM jobs WHERE is_active AND salary_min_vnd IS NOT NULL AND salary_max_vnd IS NOT NULL GROUP BY 1")
def salary_by_seniority(t):
    return gold.salary_by_seniority(t.jobs)


@query("SELECT user_id, count(*) AS observations, round((epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::DOUBLE / 86400, 1) AS days FROM events GROUP BY 1 HAVING count(*) > 1")
def time_to_close(t):
    return gold.time_to_close(t.table("events"), "user_id", "ts").select("user_id", "observations", "days")


@query("""SELECT option, CASE WHEN option = 'CHINA' THEN 2 ELSE 1 END AS position FROM (SELECT DISTINCT city AS option FROM jobs WHERE is_active) UNION ALL SELECT 'Tất cả', 0""")
def filter_options(t):
    return gold.filter_options(t.jobs, "city", last="CHINA")


@query("SELECT job_id, title, company_name, city FROM jobs WHERE is_active AND work_mode = 'Onsite' AND (contains(lower(title), 'auto') OR contains(lower(company_name), 'auto') OR contains(lower(city), 'auto')) ORDER BY job_id LIMIT 20 OFFSET 20")
def search_page(t):
    found = gold.search(t.jobs, "AUTO", work_mode="Onsite").select("job_id", "title", "company_name", "city")
    return rel.page(found, 2, 20, [F.col("job_id")])


@query("SELECT count(DISTINCT job_id) AS n FROM jobs WHERE is_active AND (contains(lower(title), 'auto') OR contains(lower(company_name), 'auto') OR contains(lower(city), 'auto'))")
def search_count(t):
    return gold.search(t.jobs, "auto").agg(F.count_distinct("job_id").alias("n"))


@query("SELECT job_id, seniority, title FROM jobs WHERE seniority IN ('5-LOW') OR experience_min = 0 OR title ILIKE '%household%'")
def entry_level(t):
    return gold.entry_level(t.jobs, ("5-LOW",), ("household",)).select("job_id", "seniority", "title")


@query("""SELECT min(o_orderkey) AS o_orderkey, 'c' || o_custkey AS listing FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY o_custkey""")
def crawl_frontier(t):
    """Customers as listings, their orders as attempts; customers with an urgent order count as crawled."""
    o = t.table("orders")
    listings = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("listing"), "o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("detail_status"))
    crawled = o.where("o_orderpriority like '1%'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("listing")).distinct()
    return rel.frontier(listings, crawled, "listing", "o_orderkey").select("o_orderkey", "listing")


@query("SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL")
def anti_join_frontier(t):
    return rel.orphans(t.table("orders"), t.table("lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("SELECT count(*) AS n FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_partkey IS NULL")
def fk_violations(t):
    return rel.orphans(t.table("lineitem"), t.table("part"), "l_partkey", "p_partkey").agg(F.count("*").alias("n"))


@query("""SELECT c.c_custkey, c.c_name, coalesce(n.n_name, '') AS nation, coalesce(r.r_name, '') AS region FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def star_lookup(t):
    c, n, r = t.table("customer"), t.table("nation"), t.table("region")
    joined = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return joined.select("c_custkey", "c_name", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"))


@query("""WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE experience_min IS NULL) AS a, count(*) FILTER (WHERE salary_max_vnd IS NULL) AS b FROM jobs)
 SELECT 'experience_min' AS column_name, a AS nulls, 0::BIGINT AS blanks, round(100.0::DOUBLE * a / total, 2) AS missing_pct FROM c UNION ALL SELECT 'salary_max_vnd', b, 0::BIGINT, round(100.0::DOUBLE * b / total, 2) FROM c""")
def null_report(t):
    return rel.null_report(t.jobs.select("experience_min", "salary_max_vnd"))


@query("""SELECT 'order_part' AS key_name, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS duplicates FROM lineitem UNION ALL SELECT 'supplier', count(*) - count(DISTINCT l_suppkey) FROM lineitem""")
def duplicate_report(t):
    return rel.duplicate_report(t.table("lineitem"), {"order_part": ["l_orderkey", "l_partkey"], "supplier": ["l_suppkey"]})


@query("""SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS max FROM lineitem GROUP BY 1""")
def describe(t):
    return rel.describe(t.table("lineitem"), "l_quantity", ["l_returnflag"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT city, round(quantile_cont(salary_max_vnd, 0.25), 4) AS p25, round(quantile_cont(salary_max_vnd, 0.5), 4) AS p50, round(quantile_cont(salary_max_vnd, 0.75), 4) AS p75 FROM jobs GROUP BY 1")
def boxplot(t):
    return rel.describe(t.jobs, "salary_max_vnd", ["city"]).select("city", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")])


@query("SELECT least(floor((l_quantity) / 5)::INTEGER + 1, 10) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def histogram(t):
    return rel.histogram(t.table("lineitem"), "l_quantity", 0, 50, 10)


@query("""SELECT work_mode, is_active, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM jobs), 2) AS share FROM jobs GROUP BY 1, 2""")
def value_counts(t):
    return rel.value_counts(t.jobs, "work_mode", "is_active")


@query("""WITH m AS (SELECT company_name, city, count(*) AS c FROM jobs GROUP BY 1, 2), b AS (SELECT company_name, city, row_number() OVER (PARTITION BY company_name ORDER BY c DESC, city) AS r FROM m)
 SELECT j.company_name, count(*) AS total, sum(is_active::INT)::BIGINT AS active, any_value(b.city) AS city FROM jobs j JOIN b ON b.company_name = j.company_name AND b.r = 1 GROUP BY 1 ORDER BY total DESC, j.company_name LIMIT 15""")
def top_companies_mode(t):
    grouped = t.jobs.groupBy("company_name").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.mode("city", True).alias("city"))
    return rel.top_k(grouped, 15, "total", ["company_name"])


@query("""WITH f AS (SELECT company_id, title, min(job_id) AS first FROM jobs GROUP BY 1, 2) SELECT job_id, CASE WHEN job_id <> first THEN first END AS canonical_job_id FROM jobs JOIN f USING (company_id, title)""")
def canonical_job(t):
    from ..operators.silver import canonical_ids

    return canonical_ids(t.jobs).select("job_id", "canonical_job_id")


@query("""SELECT o_custkey, min_by(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS first_priority, min_by(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS first_price FROM orders GROUP BY 1""")
def golden_record(t):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return t.table("orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.when(status == "F", key)).alias("first_priority"), F.min_by("o_totalprice", F.when(status != "P", key)).alias("first_price"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(t):
    return upsert.latest(t.table("events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("""WITH inc AS (SELECT * FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM inc) THEN 'updated' ELSE o_orderstatus END AS state FROM orders""")
def master_upsert(t):
    orders = t.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    incoming = orders.where("state = 'O'").withColumn("state", F.lit("updated"))
    return upsert.upsert(orders, incoming, ["o_orderkey"])


def _raw_records(t):
    """documents as raw records, some of them broken."""
    d = t.table("documents")
    k = F.col("doc_id") % 7
    return d.select(
        F.col("doc_id").cast("string").alias("detail_id"), F.when(k == 1, "elsewhere").otherwise("topcv").alias("source"), F.lit("").alias("source_job_id"), F.when(k == 2, "ftp://x").otherwise("https://e.com/j").alias("job_url"),
        F.substring("text", 1, 40).alias("title_raw"), F.lit("").alias("overview_raw"), F.col("text").alias("responsibilities_raw"), F.lit("").alias("requirements_raw"), F.lit("").alias("benefits_raw"),
        F.when(k == 3, "40 - 20 triệu").when(k == 4, "1,000 - 80,000 USD").otherwise("15 - 20 triệu").alias("salary_raw"), F.lit("2026-09-01").alias("published_at_raw"),
        F.when(k == 5, "2026-08-01").when(k == 6, "soon").otherwise("2026-10-01").alias("deadline_raw"),
    )


_ROUTED = r"""r AS (SELECT doc_id, doc_id % 7 AS k, length(trim(text, E' \t\n\r\x0b\x0c')) AS n, length(trim(substr(text, 1, 40), E' \t\n\r\x0b\x0c')) AS tn FROM documents),
 c AS (SELECT *, k = 1 OR k = 2 OR n < 100 OR tn < 2 AS bad FROM r)
,
 rt AS (SELECT CAST(doc_id AS VARCHAR) AS detail_id, CASE WHEN bad THEN 'invalid' WHEN k IN (3, 4, 5, 6) THEN 'quarantine' ELSE 'valid' END AS dq_status,
  CASE WHEN bad THEN concat_ws(',', CASE WHEN k = 2 THEN 'ERR_MISSING_JOB_URL' END, CASE WHEN tn < 2 THEN 'ERR_MISSING_TITLE' END, CASE WHEN k = 1 THEN 'ERR_MISSING_SOURCE' END, CASE WHEN n < 100 THEN 'ERR_CONTENT_TOO_SHORT' END)
       ELSE CASE k WHEN 3 THEN 'ERR_SALARY_INVERTED' WHEN 4 THEN 'ERR_SALARY_OUTLIER' WHEN 5 THEN 'ERR_DATE_DEADLINE_BEFORE_PUBLISHED' WHEN 6 THEN 'ERR_DATE_MALFORMED' ELSE '' END END AS errors FROM c)"""


@query(f"WITH {_ROUTED} SELECT * FROM rt")
def quality_route(t):
    return quality.route(_raw_records(t)).select("detail_id", "dq_status", F.array_join("dq_errors", ",").alias("errors"))


@query(f"""WITH {_ROUTED}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE dq_status = 'valid') AS valid, count(*) FILTER (WHERE dq_status = 'quarantine') AS quarantine, count(*) FILTER (WHERE dq_status = 'invalid') AS invalid FROM rt)
 SELECT *, round(100.0::DOUBLE * valid / total, 2) AS valid_rate, round(100.0::DOUBLE * quarantine / total, 2) AS quarantine_rate, round(100.0::DOUBLE * invalid / total, 2) AS invalid_rate FROM n""")
def quality_summary(t):
    return quality.summary(quality.route(_raw_records(t)))


@query("""SELECT 'sim_' || CAST(user_id AS VARCHAR) AS user_id, job_id, event FROM ev WHERE event = 'view' UNION ALL SELECT CAST(user_id AS VARCHAR), job_id, event FROM ev WHERE event <> 'view'""")
def union_events(t):
    e = t.events.select(F.col("user_id").cast("string").alias("user_id"), "job_id", "event")
    return rel.weighted_union(e.where("event <> 'view'"), e.where("event = 'view'"))


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')
 UNION ALL SELECT 'only_orders', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def set_ops(t):
    line, o = t.table("lineitem"), t.table("orders")
    both = line.where("l_returnflag = 'R'").select("l_suppkey").intersect(line.where("l_returnflag = 'A'").select("l_suppkey"))
    only = o.where("o_orderstatus = 'O'").select("o_custkey").exceptAll(o.where("o_orderstatus = 'O'").select("o_custkey").intersectAll(o.where("o_orderstatus = 'F'").select("o_custkey"))).select("o_custkey").subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))
    return both.agg(F.count("*").alias("n")).select(F.lit("both").alias("part"), "n").unionByName(only.agg(F.count("*").alias("n")).select(F.lit("only_orders").alias("part"), "n"))


@query(r"SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9+#.]+'), ' ') AS key FROM part")
def title_keys(t):
    return t.table("part").select("p_partkey", text.title_key(F.col("p_name")).alias("key"))


@query(r"SELECT c_custkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(c_name), '[a-z0-9]+'))), ' ') AS key FROM customer")
def company_keys(t):
    return t.table("customer").select("c_custkey", text.company_key(F.col("c_name")).alias("key"))


@query("""WITH s AS (SELECT o_custkey, list_distinct(array_agg(o_orderpriority)) AS p FROM orders GROUP BY 1), k AS (SELECT * FROM s WHERE o_custkey % 20 = 0)
 SELECT a.o_custkey AS a, b.o_custkey AS b, round(len(list_intersect(a.p, b.p))::DOUBLE / len(list_distinct(list_concat(a.p, b.p))), 6) AS jaccard FROM k a JOIN s b ON a.o_custkey <> b.o_custkey""")
def jaccard_pairs(t):
    """The customers whose number is divisible by 20 are the stated queries, against all customers.

    Priorities are five, so there are at most 31 different sets; only those are compared with each other. Customers of
    one set are cut in blocks that are dealt out, so no set is one task's; each meets all blocks of queries, which are
    broadcast, and pairs of blocks become rows at the very end. 504 values are one bit-packed run of parquet, so a
    repeated block repeats its bytes; likeness, never null, is declared so, which spares parquet the levels of nulls.
    """
    sets = t.table("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    kinds = sets.select("p").distinct()
    likeness = kinds.toDF("pa").crossJoin(F.broadcast(kinds.toDF("pb"))).select("pa", "pb", F.coalesce(F.round(text.jaccard(F.col("pa"), F.col("pb")), 6), F.lit(0.0)).alias("jaccard"))  # at most 31 by 31
    queries = rel.blocks(sets.where("o_custkey % 20 = 0"), "o_custkey", "p", 504).toDF("pa", "a")
    others = rel.blocks(sets, "o_custkey", "p", 504).toDF("pb", "b").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))  # by number, since AQE merges small partitions
    pairs = others.join(F.broadcast(likeness), "pb").join(F.broadcast(queries), "pa").select("a", "b", "jaccard")
    return rel.spread_pairs(pairs, "a", "b").where("a <> b").select("a", "b", "jaccard")


@query(r"""SELECT page_id, CASE WHEN contains(h, '.') AND h NOT IN ('topcv.vn','vietnamworks.com','topdev.vn','saramin.vn','itviec.com') THEN h END AS domain FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS h FROM pages)""")
def url_domain(t):
    return t.table("pages").select("page_id", parse.website_domain(F.col("url")).alias("domain"))


@query(r"""WITH a AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS h FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)<(?:br|/p|/li|/div|/h[0-9])[^>]*>', E'\n', 'g'), '<[^>]+>', ' ', 'g'), '(?m)^[ \t]*[-*+–•][ \t]*', '- ', 'g') AS h FROM a),
 c AS (SELECT page_id, list_filter(list_transform(string_split(h, E'\n'), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'), E' \t\r\x0b\x0c')), lambda l: l <> '') AS ls FROM b)
 SELECT page_id, md5(array_to_string(ls, E'\n')) AS digest, len(ls)::BIGINT AS lines FROM c""")
def html_strip(t):
    cleaned = t.table("pages").select("page_id", text.clean_html(F.col("html")).alias("c"))
    return cleaned.select("page_id", F.md5("c").alias("digest"), F.size(F.split("c", "\n")).cast("long").alias("lines"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(t):
    return t.table("pages").select("page_id", src.html_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title_raw, NULL::VARCHAR AS company_name_raw, NULL::VARCHAR AS salary_raw FROM pages")
def page_postings(t):
    return src.posting_details(t.table("pages")).select("page_id", "title_raw", "company_name_raw", "salary_raw")


@query()
def language_detect(t):
    return t.table("documents").select("doc_id", cat.language_profile(F.col("text")).alias("profile"), cat.language_star(F.col("text")).alias("star"))


@query("SELECT count(*) AS total, count(*) - count(DISTINCT sha256(trim(text, E' \t\n\r\x0b\x0c'))) AS duplicates FROM documents")
def content_hash_duplicates(t):
    hashed = t.table("documents").select(text.content_hash(F.col("text")).alias("h"))
    return hashed.agg(F.count("*").alias("total"), (F.count("*") - F.count_distinct("h")).alias("duplicates"))


_TF = r"""bench AS (SELECT item_id, text FROM benchmark),
 tok AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]{2,}')) AS term FROM bench),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM bench),
 raw AS (SELECT doc_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term), n), nrm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1),
 w AS (SELECT doc_id, term, raw / norm AS weight FROM raw JOIN nrm USING (doc_id))"""


def _bench_weights(t):
    return ret.tfidf(t.table("benchmark"), "item_id", "text", bigrams=False)


@query(f"WITH {_TF} SELECT doc_id, term, round(weight, 6) AS weight FROM w")
def tfidf_weights(t):
    return _bench_weights(t).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_TF}, s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.weight * d.weight), 6) AS similarity FROM w q JOIN w d ON q.term = d.term AND q.doc_id <> d.doc_id AND q.doc_id % 20 = 0 GROUP BY 1, 2) SELECT query_id, doc_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 5")
def text_query_topk(t):
    w = _bench_weights(t)
    # the items whose number is divisible by 20 are the stated queries, against all items
    scored = ret.cosine_scores(w.where("doc_id % 20 = 0"), w).where("query_id <> doc_id").withColumn("similarity", F.round("similarity", 6))
    return rel.top_k(scored, 5, "similarity", ["doc_id"], ["query_id"])


@query("""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS dv FROM embeddings),
 s AS (SELECT query_id, vec_id, round(list_cosine_similarity(qv, dv), 5) AS similarity FROM q JOIN v ON query_id <> vec_id) SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10""")
def dense_cosine_topk(t):
    """Vectors whose id is divisible by 20 are the stated queries, against all vectors."""
    e = t.table("embeddings").select("vec_id", "embedding")
    return ret.dense_top_k(e.where("vec_id % 20 = 0"), e, 10, digits=5)


_CENTROID = """e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2), nn AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1), c AS (SELECT m.label, i, m / n AS c FROM m JOIN nn ON m.label = nn.label)"""


@query(f"WITH {_CENTROID} SELECT label, (i - 1)::INTEGER AS dim, round(c, 5) AS value FROM c")
def track_centroids(t):
    return ret.centroids(t.table("embeddings"), "label").select("label", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 5))


@query(f"WITH {_CENTROID} SELECT a.label AS label_a, b.label AS label_b, round(sum(a.c * b.c), 5) AS similarity FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2")
def centroid_similarity(t):
    return ret.centroid_similarity(t.table("embeddings"), "label").withColumn("similarity", F.round("similarity", 5))


@query("SELECT user_id, job_id, weight FROM pairs")
def max_event_weight(t):
    return cf.interactions(t.events, WEIGHTS)


@query("SELECT job_id, count(DISTINCT user_id) AS users FROM pairs GROUP BY 1")
def popularity(t):
    return cf.popularity(cf.interactions(t.events, WEIGHTS))


_ITEM = "n AS (SELECT job_id, count(*) AS n FROM pairs GROUP BY 1), sim AS (SELECT a.job_id AS job_a, b.job_id AS job_b, count(*) / sqrt(any_value(na.n) * any_value(nb.n)) AS similarity FROM pairs a JOIN pairs b ON a.user_id = b.user_id AND a.job_id <> b.job_id JOIN n na ON na.job_id = a.job_id JOIN n nb ON nb.job_id = b.job_id GROUP BY 1, 2)"


@query(f"WITH {_ITEM} SELECT job_a, job_b, round(similarity, 6) AS similarity FROM sim")
def item_cosine(t):
    return cf.item_cosine(cf.interactions(t.events, WEIGHTS)).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_ITEM} SELECT p.user_id, s.job_b AS job_id, round(sum(similarity), 5) AS score FROM pairs p JOIN sim s ON p.job_id = s.job_a GROUP BY 1, 2")
def item_knn_scores(t):
    pairs = cf.interactions(t.events, WEIGHTS)
    return cf.item_knn_scores(pairs, cf.item_cosine(pairs)).withColumn("score", F.round("score", 5))


def _user_scores(t):
    """For each user and job a content score (mean value) and a collaborative one (unknown for views only)."""
    e = t.events
    return e.groupBy("user_id", "job_id").agg(F.round(F.avg("value"), 6).alias("cbf"), F.max(F.when(F.col("event") != "view", F.round("value", 6))).alias("cf")).withColumn("is_active", F.col("job_id") % 5 != 0)


_SCORES = "sc AS (SELECT user_id, job_id, round(avg(value), 6) AS cbf, max(CASE WHEN event <> 'view' THEN round(value, 6) END) AS cf, job_id % 5 <> 0 AS is_active FROM ev GROUP BY 1, 2)"


@query(f"""WITH {_SCORES}, z AS (SELECT *, CASE WHEN count(CASE WHEN is_active THEN cbf END) OVER w <= 1 THEN 0.0::DOUBLE ELSE (cbf - avg(CASE WHEN is_active THEN cbf END) OVER w) / (stddev_pop(CASE WHEN is_active THEN cbf END) OVER w + 1e-9::DOUBLE) END AS a,
 CASE WHEN count(CASE WHEN is_active THEN cf END) OVER w <= 1 THEN 0.0::DOUBLE ELSE (cf - avg(CASE WHEN is_active THEN cf END) OVER w) / (stddev_pop(CASE WHEN is_active THEN cf END) OVER w + 1e-9::DOUBLE) END AS b FROM sc WINDOW w AS (PARTITION BY user_id))
 SELECT user_id, job_id, round(CASE WHEN cf IS NULL THEN a ELSE 0.5::DOUBLE * a + 0.5::DOUBLE * b END, 4) AS hybrid FROM z WHERE is_active""")
def zscore_blend(t):
    return hybrid.hybrid_scores(_user_scores(t), ["user_id"]).where("is_active").select("user_id", "job_id", F.round("hybrid", 4).alias("hybrid"))


@query(f"""WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY cf NULLS LAST) AS r, count(*) OVER (PARTITION BY user_id, cf) AS ties, count(cf) OVER (PARTITION BY user_id) AS known FROM sc)
 SELECT user_id, job_id, CASE WHEN cf IS NOT NULL THEN round((r + (ties - 1) / 2.0::DOUBLE) / known * 100, 1) END AS percentile FROM r""")
def cf_percentile(t):
    return _user_scores(t).select("user_id", "job_id", hybrid.percentile_rank(F.col("cf"), ["user_id"]).alias("percentile"))


@query(f"WITH {_SCORES}, m AS (SELECT *, min(cbf) OVER w AS lo, max(cbf) OVER w AS hi FROM sc WINDOW w AS (PARTITION BY user_id)) SELECT user_id, job_id, round(CASE WHEN hi > lo THEN (cbf - lo) / (hi - lo) ELSE 0.0::DOUBLE END, 5) AS value FROM m")
def min_max(t):
    return _user_scores(t).select("user_id", "job_id", F.round(hybrid.min_max(F.col("cbf"), ["user_id"]), 5).alias("value"))


_PARTS = """p AS (SELECT job_id, CASE WHEN salary_max_vnd IS NULL THEN NULL WHEN salary_max_vnd >= 200000 THEN 1.0::DOUBLE ELSE round(salary_max_vnd / 200000, 3) END AS s_sal,
 CASE WHEN experience_min IS NULL OR experience_min = 0 THEN 1.0::DOUBLE WHEN 2 - experience_min >= 0 THEN 1.0::DOUBLE WHEN 2 - experience_min >= -1 THEN 0.7::DOUBLE WHEN 2 - experience_min >= -2 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS s_exp,
 round(0.5::DOUBLE * CASE WHEN lower(city) = 'france' OR work_mode = 'Remote' THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END + 0.5::DOUBLE * CASE WHEN work_mode = 'Hybrid' THEN 1.0::DOUBLE WHEN work_mode = 'Remote' THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END, 3) AS s_loc FROM jobs)"""


def _parts(t):
    none = F.lit(None).cast("double")
    return t.jobs.select(
        "job_id", scoring.salary_score(F.lit(200_000.0), F.col("salary_min_vnd"), F.col("salary_max_vnd")).alias("s_sal"), scoring.experience_score(F.lit(2.0), F.col("experience_min"), none).alias("s_exp"),
        scoring.place_score(F.lit("FRANCE"), F.array(F.lit("hybrid")), F.col("city"), F.col("work_mode")).alias("s_loc"),
    )


@query(f"WITH {_PARTS} SELECT * FROM p")
def component_scores(t):
    return _parts(t)


@query(f"""WITH {_PARTS} SELECT job_id, round((0.1::DOUBLE * s_exp + 0.1::DOUBLE * s_loc + coalesce(0.1::DOUBLE * s_sal, 0)) / (0.2::DOUBLE + CASE WHEN s_sal IS NULL THEN 0 ELSE 0.1::DOUBLE END), 4) AS score FROM p""")
def null_rescaled_score(t):
    scored = _parts(t).withColumns({"s_skills": F.lit(None).cast("double"), "s_text": F.lit(None).cast("double")})
    return scored.select("job_id", scoring.combine({k: F.col(f"s_{k}") for k in scoring.WEIGHTS}).alias("score"))



def _ranked(t):
    d = t.table("documents").join(t.table("labels"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), F.col("quality").alias("gain"), "n_chars")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("n_chars").desc(), "item_id")))


_RANKED = "rk AS (SELECT source AS query_id, d.doc_id AS item_id, quality AS gain, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"""WITH {_RANKED}, p AS (SELECT query_id, sum(gain)::DOUBLE / 5 AS precision, sum(gain / log2(rank + 1)) AS dcg FROM rk WHERE rank <= 5 GROUP BY 1), i AS (SELECT query_id, sum(gain / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS r FROM rk) WHERE r <= 5 GROUP BY 1)
 SELECT p.query_id, round(precision, 6) AS precision, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM p JOIN i ON p.query_id = i.query_id""")
def precision_ndcg(t):
    ranked = _ranked(t)
    p = metrics.precision_at(ranked, 5, relevant="gain")
    n = metrics.ndcg_at(ranked, ranked, 5)
    return p.join(n, "query_id").select("query_id", F.round("precision", 6).alias("precision"), F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {_RANKED} SELECT query_id, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM rk WHERE gain = 1 GROUP BY 1")
def recall_at_10(t):
    ranked = _ranked(t)
    return metrics.recall_at(ranked, ranked.where("gain = 1").select("query_id", "item_id"), 10).withColumn("recall", F.round("recall", 6))


@query("SELECT 'train' AS part, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts < TIMESTAMP '2024-01-16' UNION ALL SELECT 'test', count(*), min(event_id) FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-31'")
def time_split(t):
    import datetime as dt

    train, test = metrics.time_split(t.table("events"), "ts", dt.datetime(2024, 1, 16), dt.datetime(2024, 1, 31))
    one = [F.count("*").alias("n"), F.min("event_id").alias("first_id")]
    return train.agg(*one).select(F.lit("train").alias("part"), "*").unionByName(test.agg(*one).select(F.lit("test").alias("part"), "*"))


@query("SELECT event_type, count(*) AS hours, sum(n)::BIGINT AS events, max(n) AS most FROM (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def hourly_events(t):
    counts = stream.windowed_counts(t.table("events"))
    return counts.groupBy("event_type").agg(F.count("*").alias("hours"), F.sum("n").alias("events"), F.max("n").alias("most"))


@query()
def near_duplicate_postings(t):
    """The three-layer deduplication with documents as postings, their first words as titles and sources as companies."""
    words = F.split("text", r"\s+")
    jobs = t.table("documents").select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("company_name"), F.array_join(F.slice(words, 1, 6), " ").alias("title"), F.col("text").alias("description_clean"),
        F.lit("").alias("deadline"), F.col("lang").alias("city"), F.lit(None).cast("double").alias("experience_min"),
    )
    return dedup.deduplicate(jobs)[1]


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, n_regionkey + 1000 AS b FROM nation) SELECT a AS id, min(a2) AS root FROM (SELECT x.a, y.a AS a2 FROM e x JOIN e y ON x.b = y.b) GROUP BY 1 UNION ALL SELECT b, min(a) FROM e GROUP BY 1""".replace("WITH RECURSIVE ", "WITH "))
def link_components(t):
    links = t.table("nation").select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 1000).alias("b"))
    return graph.components(links)


@query()
def als_scores(t):
    pairs = cf.interactions(t.events, WEIGHTS)
    users, jobs = cf.als(pairs)
    return cf.cf_scores(pairs.select("user_id", "job_id"), users, jobs)


@query()
def simulated_events(t):
    affinity = t.events.groupBy("user_id", "job_id").agg(F.avg("value").alias("content"))
    return simulate.funnel(simulate.slates(simulate.utilities(affinity)))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE length(trim(title)) >= 2) AS t, count(*) FILTER (WHERE length(trim(company_name)) >= 2) AS c, count(DISTINCT job_id) AS ids, count(*) FILTER (WHERE salary_min_vnd > salary_max_vnd) AS inv,
   count(*) FILTER (WHERE published_at < TIMESTAMP '2020-01-01') AS old, count(*) FILTER (WHERE company_id NOT IN (SELECT company_id FROM companies)) AS lost, (SELECT count(*) FROM events) AS snaps, (SELECT count(*) FROM job_skills) AS links,
   (SELECT count(*) FROM job_skills WHERE skill_id NOT IN (SELECT skill_id FROM skills)) AS lost_skills FROM jobs),
 r(rule_name, entity_type, severity, source_id, total, passed) AS (
  SELECT 'CHK_TITLE_NOT_EMPTY', 'job', 'CRITICAL', NULL::INTEGER, n, t FROM n UNION ALL SELECT 'CHK_COMPANY_NAME_NOT_EMPTY', 'company', 'CRITICAL', NULL, n, c FROM n
  UNION ALL SELECT 'CHK_JD_CONTENT_NOT_EMPTY', 'job_description', 'CRITICAL', NULL, n, n FROM n UNION ALL SELECT 'CHK_VALID_JOB_URL_FORMAT', 'job_source_record', 'ERROR', NULL, n, n FROM n
  UNION ALL SELECT 'CHK_UNIQUE_SOURCE_JOB_ID', 'job_source_record', 'CRITICAL', NULL, n, ids FROM n UNION ALL SELECT 'CHK_FK_COMPANY_INTEGRITY', 'job', 'CRITICAL', NULL, n, n - lost FROM n
  UNION ALL SELECT 'CHK_JOB_DESCRIPTION_1TO1_MATCH', 'job_description', 'CRITICAL', NULL, n, n FROM n UNION ALL SELECT 'CHK_SALARY_RANGE_LOGIC', 'job', 'ERROR', NULL, n, n - inv FROM n
  UNION ALL SELECT 'CHK_DEADLINE_REASONABLE', 'job', 'WARNING', NULL, n, n - old FROM n UNION ALL SELECT 'CHK_SNAPSHOT_COMPLETENESS', 'job_snapshot', 'CRITICAL', NULL, n, least(snaps, n) FROM n
  UNION ALL SELECT 'CHK_SKILL_FK_INTEGRITY', 'job_skill', 'CRITICAL', NULL, links, links - lost_skills FROM n
  UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'CHK_SOURCE_INGESTION_TOPDEV' ELSE 'CHK_SOURCE_INGESTION_TOPCV' END, 'job_source_record', 'INFO', CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END, count(*), count(*) FROM orders GROUP BY 1, 4)
 SELECT *, CASE WHEN total > 0 THEN round(100.0::DOUBLE * passed / total, 2) ELSE 100.0 END AS pass_rate, CASE WHEN passed = total THEN 'PASSED' WHEN severity IN ('CRITICAL', 'ERROR') THEN 'FAILED' ELSE 'WARNING' END AS status FROM r""")
def dq_rules(t):
    jobs, o = t.jobs.withColumn("deadline", F.date_format("published_at", "yyyy-MM-dd")), t.table("orders")
    merged = jobs.select(F.col("title").alias("title_raw"), F.col("company_name").alias("company_name_raw"), F.concat(F.col("title"), F.lit(" description")).alias("responsibilities_raw"), F.lit("").alias("requirements_raw"), F.lit("https://e.com").alias("job_url"), F.lit(1).alias("source_id"), F.col("job_id").cast("string").alias("source_job_id"))
    records = o.select(F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("source_id"))
    return dq.evaluate(merged, jobs, t.companies, jobs, t.table("events"), t.job_skills, t.skills, records, {1: "TopCV", 2: "TopDev"})


@query()
def skills_in_conversations(t):
    dictionary = {"the": "The", "and": "And", "data": "Data", "sql": "SQL", "python": "Python", "c++": "C++"}
    return t.table("conversations").select("conv_id", "turn", F.array_join(sk.scan_text(F.col("text"), dictionary), ",").alias("skills"))


from . import golden as _golden, market as _market  # noqa: E402, F401  they register further queries
