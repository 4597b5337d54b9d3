"""The driver's tables in the roles of the engine's star schema, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import read_table


class Tables:
    """Lazily read tables and the roles they play."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base, name)

    @property
    def jobs(self) -> DataFrame:
        """orders as postings; the city is the customer's nation. The nations are 25 rows by the table's definition."""
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        status = F.col("o_orderstatus")
        joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        mode = F.when(F.col("o_orderpriority").startswith("1"), "Remote").when(F.col("o_orderpriority").startswith("2"), "Hybrid").otherwise("Onsite")
        return joined.select(
            F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id"), (status == "O").alias("is_active"), F.col("o_orderpriority").alias("seniority"), F.col("n_name").alias("city"), mode.alias("work_mode"),
            F.when(status != "P", F.col("o_totalprice") * 0.5).alias("salary_min_vnd"), F.when(status != "P", F.col("o_totalprice")).alias("salary_max_vnd"),
            F.when(status != "P", F.month("o_orderdate") % 7).cast("double").alias("experience_min"), F.when(status == "F", F.month("o_orderdate") % 7 + 1).cast("double").alias("experience_max"), F.when(status == "P", "negotiable").otherwise("range").alias("salary_type"), F.col("o_orderdate").alias("published_at"), F.concat_ws(" ", F.lower("o_orderpriority"), "c_mktsegment").alias("title"), F.when(F.month("o_orderdate") % 4 == 0, "Contract").otherwise("Full-time").alias("employment_type"), F.col("c_name").alias("company_name"),
        )

    @property
    def companies(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("industry"))

    @property
    def skills(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("skill_name"), F.col("p_type").alias("skill_category"))

    @property
    def job_skills(self) -> DataFrame:
        """lineitem as the bridge: one row for each order and part, the least return flag as its type."""
        kind = F.min("l_returnflag").alias("flag")
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id")).agg(kind, F.max("l_discount").alias("confidence"))
        return lines.select("job_id", "skill_id", F.when(F.col("flag") == "R", "preferred").otherwise("required").alias("skill_type"), "confidence")

    @property
    def events(self) -> DataFrame:
        """events as interactions with the item that props names."""
        item = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select("event_id", "ts", "user_id", item.alias("job_id"), F.col("event_type").alias("event"), "value")


WEIGHTS = {"view": 1.0, "click": 2.0, "signup": 3.0, "purchase": 5.0}

ROLES = """
jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS company_id, o_orderstatus = 'O' AS is_active, o_orderpriority AS seniority, n_name AS city,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'Remote' WHEN o_orderpriority LIKE '2%' THEN 'Hybrid' ELSE 'Onsite' END AS work_mode,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 0.5::DOUBLE END AS salary_min_vnd, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS salary_max_vnd,
         CASE WHEN o_orderstatus <> 'P' THEN (month(o_orderdate) % 7)::DOUBLE END AS experience_min, CASE WHEN o_orderstatus = 'F' THEN (month(o_orderdate) % 7 + 1)::DOUBLE END AS experience_max,
         CASE WHEN o_orderstatus = 'P' THEN 'negotiable' ELSE 'range' END AS salary_type, o_orderdate AS published_at,
         lower(o_orderpriority) || ' ' || c_mktsegment AS title, CASE WHEN month(o_orderdate) % 4 = 0 THEN 'Contract' ELSE 'Full-time' END AS employment_type, c_name AS company_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
companies AS (SELECT c_custkey AS company_id, c_name AS company_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS industry FROM customer),
skills AS (SELECT p_partkey AS skill_id, p_name AS skill_name, p_type AS skill_category FROM part),
job_skills AS (
  SELECT l_orderkey AS job_id, l_partkey AS skill_id, CASE WHEN min(l_returnflag) = 'R' THEN 'preferred' ELSE 'required' END AS skill_type, max(l_discount) AS confidence
  FROM lineitem GROUP BY 1, 2),
ev AS (
  SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id, event_type AS event, value FROM events),
pairs AS (
  SELECT user_id, job_id, max(CASE event WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'signup' THEN 3.0 WHEN 'purchase' THEN 5.0 END)::DOUBLE AS weight
  FROM ev WHERE event IN ('view', 'click', 'signup', 'purchase') GROUP BY 1, 2)
"""
