"""Readers of raw drops: {base}/{source}/{listings|details}/{date}/*.json."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_TEXT = T.StringType()


def _schema(names: str, **other) -> T.StructType:
    return T.StructType([T.StructField(n, other.get(n, _TEXT)) for n in names.split()])


LISTING = _schema(
    "source source_job_id job_url title_raw company_name_raw company_url company_logo_url location_raw salary_raw experience_raw tags_raw published_at_raw deadline_raw crawled_at "
    "detail_status detail_attempts detail_http_status detail_error raw_file_name", detail_attempts=T.IntegerType(), detail_http_status=T.IntegerType(),
)
DETAIL = _schema(
    "detail_id source source_job_id job_url title_raw company_name_raw company_url company_size_raw company_location_raw industry_raw location_raw work_mode_raw employment_type_raw salary_raw "
    "experience_raw education_raw level_raw skills_raw preferred_skills_raw overview_raw responsibilities_raw requirements_raw benefits_raw published_at_raw deadline_raw crawled_at language_raw "
    "quantity_raw category_raw raw_file_name dq_status dq_errors", dq_errors=T.ArrayType(_TEXT),
)
EVENT = _schema("ts user_id job_id event position source", position=T.IntegerType())
IMPRESSION = _schema("ts user_id job_id position source mode", position=T.IntegerType())


def read_raw(spark: SparkSession, base: str, kind: str, date: str | None = None, source: str | None = None) -> DataFrame:
    """Records of one kind with raw_file_name and raw_date. Files may hold a list or one object; unreadable ones are skipped."""
    schema = LISTING if kind == "listings" else DETAIL
    path = f"{base}/{source or '*'}/{kind}/{date or '*'}/*.json"
    frame = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(path)
    where = F.col("_metadata.file_path")
    return frame.withColumns({"raw_file_name": F.regexp_extract(where, r"([^/]+)$", 1), "raw_date": F.regexp_extract(where, r"/(\d{4}-\d{2}-\d{2})/", 1)})


def dates(raw: DataFrame) -> DataFrame:
    return raw.select("raw_date").where(F.col("raw_date").rlike(r"^\d{4}-\d{2}-\d{2}$")).distinct().orderBy("raw_date")


def latest_date(raw: DataFrame) -> DataFrame:
    return raw.agg(F.max(F.nullif(F.col("raw_date"), F.lit(""))).alias("latest_date"))


def read_log(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """A CSV log with a header; an empty frame if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several paths that exists, Parquet or CSV."""
    for p in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(p)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.option("header", True).csv(p) if p.endswith(".csv") else spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def crawled_ids(details: DataFrame, key: str = "source_job_id") -> DataFrame:
    return details.select(key).where(F.trim(F.coalesce(key, F.lit(""))) != "").distinct()


def next_status(frame: DataFrame, max_attempts: int = 3) -> DataFrame:
    """detail_status after an attempt: expired on 404, success on 200, failed after the last attempt, else pending."""
    code, tries = F.col("detail_http_status"), F.coalesce("detail_attempts", F.lit(0)) + 1
    status = F.when(code == 404, "expired").when(code == 200, "success").when(tries >= max_attempts, "failed").otherwise("pending")
    return frame.withColumns({"detail_status": status, "detail_attempts": tries})
