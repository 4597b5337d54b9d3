"""Master tables with the last write for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .quality import STATUS_RANK


def record_key() -> Column:
    """source_job key of a record; without both parts the detail id, else the address."""
    whole = F.concat(F.coalesce("source", F.lit("")), F.lit("_"), F.coalesce("source_job_id", F.lit("")))
    return F.when(whole != "_", whole).otherwise(F.coalesce(F.nullif(F.col("detail_id"), F.lit("")), F.nullif(F.col("job_url"), F.lit(""))))


def latest(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """existing with incoming rows in place of, or beside, those with equal keys; of several incoming rows the first in ``order`` counts."""
    fresh = latest(incoming, keys, order) if order else incoming.dropDuplicates(keys)
    return existing.join(fresh.select(keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def save_master(existing: DataFrame, incoming: DataFrame, key: str, position: str, remove: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The new master, and one row (added, total). Of incoming rows the one with the greatest position counts; keys in ``remove`` go first."""
    kept = existing if remove is None else existing.join(remove.select(key), key, "left_anti")
    merged = upsert(kept, incoming, [key], [F.col(position).desc()])
    counts = merged.agg(F.count("*").alias("total")).crossJoin(kept.agg(F.count("*").alias("old")))  # one row each
    return merged, counts.select((F.col("total") - F.col("old")).alias("added"), "total")


def latest_verdicts(records: DataFrame, key: str, crawled_at: str = "crawled_at", status: str = "dq_status") -> DataFrame:
    """Each key's status at its latest crawl; of equal times invalid beats quarantine beats valid."""
    rank = F.coalesce(*[F.when(F.col(status) == s, F.lit(r)) for s, r in STATUS_RANK.items()])
    return records.groupBy(key).agg(F.max_by(F.col(status), F.struct(F.coalesce(crawled_at, F.lit("")), rank)).alias(status))


def exclusive_masters(masters: dict[str, DataFrame], incoming: DataFrame, key: str, position: str) -> dict[str, DataFrame]:
    """Masters by status, so that each key stands only in that of its latest verdict."""
    verdicts = latest_verdicts(incoming, key)
    out = {}
    for status, master in masters.items():
        own = incoming.join(verdicts.where(F.col("dq_status") == status).select(key), key, "left_semi").where(F.col("dq_status") == status)
        gone = verdicts.where(F.col("dq_status") != status).select(key)
        out[status] = save_master(master, own, key, position, gone)[0]
    return out


def update_column(frame: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """frame with the column's value from changes where a key has one."""
    fresh = changes.select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    joined = frame.join(fresh, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_key", "_new")
