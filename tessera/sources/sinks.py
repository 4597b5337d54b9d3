"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def flat(frame: DataFrame) -> DataFrame:
    """Arrays of text as one text, for files without nested types."""
    return frame.select(*[F.array_join(f.name, ", ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in frame.schema])


def write_clean(frame: DataFrame, path: str) -> None:
    """Parquet with arrays, and CSV without (and without a byte-order mark, which Spark doesn't write)."""
    frame.write.mode("overwrite").parquet(f"{path}/parquet")
    flat(frame).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_batch(frame: DataFrame, base: str, date: str = "raw_date") -> None:
    """JSON by source and date."""
    frame.withColumn("source", F.lower("source")).write.mode("append").partitionBy("source", date).json(base)


def append_events(events: DataFrame, path: str) -> None:
    from ..operators.cf import checked_events

    checked_events(events).write.mode("append").option("header", True).csv(path)


def append_impressions(slates: DataFrame, path: str, items: str = "job_ids") -> None:
    """One row for each shown item, its place in the slate as position."""
    rows = slates.select("*", F.posexplode(items).alias("position", "job_id")).drop(items)
    rows.write.mode("append").option("header", True).csv(path)


def append_metrics(profile: DataFrame, path: str, evaluated_at: str) -> None:
    profile.withColumn("evaluated_at", F.lit(evaluated_at)).write.mode("append").parquet(path)


def write_model(parts: dict[str, DataFrame], signature: DataFrame, path: str) -> None:
    """A model's tables, and the signature of the data that it was made from."""
    for name, frame in parts.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    signature.write.mode("overwrite").parquet(f"{path}/signature")


def signature(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, digest), whatever the rows' order."""
    digest = F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]).cast("decimal(38,0)")).cast("string")
    return frame.agg(F.count("*").alias("rows"), F.md5(F.concat_ws("|", F.count("*").cast("string"), digest)).alias("digest"))
