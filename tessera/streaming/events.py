"""Event logs as streams. The batch operators are the reference; these are extensions of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of each kind in windows; works on streams and on tables."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if events.isStreaming else timed
    counts = timed.groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), kind, "n")


def upsert_batches(stream: DataFrame, master_path: str, keys: list[str], order: str, checkpoint: str):
    """A query that keeps the last row of each key in a Parquet table, by batches. A batch that is run again gives the same table."""
    from ..operators.upsert import upsert

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = f"{master_path}/v{number}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{master_path}/v{number - 1}")
        old = spark.read.parquet(f"{master_path}/v{number - 1}") if number and hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else spark.createDataFrame([], batch.schema)
        upsert(old, batch, keys, [F.col(order).desc()]).write.mode("overwrite").parquet(version)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_per_key(stream: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once while its time is within the watermark."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.dropDuplicatesWithinWatermark(keys)


def running_weights(stream: DataFrame, weights: dict[str, float], kind: str = "event_type") -> DataFrame:
    """The greatest event weight of each user and item so far."""
    weight = F.coalesce(*[F.when(F.col(kind) == k, F.lit(w)) for k, w in weights.items()], F.lit(0.0))
    return stream.groupBy("user_id", "item_id").agg(F.max(weight).alias("weight"))
