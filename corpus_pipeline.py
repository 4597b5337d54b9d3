"""From raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; the
next one reads what it returned from Parquet. All but the last return rows with
the columns of docs. Null and repeated rows, empty texts and empty tables are
handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.llm import common, exact_dedup, mixing, near_dedup, packing, quality, queries
from tessera.session import read_table, share_code

#: Documents score at least this, the probability that they are labelled good.
QUALITY_THRESHOLD = 0.7


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good."""
    share_code(spark)
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir, docs), QUALITY_THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    share_code(spark)
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; one row of those equal in id and text.

    Different texts of one id are documents of their own. All but the first of
    them, by hash, come after all ids. Of equal rows the least one stays.
    """
    share_code(spark)
    # the rows as they are, in one column, so that no name can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("hash", F.sha2(F.coalesce("row.text", F.lit("")), 256)).withColumn("key", F.col("row.doc_id").cast("long"))
    texts = keyed.where("key is not null").select("key", "hash").distinct()
    further = common.materialise(texts.withColumn("at", F.row_number().over(W.partitionBy("key").orderBy("hash"))).where("at > 1").select("key", "hash"), "further-texts")
    if not further.isEmpty():
        most = F.lit(keyed.agg(F.max("key")).first()[0])
        # ascending by key and hash; a number's size depends on how the rows are spread, their order doesn't
        numbers = common.materialise(further.orderBy("key", "hash").withColumn("number", most + 1 + F.monotonically_increasing_id()), "numbers")
        keyed = keyed.join(numbers, ["key", "hash"], "left").select("row", "hash", F.coalesce("number", "key").alias("key"))
    groups = near_dedup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct()
    left = keyed.join(dropped, "key", "left_anti").groupBy("key", "hash").agg(F.min("row").alias("row"))
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    share_code(spark)
    mixed = mixing.mix(docs).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0").alias("m")
    # the rows as they are, in one column, so that no name can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("hash"))
    joined = keyed.join(mixed, F.expr("row.doc_id <=> m.doc_id and row.source <=> m.source and hash = m.text_hash"))
    # rows equal in id, source and text share what is taken of them
    rank = F.row_number().over(W.partitionBy("row.doc_id", "row.source", "hash").orderBy(F.lit(0)))
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(rank <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    turns = joined.withColumn("own", own.cast("int")).where("own > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("own"))))
    return turns.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences with their token ids."""
    share_code(spark)
    pieces = packing.pack(docs, public_tokenizers.path(queries.TOKENIZER))
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", filter_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialise(docs, name.replace(" ", "-"))
    return docs
