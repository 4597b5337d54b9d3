"""Text retrieval: TF-IDF vectors as rows of (document, term, weight), cosines, dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import ngrams, tokens


def term_counts(docs: DataFrame, id_col: str, text_col: str, bigrams: bool = True) -> DataFrame:
    words = tokens(F.col(text_col))
    terms = F.explode(ngrams(words) if bigrams else words)
    return docs.select(F.col(id_col).alias("doc_id"), terms.alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """term, df, idf = ln((1 + n) / (1 + df)) + 1; the most frequent terms in the corpus if there is a limit, ties by term."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if max_features:
        terms = terms.orderBy(F.col("total").desc(), "term").limit(max_features)
    joined = terms.crossJoin(F.broadcast(n_docs))  # a row
    return joined.select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(counts: DataFrame, vocab: DataFrame, sublinear: bool = False) -> DataFrame:
    """doc_id, term, weight, of L2 norm one for each document."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = counts.join(vocab.select("term", "idf"), "term").select("doc_id", "term", (tf * F.col("idf")).alias("raw"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "doc_id").select("doc_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, sublinear: bool = False, bigrams: bool = True, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    counts = term_counts(docs, id_col, text_col, bigrams)
    vocab = vocabulary(counts, docs.agg(F.count("*").alias("n")), min_df, max_features)
    return weigh(counts, vocab, sublinear)


def cosine_scores(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, doc_id, similarity for all pairs that share a term; queries as (doc_id, term, weight) of the same vocabulary."""
    q = queries.select(F.col("doc_id").alias("query_id"), "term", F.col("weight").alias("qw"))
    return weights.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("similarity"))


def normalise_peak(scores: DataFrame, group: str, value: str) -> DataFrame:
    """value over the group's greatest, where that is positive."""
    peaks = scores.groupBy(F.col(group).alias("_group")).agg(F.max(value).alias("_peak"))  # a row for each stated query
    joined = scores.join(F.broadcast(peaks), F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(value, F.when(F.col("_peak") > 0, F.col(value) / F.col("_peak")).otherwise(F.col(value))).drop("_group", "_peak")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense_cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int | None = None, block: int = 1024) -> DataFrame:
    """query_id, id, similarity and rank of the k nearest vectors of each query, itself left out; ties by id.

    The stated queries are compared with all vectors in blocks of about
    ``block`` rows: a task multiplies two blocks and keeps each query's k best,
    so neither side is ever whole in one task. ``digits`` rounds before ranking.
    """
    import numpy as np
    import pyarrow as pa

    def blocks(frame: DataFrame, side: str) -> DataFrame:
        n = max(1, -(-frame.count() // block))
        part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n))
        return frame.groupBy(part).agg(F.collect_list(id_col).alias(f"{side}_ids"), F.collect_list(F.col(vector_col).cast("array<double>")).alias(f"{side}_rows")).select(f"{side}_ids", f"{side}_rows")

    def unit(rows) -> np.ndarray:
        m = np.array(rows, dtype=float)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def multiply(batches):
        for batch in batches:
            id_type = batch.column(0).type.value_type
            for q_ids, q_rows, v_ids, v_rows in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array(v_ids)
                order = np.argsort(ids)
                ids, scores = ids[order], unit(q_rows) @ unit(v_rows)[order].T
                scores = scores if digits is None else np.round(scores, digits)
                scores[np.array(q_ids)[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(scores, best, 1)
                keep = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, best.shape[1])[keep.ravel()], id_type), pa.array(ids[best][keep], id_type), pa.array(found[keep])], ["query_id", id_col, "similarity"])

    kind = vectors.schema[id_col].dataType.simpleString()
    pairs = blocks(queries, "q").crossJoin(blocks(vectors, "v"))  # of blocks
    scored = pairs.mapInArrow(multiply, f"query_id {kind}, {id_col} {kind}, similarity double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str, vector_col: str = "embedding") -> DataFrame:
    """Each label's mean vector of norm one."""
    means = vectors.select(label, F.posexplode(vector_col).alias("at", "x")).groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda p: p["mean"])
    rows = means.groupBy(label).agg(mean.alias("mean"))  # as long as a vector
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return rows.select(label, F.when(norm > 0, F.transform("mean", lambda x: x / norm)).otherwise(F.col("mean")).alias("centroid"))


def centroid_similarity(vectors: DataFrame, label: str, vector_col: str = "embedding") -> DataFrame:
    c = centroids(vectors, label, vector_col)
    a, b = c.toDF("label_a", "ca"), c.toDF("label_b", "cb")
    return a.join(b, F.expr("label_a < label_b")).select("label_a", "label_b", dot(F.col("ca"), F.col("cb")).alias("similarity"))


def pairwise_distribution(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 1000, seed: int = 42) -> DataFrame:
    """Mean, median, deviation and tails of the cosines of all pairs of a bounded sample."""
    few = vectors.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample).select(id_col, vector_col)
    a, b = few.toDF("a", "va"), few.toDF("b", "vb")
    cosines = a.join(b, F.expr("a < b")).select(dense_cosine(F.col("va"), F.col("vb")).alias("c"))
    return cosines.agg(F.avg("c").alias("mean"), F.percentile("c", 0.5).alias("median"), F.stddev_samp("c").alias("std"), F.percentile("c", 0.05).alias("p5"), F.percentile("c", 0.95).alias("p95"))
