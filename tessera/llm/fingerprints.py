"""Bottom-k sketches of word shingles.

A document's fingerprint holds the k smallest of its distinct shingle hashes.
Sketches merge: the k smallest hashes of several sketches are the sketch of the
union. From two sketches come estimates of resemblance and containment, from
one the number of distinct shingles.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES
from .shingles import shingle_sets

K = 128


def encode(hashes: np.ndarray) -> str:
    """The sketch as text: ascending big-endian hashes in base 64."""
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=">u8").astype(np.uint64)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of distinct ascending hashes."""
    return hashes[:k]


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, dtype=np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of the union's shingles that both have; exact while the union has at most k. Two empty sets: 1."""
    union = merge([a, b], k)
    if not len(union):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, union[-1], side="right") / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has; 1 if a is empty."""
    own = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge([a, b], k), k) / own) if own else 1.0


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, fingerprint and n_shingles of each whole text; see shingles.shingle_sets. Null counts as empty."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        from .common import chunks

        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets([t.encode() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(sketch(s, k)) for s in sets]), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "fingerprint", "n_shingles"])

    return slim.mapInArrow(run, "doc_id long, fingerprint string, n_shingles long")


def merge_fingerprints(frame: DataFrame, key: str, k: int = K) -> DataFrame:
    """One merged fingerprint for each key (key, fingerprint).

    Each map task merges its own rows first, so a hot key sends one sketch a
    task; the second level gathers at most that many.
    """
    schema = frame.select(key, "fingerprint").schema

    def fold(batches):
        held: dict = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[name] = merge([held.get(name, np.zeros(0, np.uint64)), decode(text)], k)
        names = list(held)
        from pyspark.sql.pandas.types import to_arrow_schema

        yield pa.RecordBatch.from_arrays([pa.array(names, to_arrow_schema(schema)[0].type), pa.array([encode(held[n]) for n in names], pa.string())], [key, "fingerprint"])

    local = frame.select(key, "fingerprint").mapInArrow(fold, schema)
    return local.repartition(F.col(key)).mapInArrow(fold, schema)


def edited_text(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text (see edited_text; the next document by ascending id follows, after the last the first).

    Returns doc_id, n_chars, edited (text), fingerprint, edited_fingerprint,
    near_edited and near_next. Null texts count as empty; rows with equal ids
    follow each other by text; null ids come first. A single document follows
    itself. Texts of fewer than five words have one shingle, their whole sequence.

    The rows are dealt out by ranges of the id, each row once; the first row of
    a range is also sent to the range before it, so that no task needs more.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    session = docs.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), slim.rdd.getNumPartitions())
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    ids = slim.select(key.alias("_key"))
    bounds = sorted({b for b in ids.where("_key > double('-infinity')").approxQuantile("_key", [i / parts for i in range(1, parts)], 0.2 / parts)})
    if bounds:
        from pyspark.ml.feature import Bucketizer

        inf = float("inf")
        cut = Bucketizer(splits=[-inf, *bounds, inf], inputCol="_key", outputCol="_range")
        ranged = cut.transform(slim.withColumn("_key", key)).withColumn("_range", F.col("_range").cast("int"))
    else:
        ranged = slim.withColumn("_key", key).withColumn("_range", F.lit(0))
    # one row for each range: its first id, and the range before it
    firsts = sorted((r["_range"], r["_first"]) for r in ranged.groupBy("_range").agg(F.min("_key").alias("_first")).collect())
    if not firsts:
        return session.createDataFrame([], "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = session.createDataFrame(before, "_key double, _before int")
    sent = ranged.join(F.broadcast(heads), "_key", "left")
    places = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("after"))))
    places = places.otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("after")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("after"))))
    sent = sent.select("doc_id", "text", F.explode(places).alias("_p")).select("doc_id", "text", F.col("_p.r").alias("_range"), F.col("_p.after").alias("_after"))
    # a partition for each range
    dealt = sent.repartitionById(parts, F.col("_range")).sortWithinPartitions("_range", "_after", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def digest(run: list[tuple]):
        """Results for all rows of a run but the last, which only follows."""
        texts = [t for _, t in run]
        edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
        sets = [sketch(s, k) for s in shingle_sets([t.encode() for t in texts + edited])]
        own, changed = sets[: len(texts)], sets[len(texts) :]
        codes = [encode(s) for s in own]
        n = len(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in run[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(edited, pa.string()),
            pa.array(codes[:n], pa.string()), pa.array([encode(s) for s in changed], pa.string()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, changed)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64()),
        ], schema=schema)

    def work(batches):
        run, size, at, closed = [], 0, None, False
        for batch in batches:
            for doc_id, text, place, after in zip(*(c.to_pylist() for c in batch.columns)):
                if place != at:
                    if len(run) > 1:
                        yield digest(run)
                    run, size, at, closed = [], 0, place, False
                if closed:
                    continue  # of rows that share the following range's first id, the first follows
                closed = bool(after)
                run.append((doc_id, text))
                size += 2 * len(text)
                if size > CHUNK_BYTES and len(run) > 1:
                    yield digest(run)
                    run, size = run[-1:], len(text)
        if len(run) > 1:
            yield digest(run)

    return dealt.mapInArrow(work, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
