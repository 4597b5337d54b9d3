"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space and words as the contracts define them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: About how many bytes of text a Python worker handles at once.
CHUNK_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, as in local tests, a folder of this machine is set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
        found = sc.getCheckpointDir()
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended, and its folder with it
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again.

    This cuts the lineage: a lost executor costs at most the work since the
    last written table, and later readers don't compute it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunks(batch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a record batch of about ``limit`` bytes of text, one row at least."""
    sizes = batch.column(batch.schema.get_field_index(column))
    import numpy as np
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.binary_length(sizes), 0))
    if not len(lengths):
        return
    group = (np.cumsum(lengths) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
