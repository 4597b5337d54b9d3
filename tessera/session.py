"""Session settings shared by the queries, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parent.parent)
#: Texts may be long, so batches for Python are bounded by bytes besides rows.
ARROW_BATCH_BYTES = 8 << 20
#: Python workers give freed memory back instead of keeping it for later batches.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_code(spark: SparkSession) -> None:
    """Python workers on hosts that see this checkout import the package from it; their batches are kept small.

    Clusters that don't should ship the package with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    env = spark.sparkContext.environment
    env.update(WORKER_MEMORY)
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), REPO]))


def read_table(spark: SparkSession, base: str, name: str):
    """One of the parquet tables under ``base``."""
    share_code(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """frame, checkpointed to the folder in spark.checkpoint.dir, which all executors share.

    Where the setting is absent a local session, as in tests, gets a folder of its own; a cluster must name one.
    """
    sc = frame.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            found = os.path.join(tempfile.gettempdir(), "checkpoints")
        sc.setCheckpointDir(found)
    return frame.checkpoint()
