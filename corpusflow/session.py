"""Session settings and the folder shared by all machines of the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpusflow")
    for name, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": os.environ.get("CORPUSFLOW_DRIVER_MEMORY", "12g"),
        **settings,
    }.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Setting for the bytes that go to Python at a time, and what is set unless the session has its own:
#: Spark's default of 64 MB, held several times over in each task, is much for long texts.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def small_batches(spark: SparkSession) -> None:
    """See to it that rows go to Python in batches of a few megabytes."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors can reach.

    A local session without that setting gets a temporary folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def handed_over(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` as a table in the shared folder, computed once and safe from lost executors."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
