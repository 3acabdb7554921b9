"""Session helpers. Nothing here is needed on a cluster that already has a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = "*", app: str = "factsieve", memory: str = "20g") -> SparkSession:
    """A local session for tests and benchmarks. Where no shared folder is configured it gets one of its own below /tmp."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):  # it can only be set before a session starts
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and hand-over tables, as named in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name below the shared folder (never reused, never cleared)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, name: str = "cut"):
    """Write ``df`` to the shared folder and read it back: survives executor loss, cuts the plan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
