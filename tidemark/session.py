"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone to UTC, the zone every operator assumes."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names. A folder of this machine is only taken where all of Spark runs on it
    and none is named (tests); on a cluster the setting is required."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[[^\]]*\])?$", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="run-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, for tables that several jobs read."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint: the files outlive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def local_session(app: str = "tidemark", cores: str = "8", shuffle: int = 8) -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    return utc(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-ckpt-"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
