"""Session defaults and the shared folder for data that must outlive executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from joblattice.operators.skew import ADAPTIVE


def local_session(cores: str = "*", app: str = "joblattice") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("JOBLATTICE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        # small files are read by all cores
        .config("spark.sql.files.maxPartitionBytes", "4m")
    )
    for name, value in ADAPTIVE.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session, which has no other machines, may fall back to a
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own
