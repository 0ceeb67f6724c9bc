"""Session settings the results depend on, and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster, submit with the cluster's own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barograph")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return pin_utc(spark)


def pin_utc(spark: SparkSession) -> SparkSession:
    """Hours and dates are UTC hours and dates, whatever zone the session was started in."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is only made up where there is a single machine anyway (a local master).
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barograph-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/barograph/{name}-{uuid4().hex}"
