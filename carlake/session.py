"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Sides that adaptive execution has measured to be below this many bytes may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join side is split even when that costs one more shuffle later
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
    "spark.sql.sources.partitionOverwriteMode": "static",
    # the JVM compiles no method above 8000 bytes; beyond it Spark shall split the code instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own sizes."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("carlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _test_dir() -> str:
    return tempfile.mkdtemp(prefix="carlake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it; a local one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _test_dir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, so that no run overwrites another."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, parts: int | None) -> DataFrame:
    """Deals an input to ``parts`` tasks before costly work on each row; None leaves its splits alone.

    A file is read in as many tasks as it has row groups, so a small table may keep one core busy; a large one
    has splits enough. The caller knows which it is."""
    return df if parts is None else df.repartition(parts)
