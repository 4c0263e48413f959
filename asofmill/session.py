"""Session settings the operators rely on."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "asofmill", master: str | None = None, **settings) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution.

    ``spark.sql.shuffle.partitions`` is left to the caller or the cluster: adaptive execution coalesces small
    shuffles, so a large initial number is the safe choice at scale.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Without it every column expression records its Python call site, which makes building plans slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings exact results depend on; both can be changed on a live session."""
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.ansi.enabled", "true")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent and the master is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = os.path.join(tempfile.gettempdir(), "asofmill-shared")
    os.makedirs(folder, exist_ok=True)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and return it read back.

    For results that are expensive to make and read more than once, such as decoded pages: later reads prune columns,
    and a lost executor costs a file read instead of the whole lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand memory that Python has freed back to the system.

    Arrow and the C library keep what large results and arrays on the driver leave behind, so it would count beside everything that
    runs later. Elsewhere than on glibc only Arrow's part goes.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
