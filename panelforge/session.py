"""Session helpers: builder defaults, shipping the package to executors, shared scratch folders."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

#: Runtime settings that bound what one Arrow batch holds in a Python worker.
ARROW_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def builder(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession.Builder:
    """Builder with UTC, adaptive execution and ANSI mode left on."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers (once a context) and bound Arrow batches."""
    sc = spark.sparkContext
    for key, value in ARROW_LIMITS.items():
        spark.conf.set(key, value)
    if getattr(sc, "_panelforge_shipped", False):
        return spark
    archive = os.path.join(tempfile.mkdtemp(prefix="panelforge-"), "panelforge.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(archive)
    sc._panelforge_shipped = True
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, local mode (tests) uses a temporary folder of this machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='panelforge-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    The stage's own tasks write; adaptive execution joins partitions that a shuffle left small.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing that is still to be computed reads it."""
    paths = {f.rpartition("/")[0] for f in df.inputFiles()}
    sc = df.sparkSession.sparkContext
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives a Python worker's freed memory back: workers live on after a task and share their executor's limit."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, or None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None
