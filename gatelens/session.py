"""Session helpers: a tuned local session for tests and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gatelens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides.  Only a local session, as in tests, may
    leave it unset and gets a temporary folder; on a cluster that is an error,
    because each executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = os.environ.get("GATELENS_TEST_DIR") or tempfile.mkdtemp(prefix="gatelens-")
    return _FALLBACK[app]


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder under the shared one."""
    return f"{shared_dir(spark)}/gatelens/{purpose}-{uuid.uuid4().hex}"


def work_table(df, purpose: str):
    """The same rows, read from a table written once under the shared folder.

    For rows that are dear to compute and used several times; what follows is cut
    off from their lineage and survives lost executors.
    """
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
