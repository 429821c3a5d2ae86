"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_MARKED: set[str] = set()


def build_session(app: str = "barloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benches; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BARLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local session (tests, laptops) gets a
    temporary folder, recorded so that later calls agree on it.  On a cluster
    that is an error: each executor would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def work_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables; the file system deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/barloom-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _MARKED.add(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of shuffle tasks: that of the session, or as many as get about ``per_task`` of ``rows`` rows each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
