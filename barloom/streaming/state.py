"""State of streams: the store that typed state needs, and tables with a version per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a stream on the store that keeps typed state; a stream takes over the session's settings as it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    folder, files = _folder(spark, path)
    files.create(folder, True).close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers of the complete versions of a table."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def write_version(df: DataFrame, path: str, batch: int, keep: int = 2) -> None:
    """Write a whole version; written again for the same batch it replaces itself.  Older ones but for ``keep`` go."""
    df.write.mode("overwrite").parquet(f"{path}/version={batch}")
    spark = df.sparkSession
    for old in [v for v in versions(spark, path) if v < batch][:-keep]:
        folder, files = _folder(spark, f"{path}/version={old}")
        files.delete(folder, True)


def read_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Newest version (older than batch ``before``); none if there is none."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None
