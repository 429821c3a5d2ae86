"""Writers and table layouts.

A rewrite goes to a new directory of the shared folder; readers switch to it
when the job has committed.  Nothing overwrites a path that is being read.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import uuid
from collections.abc import Iterator, Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import add_prefix
from barloom.operators.tables import split_valid, trade_rules
from barloom.session import settings, work_dir
from barloom.sources.readers import GROUP, group_of

#: Spark deletes an execution's shuffle files when it ends; a published table needs them no more.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHUFFLE = "spark.sql.shuffle.partitions"


#: Most tasks of a write whose tasks get fewer than TASK_ROWS rows each.
MOST_TASKS, TASK_ROWS = 2000, 2_000_000


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def publish(df: DataFrame, name: str, *, tasks: int | None = None) -> DataFrame:
    """Write to a fresh directory and return the table read back (cuts the lineage).

    ``tasks`` is the number of shuffle tasks of this write, if not the session's.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {CLEAN: "true"} | ({SHUFFLE: tasks} if tasks else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``publish`` wrote, when all that was read from it is published too."""
    files, spark = df.inputFiles(), df.sparkSession
    if files and spark.sparkContext.applicationId in files[0]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def replace_slices(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``; running it twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], *, rows: int = 2_000_000, sort: Sequence[str] = ()) -> None:
    """Hive partitions.  Keys are counted first; one of n rows is cut into about n / ``rows`` parts.

    Parts are dealt over tasks; there are more than ``MOST_TASKS`` only for more
    than that many times ``TASK_ROWS`` rows, as every task reports to the driver.
    ``df`` is computed twice, for the counts and for the rows; write a costly one first.
    """
    sizes = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n")).withColumn("_splits", F.ceil(F.col("_n") / rows))
    large = sizes.where("_splits > 1")  # small keys need no row here
    parts, n = large.agg(F.coalesce(F.sum("_splits"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if parts:
        on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        salt = F.when(F.col("_splits").isNotNull(), F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_splits"))).otherwise(0)
        # twice as many tasks as parts, as parts are dealt by hash; a number that is named is not coalesced
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + min(2 * parts, max(MOST_TASKS, -(-n // TASK_ROWS)))
        out = df.join(large, on, "left").repartition(tasks, *keys, salt).select(df.columns)
    else:
        out = df.repartition(*keys)
    if sort:
        out = out.sortWithinPartitions(*keys, *sort)
    out.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_grouped(df: DataFrame, path: str, key: str = "code", *, sort: Sequence[str] = ("date",)) -> None:
    """Hive partitions of hashed groups of keys (``readers.group_of``), (key, sort) order inside.

    The directories do not grow in number with the keys; ``readers.symbol`` reads
    one of them, and in it the row groups of its key.
    """
    write_partitioned(df.withColumn(GROUP, group_of(F.col(key))), path, [GROUP], sort=[key, *sort])


def write_by_year(df: DataFrame, path: str, date: str = "date", key: str = "code") -> None:
    """Year directories, (code, date) order inside files: date filters skip files and row groups.

    Ranges over (year, code, date) split a year by its symbols over as many
    tasks as the shuffle has, whatever its share of the rows.
    """
    out = df.withColumn("year", F.year(date))
    out.repartitionByRange("year", key, date).sortWithinPartitions("year", key, date).write.mode("overwrite").partitionBy("year").parquet(path)


def verify_rewrite(source: DataFrame, copy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: counts on both sides and rows of either side missing from the other.

    Rows are compared as multisets by counting both sides per full row.
    """
    cols = source.columns
    a = source.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = copy.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    g = a.unionByName(b).groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    out = g.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("n_source"), F.coalesce(F.sum("_b"), F.lit(0)).alias("n_copy"),
        F.coalesce(F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))), F.lit(0)).alias("n_extra"))
    return out.withColumn("ok", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows stamped with the time of writing."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def append_trades(trades: DataFrame, path: str, rejects: str | None = None) -> None:
    """Append valid trades with an id and recording time; invalid ones go to ``rejects`` with reasons."""
    good, bad = split_valid(trades, trade_rules())
    stamped = good.withColumns({
        "id": F.coalesce(F.col("id"), F.uuid()) if "id" in good.columns else F.uuid(),
        "recorded_at": F.coalesce(F.col("recorded_at"), F.current_timestamp()) if "recorded_at" in good.columns else F.current_timestamp()})
    stamped.write.mode("append").json(path)
    if rejects:
        bad.write.mode("append").json(rejects)


def export_csv(bars: DataFrame, path: str, *, min_rows: int = 60, sh: str = "^[69]", bj: str = "^[84]") -> None:
    """One CSV directory per prefixed symbol with ``factor`` 1.0; empty or short symbols are left out."""
    write_csv_per_key(exportable(bars, min_rows=min_rows, sh=sh, bj=bj), path, "symbol", sort=["date"])


def write_csv_per_key(df: DataFrame, path: str, key: str, *, sort: Sequence[str] = ()) -> None:
    """A directory ``key=value`` with one CSV file for each key, laid out as ``partitionBy(key).csv`` does it.

    On a mounted file system the tasks write the lines themselves: to set its
    access rights, Hadoop's client starts processes for every file there.
    All files lie in a folder beside ``path``, which takes its name at the end.
    """
    spark = df.sparkSession
    keyed = df.withColumn(key, F.nullif(F.col(key).cast("string"), F.lit("")))  # both are one partition
    rows = keyed.repartition(int(spark.conf.get(SHUFFLE)), key).sortWithinPartitions(key, *sort)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        rows.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)
        return
    columns = [c for c in df.columns if c != key]
    fresh = folder.suffix(f"-{uuid.uuid4().hex}")
    files.mkdirs(fresh)
    try:
        lines = rows.select(key, F.to_csv(F.struct(*columns)))
        lines.foreachPartition(_file_per_key(fresh.toUri().getPath(), key, ",".join(columns)))
        files.create(fresh.suffix("/_SUCCESS")).close()
        files.delete(folder, True)
        if not files.rename(fresh, folder):
            raise OSError(f"cannot rename to {path}")
    except BaseException:
        files.delete(fresh, True)
        raise


def _file_per_key(root: str, key: str, head: str):
    """Writer of a partition of (key, line) that is sorted by key; a file is there as a whole or not at all."""

    def write(rows: Iterator[Row]) -> None:
        for value, lines in itertools.groupby(rows, key=lambda r: r[0]):
            # characters that Spark escapes in names of partitions
            name = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", value or "__HIVE_DEFAULT_PARTITION__")
            folder = f"{root}/{key}={name}"
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/.{TaskContext.get().taskAttemptId()}"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(f"{head}\n")
                f.writelines(f"{line}\n" for _, line in lines)
            os.replace(part, f"{folder}/part-00000.csv")

    return write


def exportable(bars: DataFrame, *, min_rows: int = 60, sh: str = "^[69]", bj: str = "^[84]") -> DataFrame:


    keep = bars.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("c")).where((F.col("n") >= min_rows) & (F.col("c") > 0))
    kept = bars.join(keep.select("code"), "code", "left_semi")
    return kept.withColumns({"symbol": add_prefix(F.col("code"), sh=sh, bj=bj), "factor": F.lit(1.0)})
