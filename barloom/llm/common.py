"""Helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.sinks import publish

SPACE = "\x20\x09-\x0d"  # ASCII white space, as in the contracts' word pattern
WORD = re.compile(f"[^{SPACE}]+")
_ASCII_SPACES = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


#: Bytes of an Arrow batch, and the setting that bounds it; texts are long, so Spark's 10,000 rows may be far more.
BATCH_BYTES, BATCH_LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session; a lower bound stays.

    A batch is held several times, outside the executor's heap, where it grows
    by doubling, and in its Python workers, whatever the size of the input.
    """
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_LIMIT))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str) -> list[str]:
    """Runs of anything but ASCII white space (``str.split()`` alone also splits at other Unicode spaces)."""
    return [w for w in text.translate(_ASCII_SPACES).split(" ") if w]


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % n


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what a Python worker makes of one is held at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def input_tasks(df: DataFrame, per_task: int, rows: int) -> int:
    """Number of shuffle tasks so that each gets about ``per_task`` of ``rows`` rows."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-rows // per_task))


def keep_rows(docs: DataFrame, decided: DataFrame, id: str, text: str) -> DataFrame:
    """Rows of ``docs`` that ``decided`` (id, text_hash, kept) keeps, unchanged.

    Rows are found again by id and text.  Of rows equal in both, of which some
    are kept and some dropped, one is kept.
    """
    per = publish(decided.groupBy(F.col(id).alias("_k"), F.col("text_hash").alias("_h")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("kept").cast("int")).alias("_kept")).where("_kept < _n"), "dropped")
    same = F.col(id).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_h"))
    stay = docs.join(per, same, "left_anti")
    some = per.where("_kept > 0")
    if some.isEmpty():
        return stay
    return stay.unionByName(docs.join(some, same, "left_semi").dropDuplicates([id, text]))
