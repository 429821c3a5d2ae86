"""Incremental bars: ingest with duplicate suppression, live views, daily merges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barloom.functions.frames import div
from barloom.operators.ranking import top_k
from barloom.operators.upsert import append_new, upsert
from barloom.sources.sinks import publish, replace_slices
from barloom.streaming.state import exists, mark, read_version, start, write_version

MINUTE_BARS = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("datetime", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
    T.StructField("volume", T.LongType()), T.StructField("amount", T.DoubleType()),
])


def bar_stream(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = MINUTE_BARS, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def dedup(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """First arrival of a (code, datetime) wins; state is dropped behind the watermark."""
    return stream.withWatermark("datetime", delay).dropDuplicatesWithinWatermark(["code", "datetime"])


def ingest(stream: DataFrame, path: str, checkpoint: str, delay: str = "2 hours") -> StreamingQuery:
    """Append deduplicated bars, partitioned by day (not by symbol)."""
    out = dedup(stream, delay).withColumn("day", F.to_date("datetime"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(availableNow=True).start()


def ingest_against_history(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append bars whose key is not in the whole stored history (the stored bar wins).

    A batch is written to its own directory, so a repeated batch replaces
    itself, and by day inside it.  The schema is given and the day is a
    partition, so a batch opens the files of its own days only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("day", F.to_date("datetime")).persist()
        try:
            span = batch.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
            if span["a"] is None:
                return
            fresh = append_new(stored_days(spark, path, batch, batch_id, span["a"], span["b"]), batch, ["code", "datetime"], order=[c for c in batch.columns if c not in ("code", "datetime")])
            fresh.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_days(spark: SparkSession, path: str, like: DataFrame, batch_id: int, first: object, last: object) -> DataFrame:
    """Stored bars of other batches between two days; none where nothing is stored yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return like.limit(0)
    rows = [f for f in like.schema.fields if f.name != "day"]
    schema = T.StructType([*rows, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])
    stored = spark.read.schema(schema).parquet(path)
    return stored.where((F.col("batch") != batch_id) & F.col("day").between(F.lit(first), F.lit(last))).select(like.columns)


def live_view(bars: DataFrame, n: int = 24) -> DataFrame:
    """Latest bar, last-n closes in time order and last return per symbol."""
    last = top_k(bars, ["code"], [F.desc("datetime")], n, "_k")
    g = last.groupBy("code").agg(
        F.max("datetime").alias("datetime"), F.max_by("close", "datetime").alias("close"),
        F.max(F.when(F.col("_k") == 2, F.col("close"))).alias("_prev"),
        F.transform(F.array_sort(F.collect_list(F.struct("datetime", "close"))), lambda s: s["close"]).alias("spark"))
    return g.withColumn("ret", div("close", "_prev") - 1.0).drop("_prev")


VIEW = "code string, at bigint, close double, spark array<double>, ret double"


class LastBars(StatefulProcessor):
    """The last n bars of a symbol; a bar that comes again replaces the kept one."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("bars", "at bigint, close double, rest string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        kept = {t: (False, rest, close) for t, close, rest in self.state.get()}
        oldest = min(kept, default=None)
        for r in rows:  # never more than 2 n bars at once
            if oldest is not None and r.at < oldest and len(kept) >= self.n:
                continue
            new = (True, r.rest, r.close)
            if r.at not in kept or new > kept[r.at]:
                kept[r.at] = new
            if len(kept) > 2 * self.n:
                kept = dict(sorted(kept.items())[-self.n:])
                oldest = min(kept)
        last = sorted(kept.items())[-self.n:]
        self.state.put([(t, close, rest) for t, (_, rest, close) in last])
        closes = [close for _, (_, _, close) in last]
        ret = closes[-1] / closes[-2] - 1.0 if len(closes) > 1 and closes[-2] and None not in closes[-2:] else None
        yield Row(code=key[0], at=last[-1][0], close=closes[-1], spark=closes, ret=ret)


def live_view_stream(stream: DataFrame, path: str, checkpoint: str, n: int = 24) -> StreamingQuery:
    """Keep ``live_view`` of every symbol while bars arrive, as versions of a table at ``path`` (``read_version``).

    The last n bars of a symbol lie in the state store and thus in the
    checkpoint; a batch changes the rows of its own symbols.  Of bars with one
    key in a batch the greatest one by its other columns stays.
    """
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stream.columns if c not in ("code", "datetime")]
    narrow = stream.where("code is not null and datetime is not null").select(
        "code", F.unix_micros(F.col("datetime").cast("timestamp")).alias("at"), F.col("close").cast("double").alias("close"), F.concat_ws("|", *rest).alias("rest"))
    view = narrow.groupBy("code").transformWithState(LastBars(n), VIEW, "Update", "None").select("code", F.timestamp_micros("at").alias("datetime"), "close", "spark", "ret")

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_version(spark, path, batch_id)
        batch = batch.persist()
        try:
            rows = batch if before is None else before.join(batch.select("code"), "code", "left_anti").unionByName(batch)
            write_version(rows, path, batch_id)
        finally:
            batch.unpersist()

    return start(view.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True), stream.sparkSession)


LISTED = 400  # days named one by one in a filter


def touched(stored: DataFrame, batch: DataFrame, partition: str) -> DataFrame:
    """Stored rows of the partitions that a batch has rows for, chosen when the scan is planned.

    A batch of up to ``LISTED`` days names them; one of more gives their range
    (and leaves the days between to a semi join).
    """
    days = [r[0] for r in batch.select(partition).distinct().limit(LISTED + 1).collect()]
    if len(days) <= LISTED:
        return stored.where(F.col(partition).isin(days)) if days else stored.limit(0)
    first, last = batch.agg(F.min(partition), F.max(partition)).first()
    return stored.where(F.col(partition).between(F.lit(first), F.lit(last))).join(batch.select(partition).distinct(), partition, "left_semi").select(stored.columns)


def daily_merge(stream: DataFrame, path: str, checkpoint: str, *, order: Sequence[str], keys: tuple[str, ...] = ("code", "date"), partition: str = "date") -> StreamingQuery:
    """Merge arriving rows into the table at ``path``, partitioned by date; the new row wins.

    Only the partitions that a batch touches are read and replaced, through a
    written copy of their new content.  A merged batch is noted beside the
    checkpoint by its number and not merged again; one that was cut off before
    its note is, which gives the same rows.
    """
    log = f"{checkpoint}-merged"

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{log}/{batch_id}"):
            return
        batch = batch.where(F.col(partition).isNotNull()).persist()
        try:
            near = touched(spark.read.schema(batch.schema).parquet(path), batch, partition).select(batch.columns)
            replace_slices(publish(upsert(near, batch, list(keys), order=order), "merged-days"), path, partition)
        finally:
            batch.unpersist()
        mark(spark, f"{log}/{batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
