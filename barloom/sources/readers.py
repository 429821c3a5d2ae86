"""Readers: explicit schemas, NaN to null, malformed rows skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import strip_prefix
from barloom.operators.tables import long_enough
from barloom.session import settings

BAR_SCHEMA = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")], T.StructField("volume", T.LongType()),
])
TRADE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("date", T.StringType()), T.StructField("sym", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("action", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("shares", T.LongType()), T.StructField("note", T.StringType()), T.StructField("recorded_at", T.TimestampType()),
])
VOTE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("agent", "sym", "vote")] + [T.StructField("ts", T.TimestampType())])
RULE_SCHEMA = "failure_modes array<struct<id:string,description:string,logic:string,severity:string,rules:array<struct<key:string,op:string,threshold:double>>>>"


#: Partition column of tables with many keys, and its number of values.
GROUP, GROUPS = "key_group", 256
#: Most tasks that list the directories of a table.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def group_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities never enter: null is the only missing value."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in cols})


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """Projected, filtered scan; both reach the file reader.  Hive partitions are discovered."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return nan_to_null(df.select(*columns) if columns else df)


def market_csv(spark: SparkSession, path: str, *, schema: T.StructType = BAR_SCHEMA, min_bars: int = 90, infer: bool = False) -> DataFrame:
    """Long multi-symbol CSV: required columns checked, exchange prefix dropped, short symbols dropped."""
    reader = spark.read.option("header", True)
    df = reader.option("inferSchema", True).csv(path) if infer else reader.option("enforceSchema", False).schema(schema).csv(path)
    missing = [c for c in ("code", "date", "open", "high", "low", "close", "volume") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return long_enough(nan_to_null(df.withColumn("code", strip_prefix(F.col("code").cast("string")))), min_bars)


def csv_per_key(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Table of ``sinks.write_csv_per_key``; four tasks a core list its directories, as one task for each costs more than the listing."""
    with settings(spark, {LISTING: 4 * spark.sparkContext.defaultParallelism}):
        return spark.read.option("header", True).schema(schema).csv(path)


def symbol(df: DataFrame, code: str) -> DataFrame:
    """One symbol; on a table partitioned by code, or by groups of codes, only its partition is read."""
    if GROUP in df.columns:
        df = df.where(F.col(GROUP) == group_of(F.lit(code)))
    return df.where(F.col("code") == code).orderBy("date")


def symbols(df: DataFrame) -> DataFrame:
    return df.select("code").distinct().orderBy("code")


def trade_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines trades in recording order; malformed lines are skipped."""
    return spark.read.schema(TRADE_SCHEMA).option("mode", "DROPMALFORMED").json(path).orderBy("recorded_at")


def vote_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOTE_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def many(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Several tables with differing columns as one read; absent columns are null, absent tables are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            there.append(p)
    if not there:
        return spark.createDataFrame([], schema)
    return nan_to_null(spark.read.schema(schema).parquet(*there))


def newest_report(reports: DataFrame, keys: Sequence[str] = ("code", "data_date"), order: str = "announce_date") -> DataFrame:
    """A revised report replaces the earlier announcement of the same period."""
    rest = [c for c in reports.columns if c not in keys]
    g = reports.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return g.select(*keys, "_r.*")


def instruments(spark: SparkSession, path: str, exclude: str = "^(688|[48])") -> DataFrame:
    """Tab-separated instrument list: code without prefix, excluded boards dropped."""
    df = spark.read.schema("instrument string, start string, end string").option("sep", "\t").csv(path)
    return df.select(strip_prefix(F.col("instrument")).alias("code"), F.col("start").try_cast("date").alias("start"), F.col("end").try_cast("date").alias("end")).where(~F.col("code").rlike(exclude))


def rule_file(spark: SparkSession, path: str) -> DataFrame:
    """Failure modes with their rules, one row per mode."""
    doc = spark.read.schema(RULE_SCHEMA).option("multiLine", True).json(path)
    return doc.select(F.explode("failure_modes").alias("m")).select(
        "m.id", "m.description", F.coalesce("m.logic", F.lit("all")).alias("logic"), F.coalesce("m.severity", F.lit("reject")).alias("severity"), "m.rules")


def nested_json(spark: SparkSession, path: str, schema: str, explode: str) -> DataFrame:
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.explode(explode).alias("_x")).select("_x.*")
