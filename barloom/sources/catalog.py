"""Named views over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def setup_views(spark: SparkSession, specs: dict[str, tuple[str, str]]) -> list[str]:
    """Create or replace a view per (name -> (format, path)); absent paths are skipped."""
    made = []
    for name, (fmt, path) in specs.items():
        try:
            reader = spark.read.format(fmt)
            if fmt == "csv":
                reader = reader.option("header", True).option("inferSchema", True)
            df = reader.load(path)
        except Exception as exc:  # a missing table leaves the other views usable
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            continue
        df.createOrReplaceTempView(name)
        made.append(name)
    return made


def list_views(spark: SparkSession, names: list[str]) -> DataFrame:
    """view, n_rows, n_cols of each listed view; all counts run in one job."""
    parts = []
    for n in names:
        df = spark.table(n)
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("view"), "n_rows", F.lit(len(df.columns)).alias("n_cols")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
