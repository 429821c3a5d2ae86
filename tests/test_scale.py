"""Ranges, borders and merges that must not depend on size, key type or the place of files."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.sources import sinks
from barloom.operators import factors as A
from barloom.operators import ranking as R
from barloom.operators import upsert as U
from barloom.sources import readers


@pytest.fixture(autouse=True)
def ranges(monkeypatch):
    """Cut even these small groups into ranges; the queries' tests rank them as a whole."""
    monkeypatch.setattr(R, "WHOLE", 0)


def test_position_with_prefixed_codes(spark):
    rng = random.Random(1)
    rows = [(dt.date(2020, 1, 1), rng.choice([1.0, 2.0, 2.0, 2.0]), f"SH60{i:04d}") for i in rng.sample(range(3000), 600)]
    rows += [(dt.date(2020, 1, 2), 1.0, c) for c in ("SZ000001", "SH600519", "a", "", "日本", "SH600000")]
    df = spark.createDataFrame(rows, "date date, v double, code string")
    got = {(r.date, r.code): r.p for r in R.position(df, ["date"], "v", "code", "p").collect()}
    for d in {r[0] for r in rows}:
        order = sorted((v, c.encode(), c) for x, v, c in rows if x == d)
        assert [got[d, c] for _, _, c in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_global_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 2)
    df = spark.createDataFrame([(float(v), None if i % 5 == 4 else float(i % 3)) for i, v in enumerate(x)], "x double, y double")
    y = np.array([i % 3 for i in range(n) if i % 5 != 4], float)
    probs = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]
    got = R.global_quantiles(df, {f"{c}{i}": (c, p) for c in "xy" for i, p in enumerate(probs)}).first()
    for i, p in enumerate(probs):
        assert got[f"x{i}"] == pytest.approx(np.quantile(x, p)) and got[f"y{i}"] == pytest.approx(np.quantile(y, p))


@pytest.mark.parametrize("kind", ["distinct", "tied", "two values", "tiny"])
def test_global_quantiles_narrow_large_brackets(spark, kind):
    """Brackets of more rows than the limit are cut again; no window sees more than the limit."""
    rng = np.random.default_rng(8)
    x = {"distinct": rng.normal(size=60_000), "tied": np.where(rng.random(60_000) < 0.6, 0.25, rng.normal(size=60_000)),
         "two values": np.where(np.arange(60_000) < 30_000, 1.0, 2.0), "tiny": 1 + rng.random(60_000) * 1e-300}[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.003, 0.25, 0.5, 0.9, 1.0]
    got = R.global_quantiles(df, {f"q{i}": ("x", p) for i, p in enumerate(probs)}, limit=10)
    for i, p in enumerate(probs):
        assert got.first()[f"q{i}"] == np.quantile(x, p)
    if kind == "distinct":
        seen = []
        original = R._brackets
        R._brackets = lambda d, around: seen.append(set(around)) or original(d, around)
        try:
            R.global_quantiles(df, {"q": ("x", 0.4)}, limit=10)
        finally:
            R._brackets = original
        assert len(seen) > 1


def test_clipping_many_columns_is_one_flat_plan(spark):
    df = spark.range(500).select(*[(F.rand(i) * i).alias(f"c{i}") for i in range(1, 7)])
    cols = df.columns
    start = dt.datetime.now()
    A.clip_quantiles(df, cols)._jdf.queryExecution().executedPlan()
    assert (dt.datetime.now() - start).total_seconds() < 15


def test_composite_keys_are_not_broadcast_by_force(spark):
    df = spark.range(1000).select(F.expr("date_add(date'2020-01-01', cast(id % 500 as int))").alias("date"), (F.col("id") % 7).cast("string").alias("factor"), F.rand(1).alias("v"))
    hinted = R.place(df, ["date", "factor"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in hinted
    assert "strategy=broadcast" in R.place(df, ["date"], ["v"])._jdf.queryExecution().optimizedPlan().toString()


def test_top_k_refuses_what_spark_cannot_cut(spark):
    df = spark.range(5).select(F.lit(1).alias("d"), "id")
    assert R.top_k(df, ["d"], [F.asc("id")], 3).count() == 3
    with pytest.raises(ValueError):
        R.top_k(df, ["d"], [F.asc("id")], 100_000)


def test_merges_need_an_order_and_keep_the_last(spark):
    old = spark.createDataFrame([("a", 1, 1.0)], "code string, rev int, close double")
    new = spark.createDataFrame([("a", 2, 5.0), ("a", 4, 7.0), ("a", 3, 6.0)], "code string, rev int, close double")
    assert U.upsert(old, new, ["code"], order=["rev"]).collect() == [("a", 4, 7.0)]
    with pytest.raises(TypeError):
        U.upsert(old, new, ["code"])
    assert U.keep_largest([old.withColumn("close", F.lit(9.0)), new.withColumn("close", F.lit(9.0))], ["code"]).collect() == [("a", 4, 9.0)]


def test_absent_tables_are_skipped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    spark.range(2).withColumn("x", F.lit(1.0)).write.parquet(f"{tmp_path}/b")
    got = readers.many(spark, [f"{tmp_path}/a", f"{tmp_path}/none", f"{tmp_path}/b"], "id bigint, x double")
    assert got.count() == 5 and got.where("x is null").count() == 3
    assert readers.many(spark, [], "id bigint").count() == 0 and readers.many(spark, [f"{tmp_path}/none"], "id bigint").columns == ["id"]


class _Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_no_local_fallback_on_a_cluster():
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(_Elsewhere)


def test_work_folder_is_one_per_application(spark):
    assert session.work_dir(spark) == session.work_dir(spark) and spark.sparkContext.applicationId in session.work_dir(spark)


def test_pools_grow_with_the_suppliers(spark):
    from barloom.plans.registry import Tables

    pools = {sf: Tables(spark, f"/root/testdata/sf{sf}").bars_s.select("code").distinct().count() for sf in ("0.001", "0.01", "0.1")}
    assert pools["0.001"] < pools["0.01"] < pools["0.1"] and pools["0.1"] >= 9 * pools["0.01"]


def test_a_hot_partition_key_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"), "id")
    sinks.write_partitioned(df, f"{tmp_path}/t", ["key"], rows=1000, sort=["id"])
    back = spark.read.parquet(f"{tmp_path}/t")
    files = back.groupBy(F.input_file_name().alias("f"), "key").count().collect()
    assert back.count() == 20_000 and back.where("key is null").count() == 1000
    assert max(r["count"] for r in files) < 4200 and sum(r.key == "hot" for r in files) >= 8  # a task may get a few of the hot key's eighteen parts
    assert sum(r.key == "k3" for r in files) == 1
