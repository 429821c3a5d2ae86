"""Physical plans: shuffles, pushdown and the joins that must not appear."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.plans.registry import Tables
from tests.conftest import SMALL

LAZY = [n for n in entry.queries() if not n.startswith(("model_", "stream_", "sink_", "scan_"))]


@pytest.fixture(autouse=True)
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products(spark, name):
    p = plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_windows_share_one_exchange(spark):
    p = plan(entry.queries()["factor_obv_slope"](spark, SMALL))
    assert len(re.findall("Exchange hashpartitioning", p)) == 2  # bars, then symbols


def test_bars_combine_before_the_shuffle(spark):
    p = plan(Tables(spark, SMALL).bars_m)
    assert "partial_min_by" in p and "SortAggregate" not in p


def test_top_k_cuts_before_the_shuffle(spark):
    p = plan(entry.queries()["top_per_date"](spark, SMALL))
    assert p.count("WindowGroupLimit") == 2
    assert "min_by" not in p  # unused bar columns are pruned


def test_scan_is_narrow(spark):
    p = plan(entry.queries()["scan_projected"](spark, SMALL))
    assert "GreaterThanOrEqual(l_shipdate" in p
    read = re.search(r"ReadSchema: struct<([^>]*)", p).group(1)
    assert "l_tax" not in read and "l_returnflag" not in read


def test_rank_correlation_scans_once(spark):
    p = plan(entry.queries()["ic_spearman_ties"](spark, SMALL))
    assert p.count("FileScan") == 1 and "ReusedExchange" in p


def test_increment_does_not_shuffle_the_stored_table(spark):
    from barloom.operators.upsert import upsert

    old = spark.read.parquet(f"{SMALL}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    p = plan(upsert(old, old.limit(5), ["k"], order=["o_totalprice"]))
    assert "BroadcastHashJoin" in p and "LeftAnti" in p
