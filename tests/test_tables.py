"""Boundaries, validation, merges and gates on hand-made rows."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import costs as K
from barloom.operators import risk as Q
from barloom.operators import signals
from barloom.operators import tables as B
from barloom.operators import upsert as U

D = dt.date(2023, 8, 25)


def test_trade_rules_collect_reasons(spark):
    df = spark.createDataFrame(
        [("2024-01-02", "SH600519", "BUY", 10.0, 100), ("2024-13-02", "60051", "HOLD", -1.0, 0), (None, "600519", "SELL", 1.0, 1)],
        "date string, sym string, action string, price double, shares int")
    good, bad = B.split_valid(df, B.trade_rules())
    assert good.count() == 1
    reasons = sorted(map(tuple, (sorted(r.errors) for r in bad.collect())))
    assert reasons == [("bad_action", "bad_date", "bad_price", "bad_shares", "bad_symbol"), ("missing_date",)]


def test_costs(spark):
    df = spark.createDataFrame([("SELL", 10.0, 1000, "600519.SH", D), ("SELL", 10.0, 1000, "SZ000001", D + dt.timedelta(days=3)), ("BUY", 1.0, 100, "900901", D)],
                               "action string, price double, shares int, sym string, date date")
    a, b, c = K.with_costs(df, filled=F.col("price")).collect()
    assert a.stamp_duty == pytest.approx(10.0) and b.stamp_duty == pytest.approx(5.0) and c.stamp_duty == 0
    assert a.transfer_fee == pytest.approx(0.1) and b.transfer_fee == 0 and c.transfer_fee == pytest.approx(0.001)
    assert c.commission == 5.0 and c.net_amount == pytest.approx(-(100 + 5 + 0.001))
    with pytest.raises(PySparkException):
        df.select(K.fixed_slippage(F.lit(0.0), F.col("action"))).collect()


def test_upsert_directions(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "code string, date int, close double")
    new = spark.createDataFrame([("b", 1, 9.0), ("c", 1, None)], "code string, date int, close double")
    keys = ["code", "date"]
    assert {(r.code, r.close) for r in U.upsert(old, new, keys, order=["close"]).collect()} == {("a", 1.0), ("b", 9.0), ("c", None)}
    assert [r.code for r in U.append_new(old, new, keys, order=["close"]).collect()] == ["c"]
    prot = spark.createDataFrame([("b",)], "code string")
    assert {(r.code, r.close) for r in U.upsert_protected(old, new, keys, prot, order=["close"]).collect()} == {("a", 1.0), ("b", 2.0)}


def nav(spark, values):
    return spark.createDataFrame([(D + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "date date, nav double")


def test_gates_at_their_thresholds(spark):
    at = Q.drawdown_gate(nav(spark, [100.0] * 30 + [85.0])).first()
    assert (at.ok, at.reason) == (False, "drawdown")
    assert Q.drawdown_gate(nav(spark, [100.0] * 10 + [10.0])).first().reason == "insufficient_history"
    assert Q.daily_loss_gate(nav(spark, [100.0, 95.0])).first().ok is False
    w = spark.createDataFrame([("a", 0.2), ("b", 0.1)], "sym string, weight double")
    assert Q.position_weight_gate(w).first().ok is True
    assert Q.self_check(nav(spark, [1.0])).first().verdict == "insufficient"


def test_alert_priority(spark):
    rows = [(-0.35, 0.0, 1.0, -0.1, 0, "black"), (-0.35, 0.0, 1.0, 1.0, 0, "red"), (0.0, 0.0, 0.2, 1.0, 3, "red"), (-0.25, 0.0, 1.0, 1.0, 0, "orange"),
            (0.0, -0.06, 1.0, 1.0, 0, "yellow"), (None, None, None, None, 0, "green")]
    df = spark.createDataFrame(rows, "cum_60 double, rel_60 double, sharpe_3m double, sharpe_6m double, neg_run int, want string")
    assert df.where(Q.alert_level() != F.col("want")).count() == 0


def test_completeness_boundaries(spark):
    codes = lambda n: spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("code"))
    verdict = lambda have: Q.completeness(codes(have), codes(100), codes(100), codes(10)).first().verdict
    assert [verdict(n) for n in (95, 94, 79)] == ["OK", "WARNING", "CRITICAL"]


def test_scalars(spark):
    df = spark.createDataFrame([("SH600519", "*S T abc"), ("bj430047", "good"), ("000001", None)], "s string, n string")
    got = [tuple(r) for r in df.select(S.strip_prefix(F.col("s")), S.is_special_treatment(F.col("n"))).collect()]
    assert got == [("600519", True), ("430047", False), ("000001", True)]
    kinds = spark.createDataFrame([("首发原股东限售股份",), ("定增",), (None,), ("x",)], "z string").select(S.unlock_type(F.col("z")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["ipo", "spo", "other", "other"]


def test_argument_check(spark):
    with pytest.raises(ValueError):
        signals.sma_cross(spark.range(1), 30, 10)
