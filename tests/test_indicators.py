"""Windows and recursions against pandas on a panel with nulls, ties, flat bars and short symbols."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import formula as X
from barloom.operators import indicators as I
from barloom.operators import recur as R
from barloom.operators import signals as S


def panel(seed=3):
    rng = np.random.default_rng(seed)
    frames = []
    for code, n in (("000001", 120), ("000002", 75), ("000003", 6), ("600000", 40)):
        close = 100 + np.cumsum(rng.normal(0, 1, n)).round(2)
        high, low = close + rng.uniform(0, 1, n), close - rng.uniform(0, 1, n)
        if code == "600000":
            high[10:25] = low[10:25] = close[10:25] = 50.0  # zero-range bars and ties
        frames.append(pd.DataFrame({
            "code": code, "date": pd.bdate_range("2020-01-01", periods=n).date, "open": close - 0.1, "high": high, "low": low, "close": close,
            "volume": rng.integers(100, 1000, n)}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(panel()).persist()


def per_code(fn):
    p = panel()
    return pd.concat([fn(g) for _, g in p.groupby("code", sort=True)]).to_numpy(float)


def column(df, name):
    return df.orderBy("code", "date").select(name).toPandas()[name].to_numpy(float)


def same(a, b):
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_macd(bars):
    want = per_code(lambda g: (lambda d: 2 * (d - d.ewm(span=9, adjust=False).mean()))(g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()))
    same(column(I.macd(bars), "hist"), want)


def test_kdj_gap(bars):
    def k(g):
        lo, hi = g.low.rolling(9).min(), g.high.rolling(9).max()
        return ((g.close - lo) / (hi - lo).replace(0, np.nan) * 100).ewm(alpha=1 / 3, adjust=False).mean()

    same(column(I.kdj(bars), "k"), per_code(k))


def test_null_inside_recursion(spark):
    x = [1.0, None, None, 4.0, 2.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", i, None) for i in range(3)], "code string, date int, x double")
    got = column(R.recur(df, [R.Ewm("y", "x", 0.3)]), "y")
    same(got, list(pd.Series(x).ewm(alpha=0.3, adjust=False).mean()) + [np.nan] * 3)
    held = column(R.recur(df, [R.Ewm("y", "x", 0.3, skip_null=True)]), "y")[:6]
    same(held, pd.Series(x).ewm(alpha=0.3, adjust=False, ignore_na=True).mean())


def test_symbols_across_batches(spark):
    rows = [(f"{c:03d}", i, float((c * 7 + i) % 13)) for c in range(9) for i in range(50 + c)]
    df = spark.createDataFrame(rows, "code string, date int, x double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = column(R.recur(df, [R.ema("y", "x", 5)]), "y")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = pd.DataFrame(rows, columns=["c", "i", "x"]).groupby("c").x.apply(lambda s: s.ewm(span=5, adjust=False).mean())
    same(got, want)


def test_rsi_edges(spark):
    up = [("u", i, 100.0 + i) for i in range(30)]
    flat = [("f", i, 100.0) for i in range(30)]
    df = spark.createDataFrame(up + flat, "code string, date int, close double")
    last = {r.code: r.rsi for r in I.rsi(df).where("date = 29").collect()}
    assert last == {"u": 100.0, "f": 50.0}


def test_wma_and_min_periods(bars):
    w = lambda a: np.dot(a, np.arange(1, len(a) + 1)) / np.arange(1, len(a) + 1).sum()
    same(column(bars.withColumn("y", X.WMA("close", 6)), "y"), per_code(lambda g: g.close.rolling(6, min_periods=1).apply(w, raw=True)))
    same(column(bars.withColumn("y", X.STD("close", 4)), "y"), per_code(lambda g: g.close.rolling(4, min_periods=2).std()))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000])
def test_dynamic_average_of_long_series_with_nulls(n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.2, np.nan, rng.normal(100, 5, n))
    a = np.where(rng.random(n) < 0.1, np.nan, rng.uniform(-0.2, 1.2, n))
    ids = np.sort(rng.integers(0, 3, n))
    want, y, owner = [], np.nan, None
    for i in range(n):
        if ids[i] != owner:
            y, owner = np.nan, ids[i]
        w = 0.5 if np.isnan(a[i]) else min(max(a[i], 0.0), 1.0)
        if not np.isnan(x[i]):
            y = x[i] if np.isnan(y) else y + w * (x[i] - y)
        want.append(y)
    got = R.Dynamic("y", "x", "a").compute({"x": pd.Series(x), "a": pd.Series(a)}, ids)
    np.testing.assert_allclose(got, want, rtol=1e-11)


def test_ssa_against_svd(bars):
    def last(a):
        n = len(a)
        m = n // 2 + 1
        t = np.array([a[i:i + n - m + 1] for i in range(m)])
        u, s, v = np.linalg.svd(t, full_matrices=False)
        r = s[0] * np.outer(u[:, 0], v[0])
        return np.mean([r[i, n - 1 - i] for i in range(m) if 0 <= n - 1 - i < n - m + 1])

    def one(g):
        x = g.close.to_numpy()
        return pd.Series([last(x[i - 30:i]) if i >= 30 else np.nan for i in range(len(x))])

    same(column(I.ssa(bars), "ssa"), per_code(one))


@pytest.mark.parametrize("name", sorted(S.REGISTRY))
def test_signal_invariants(bars, spark, name):
    out = bars.transform(S.REGISTRY[name])
    types = dict(out.dtypes)
    assert types["entry"] == types["exit"] == "boolean"
    assert out.where("entry is null or exit is null").count() == 0
    assert out.where("entry and exit").count() == 0
    assert out.count() == bars.count()
    if name == "ssa_trend":
        return  # a decomposition of constants is constant only up to rounding
    flat = spark.range(60).select(
        F.lit("x").alias("code"), F.col("id").alias("date"), *[F.lit(100.0).alias(c) for c in ("open", "high", "low", "close")], F.lit(1000).alias("volume"))
    assert flat.transform(S.REGISTRY[name]).where("entry or exit").count() == 0
