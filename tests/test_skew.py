"""Hot keys, tied values and order-dependent folds against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import crosssec as C
from barloom.operators import joins as J
from barloom.operators import ranking as K
from barloom.operators import trades as P

DAY = dt.date(2020, 1, 1)


@pytest.fixture(autouse=True)
def ranges(monkeypatch):
    """Cut even these small groups into ranges; the queries' tests rank them as a whole."""
    monkeypatch.setattr(K, "WHOLE", 0)


def tied(n=3000, seed=5):
    """A third of all rows share one value, and one date holds most rows."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.4, 1.5, rng.normal(0, 2, n).round(2))
    d = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 4, n))
    y = np.where(rng.random(n) < 0.3, 0.0, rng.normal(0, 1, n).round(1))
    return pd.DataFrame({"code": [f"{i:06d}" for i in range(n)], "date": [DAY + dt.timedelta(int(v)) for v in d], "x": x, "y": y})


def test_average_rank(spark):
    p = tied()
    got = K.average_rank(spark.createDataFrame(p), ["date"], "x", "r").toPandas().sort_values("code").r.to_numpy()
    np.testing.assert_allclose(got, p.groupby("date").x.rank().to_numpy())


def test_position_covers_every_place(spark):
    p = tied()
    got = K.position(spark.createDataFrame(p), ["date"], "x", "code", "pos", "n").toPandas()
    want = p.sort_values(["date", "x", "code"]).reset_index(drop=True)
    want["pos"] = want.groupby("date").cumcount() + 1
    m = got.merge(want, on="code")
    assert (m.pos_x == m.pos_y).all() and len(m) == len(p)


@pytest.mark.parametrize("by", [[], ["date"]])
def test_quantiles(spark, by):
    p = tied()
    got = K.quantiles(spark.createDataFrame(p), by, "x", {"a": 0.005, "b": 0.5, "c": 0.995}).toPandas()
    for name, q in (("a", 0.005), ("b", 0.5), ("c", 0.995)):
        if by:
            want = p.groupby("date").x.quantile(q)
            np.testing.assert_allclose(got.set_index("date")[name].sort_index(), want)
        else:
            np.testing.assert_allclose(got[name][0], p.x.quantile(q))


def test_quantile_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "g string, x double")
    got = {r.g: r.m for r in K.quantiles(df, ["g"], "x", {"m": 0.5}).collect()}
    assert got == {"a": 2.5, "b": 2.0}


def test_spearman(spark):
    p = tied()
    got = C.rank_ic(spark.createDataFrame(p), "x", "y").toPandas().set_index("date").ic.sort_index()
    want = p.groupby("date")[["x", "y"]].apply(lambda g: g.x.rank().corr(g.y.rank()))
    np.testing.assert_allclose(got, want.sort_index())


def test_quintile_matches_qcut(spark):
    for n in (5, 7, 23, 101):
        df = spark.createDataFrame([(i, n) for i in range(1, n + 1)], "p int, n int")
        got = [r.q for r in df.select("p", K.quantile_bucket("p", "n").alias("q")).orderBy("p").collect()]
        assert got == list(pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1)


@pytest.mark.parametrize("strict,tol", [(False, None), (True, None), (False, 40)])
def test_asof_hot_key(spark, strict, tol):
    rng = random.Random(1)
    day = lambda: pd.Timestamp(DAY) + pd.Timedelta(days=rng.randrange(900))
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}"
    left = pd.DataFrame([(key(), day(), i) for i in range(800)], columns=["code", "date", "i"])
    right = pd.DataFrame([(key(), day(), float(i)) for i in range(700)], columns=["code", "date", "v"])
    right = right.drop_duplicates(["code", "date"], keep="last")
    dates = lambda d: spark.createDataFrame(d).withColumn("date", F.to_date("date"))
    got = J.asof(dates(left), dates(right), ["v"], strict=strict, tolerance_days=tol).toPandas().sort_values("i").v.to_numpy(float)
    want = pd.merge_asof(
        left.sort_values("date"), right.sort_values("date"), on="date", by="code", allow_exact_matches=not strict,
        tolerance=pd.Timedelta(days=tol) if tol else None).sort_values("i").v.to_numpy(float)
    np.testing.assert_allclose(got, want, equal_nan=True)


def random_log(n=600, seed=9):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sym = "hot" if rng.random() < 0.5 else f"s{rng.randrange(5)}"
        out.append((sym, DAY + dt.timedelta(days=i // 4), rng.choice(["BUY", "BUY", "SELL"]), round(rng.uniform(1, 100), 3), rng.randrange(1, 300), i))
    return out


LOG = "sym string, date date, action string, price double, shares bigint, seq int"


def test_position_fold_with_oversell(spark):
    state = {}
    for sym, _, action, price, shares, _ in random_log():
        held, cost, realized = state.get(sym, (0, 0.0, 0.0))
        if action == "BUY":
            cost = round((held * cost + shares * price) / (held + shares), 4) if held > 0 else round(price, 4)
            held += shares
        else:
            sold = min(shares, max(held, 0))
            if sold > 0:
                realized = round(realized + (price - cost) * sold, 2)
            held -= shares
        state[sym] = (held, cost, realized)
    for r in P.positions(spark.createDataFrame(random_log(), LOG)).collect():
        held, cost, realized = state[r.sym]
        assert r.net_shares == held
        assert r.weighted_avg_cost == pytest.approx(cost, abs=1e-9)
        assert r.realized_pnl == pytest.approx(realized, abs=0.011)
        assert r.status == ("holding" if held > 0 else "short" if held < 0 else "closed")


def fold_brute(log):
    """Cost, realised profit, shares and first name of each symbol, trade by trade."""
    state = {}
    for sym, _, action, price, shares, _, name in log:
        held, cost, realized, first = state.get(sym, (0, 0.0, 0.0, ""))
        if action == "BUY":
            cost = round((held * cost + shares * price) / (held + shares), 4) if held > 0 else round(price, 4)
            held += shares
        else:
            sold = min(shares, max(held, 0))
            if sold > 0:
                realized = round(realized + (price - cost) * sold, 2)
            held -= shares
        state[sym] = (held, cost, realized, first or name or "")
    return state


@pytest.mark.parametrize("kind", ["steady", "growing"])
def test_position_of_a_hot_symbol_is_folded_by_many_tasks(spark, kind):
    """A symbol that is never flat: a steady holding forgets its cost, a growing one carries it through all blocks.

    Prices are such that no profit is half a cent: there a running total may round another way than single sales.
    """
    rng, held, log = random.Random(3), 0, []
    for i in range(6000):
        hot = rng.random() < 0.9
        buy = not hot or held < (3000 if kind == "steady" else 10**9) or rng.random() < 0.5
        shares = rng.randrange(1, 900) if buy or kind == "growing" else rng.randrange(1, 400)
        if hot:
            held += shares if buy else -shares
        log.append(("hot" if hot else f"s{rng.randrange(9)}", DAY + dt.timedelta(days=i // 9), "BUY" if buy else "SELL", rng.uniform(5, 90), shares, i, rng.choice([None, "", f"n{i}"])))
    df = spark.createDataFrame(log, LOG + ", name string").repartition(5)
    days = df.groupBy("sym", "date").agg(F.count(F.lit(1)).alias("n"))
    assert P.in_blocks(days, 500).where("sym = 'hot'").select("block").distinct().count() > 8
    got = {r.sym: r for r in P.positions(df, block_rows=500).collect()}
    whole = {r.sym: r for r in P.positions(df).collect()}
    assert got == whole
    for sym, (shares, cost, realized, name) in fold_brute(log).items():
        r = got[sym]
        assert (r.net_shares, r.weighted_avg_cost, r.name) == (shares, cost, name)
        assert r.realized_pnl == pytest.approx(realized, abs=1e-9)


def test_rounding_is_that_of_single_values():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(-100, 100, 4000), np.arange(-50, 50) + 0.00005, np.arange(0, 900) / 20000, [0.125, 2.675, 1.005]])
    for d in (2, 4):
        assert P.rounded(x, d).tolist() == [round(float(v), d) for v in x]


def test_clamped_lots(spark):
    want, qty = {}, {}
    for sym, day, action, *_ in random_log(seed=4):
        qty[sym] = max(0, qty.get(sym, 0) - 100) if action == "SELL" else qty.get(sym, 0) + 100
        want[(sym, day)] = qty[sym]
    got = {(r.sym, r.date): r.qty for r in P.clamped_lots(spark.createDataFrame(random_log(seed=4), LOG)).collect()}
    assert got == want


def test_interval_sums_count_each_event_once(spark):
    grid = spark.createDataFrame([("a", DAY)], "code string, date date")
    ev = spark.createDataFrame([("a", DAY + dt.timedelta(days=k), 1.0) for k in (-1, 0, 1, 5, 6)] * 3, "code string, date date, v double")
    r = J.interval_sums(grid, ev, {"v": F.col("v")}, {"5": (1, 5), "back": (-30, -1)}).first()
    assert (r.v_5, r.v_back) == (6.0, 3.0)
