"""Panels as runs against dense pandas panels, and how many runs there are."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import factors as A
from barloom.operators import panels as N

DAY = dt.date(2021, 1, 4)
DATES = [DAY + dt.timedelta(days=i) for i in range(0, 600, 2) if i % 14]  # a calendar with gaps
CODES = ["a", "b", "c", "never"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    events = {(rng.choice("aabc"), rng.choice(DATES)): (round(rng.uniform(-9, 9), 2), rng.choice([None, 1.5, 2.5])) for _ in range(60)}
    events |= {("a", DATES[0]): (1.0, 2.0), ("b", DATES[-1]): (4.0, None), ("other", DATES[5]): (9.0, 9.0)}
    rows = [(c, d, x, y) for (c, d), (x, y) in events.items()]
    cal = spark.createDataFrame([(d,) for d in DATES] * 2, "date date")
    return rows, spark.createDataFrame(rows, "code string, date date, x double, y double"), cal, spark.createDataFrame([(c,) for c in CODES] * 2, "code string")


def dense(rows, col):
    p = pd.DataFrame(rows, columns=["code", "date", "x", "y"]).pivot(index="date", columns="code", values=col)
    return p.reindex(index=DATES, columns=CODES)


def panel(df, col):
    got = df.select("code", "date", F.col(col).alias("v")).toPandas()
    assert len(got) == len(DATES) * len(CODES)
    return got.pivot(index="date", columns="code", values="v").reindex(index=DATES, columns=CODES).astype(float)


def test_zero_filled(tables):
    rows, events, cal, keys = tables
    got = N.zero_filled(keys, cal, events, ["x", "y"]).cache()
    for c in "xy":
        np.testing.assert_allclose(panel(got, c), dense(rows, c).astype(float).fillna(0))


def test_carried(tables, spark):
    rows, _, cal, keys = tables
    shifted = [(c, d + dt.timedelta(days=random.Random(str((c, d))).choice([-1, 0, 3])), x, y) for c, d, x, y in rows]
    shifted = list({r[:2]: r for r in shifted}.values())
    df = spark.createDataFrame(shifted, "code string, date date, x double, y double")
    got = N.carried(keys, cal, df, ["x"], at="at").cache()
    days = pd.DataFrame([(c, pd.Timestamp(d)) for d in DATES for c in CODES], columns=["code", "date"])
    right = pd.DataFrame(shifted, columns=["code", "date", "x", "y"]).assign(date=lambda p: pd.to_datetime(p.date), at=lambda p: p.date).sort_values("date")
    want = pd.merge_asof(days.sort_values("date"), right[["code", "date", "x", "at"]], on="date", by="code")
    m = got.toPandas().assign(date=lambda p: pd.to_datetime(p.date)).merge(want, on=["code", "date"])
    assert len(m) == len(want)
    np.testing.assert_allclose(m.x_x.astype(float), m.x_y)
    assert (pd.to_datetime(m.at_x).fillna(DAY_0) == m.at_y.fillna(DAY_0)).all()


DAY_0 = pd.Timestamp(0)


def test_trailing_sums_are_runs(tables):
    rows, events, cal, keys = tables
    runs, places = N.trailing(keys, cal, events, {"s7": ("x", 7), "s30": ("x", 30), "one": ("y", 1)})
    got = N.expand(runs.fillna(0, subset=["s7", "s30", "one"]), places).cache()
    x = dense(rows, "x").astype(float).fillna(0)
    np.testing.assert_allclose(panel(got, "s7"), x.rolling(7, min_periods=1).sum(), atol=1e-9)
    np.testing.assert_allclose(panel(got, "s30"), x.rolling(30, min_periods=1).sum(), atol=1e-9)
    np.testing.assert_allclose(panel(got, "one"), dense(rows, "y").astype(float).fillna(0))
    assert runs.count() <= 4 * len(rows) + len(CODES)  # an event, and where it leaves each of three sums
    assert runs.where("first > last").count() == 0


def test_windows_see_changes_only(tables):
    """No window or shuffle of the plan takes the expanded panel."""
    _, events, cal, keys = tables
    d = events.select("code", "date", F.col("x").alias("net_amt"), F.col("y").alias("net_buy_pct"))
    out = A.event_features(d, keys, cal)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    grown = next(i for i, line in enumerate(plan) if "Generate explode(sequence" in line)
    assert not any(k in line for line in plan[:grown] for k in ("Window", "Aggregate", "Sort"))
    assert out.count() == len(DATES) * len(CODES)


def test_empty_calendar_and_events(tables, spark):
    _, events, cal, keys = tables
    assert N.zero_filled(keys, cal.limit(0), events, ["x"]).count() == 0
    assert N.zero_filled(keys, cal, events.limit(0), ["x"]).agg(F.sum("x"), F.count("x")).first() == (0.0, len(DATES) * len(CODES))
    assert N.carried(keys, cal, events.limit(0), ["x"]).where("x is not null").count() == 0
