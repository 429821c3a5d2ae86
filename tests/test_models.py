"""Models: rows, schema, leakage, and what is learned from."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import models as ML
from tests.conftest import SMALL

MODELS = ["model_return_regression", "model_direction_classifier", "model_cross_section_picker", "model_walk_forward"]


@pytest.mark.parametrize("name", MODELS)
def test_predictions_are_whole(spark, name):
    df = entry.queries()[name](spark, SMALL)
    rows = df.collect()
    assert rows
    score = next((c for c in ("prediction", "probability", "score") if c in df.columns), None)
    if score:
        assert all(r[score] is not None and np.isfinite(r[score]) for r in rows)
        assert len({(r["code"], r["date"]) for r in rows}) == len(rows)
    if name == "model_walk_forward":
        months = sorted({r[0] for r in entry.queries()["bars_monthly"](spark, SMALL).select("date").collect()})
        got = {r["month"] for r in rows}
        assert got <= set(months[13:]) and len(got) > len(months) / 4  # the longest feature needs a history of its own


def panel(spark, n=60, shift=0.0):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        for c in range(6):
            x = float(rng.normal() + (shift if i >= n * 0.6 else 0.0))
            rows.append((f"c{c}", dt.date(2000, 1, 1) + dt.timedelta(days=i), x, float(rng.normal()), x * 0.5 + float(rng.normal()) * 0.01))
    return spark.createDataFrame(rows, "code string, date date, a double, b double, fwd double")


def test_no_train_row_follows_a_test_row(spark):
    s = ML.time_split(panel(spark)).groupBy("is_train").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()
    side = {r.is_train: r for r in s}
    assert side[True].hi < side[False].lo


def test_test_labels_do_not_change_what_is_learned(spark):
    p = panel(spark)
    spoiled = ML.time_split(p).withColumn("fwd", F.when(F.col("is_train"), F.col("fwd")).otherwise(1e6)).drop("is_train")
    a = ML.return_regression(p, ["a", "b"], "fwd", rounds=3).orderBy("code", "date").select("prediction").collect()
    b = ML.return_regression(spoiled, ["a", "b"], "fwd", rounds=3).orderBy("code", "date").select("prediction").collect()
    assert a == b


def test_scaling_is_learned_on_train_rows(spark):
    near = ML.direction_classifier(panel(spark), ["a", "b"], "fwd").where("is_train").orderBy("code", "date").select("probability").collect()
    far = ML.direction_classifier(panel(spark, shift=50.0), ["a", "b"], "fwd").where("is_train").orderBy("code", "date").select("probability").collect()
    assert np.allclose([r[0] for r in near], [r[0] for r in far])


def test_walk_window_ends_before_the_gap(spark):
    rows = [("c", dt.date(2000 + i // 12, i % 12 + 1, 1), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "code string, date date, a double")
    months = ML.walk_months(df)
    assert months[0] == dt.date(2001, 2, 1) and len(months) == 17
    train, test = ML.walk_window(df, months[0])
    assert train.agg(F.min("date"), F.max("date")).first() == (dt.date(2000, 1, 1), dt.date(2000, 12, 1)) and test.count() == 1


def test_a_walk_opens_the_months_of_its_windows_only(spark):
    rows = [(f"c{c}", dt.date(2000 + i // 12, i % 12 + 1, 1), float(i % 5 + c), float(i)) for i in range(16) for c in range(3)]
    df = spark.createDataFrame(rows, "code string, date date, a double, fwd double")
    months = ML.walk_months(df)
    walk = list(ML.walk_forward(df, ["a"], "fwd", months, rounds=1))
    assert [m for m, _ in walk] == months and all(p.count() == 3 for _, p in walk)
    for _, pred in walk:
        assert "PartitionFilters: [isnotnull(_month" in pred._jdf.queryExecution().executedPlan().toString()
    train, test = ML.walk_window(ML.by_month(df), months[0])
    assert train.select(F.input_file_name()).distinct().count() >= 12 and train.count() == 36
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_month" in plan and "trunc(" not in plan


def test_trees_are_asked_once(spark):
    """The quantiles, the edges and the result read predictions that are written, instead of passing the trees again."""
    plan = ML.return_regression(panel(spark), ["a", "b"], "fwd", rounds=1)._jdf.queryExecution().executedPlan().toString()
    assert "predictions-" in plan and "UDF" not in plan
