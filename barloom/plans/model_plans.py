"""Model queries: results depend on the learner, so they carry no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import factors as A
from barloom.operators import indicators as I
from barloom.operators import models as ML
from barloom.operators import picks as P
from barloom.plans.factor_plans import with_shares
from barloom.plans.registry import BARS_M_SQL, query, r, with_
from barloom.sources import sinks


def frame(t, h: int = 1):
    """Model frame, written once: every boosting round reads it again."""
    f = A.model_features(t.bars_m).withColumn("fwd", I.forward_return(h))
    return sinks.publish(f.select("code", "date", "fwd", *A.FEATURES_12), "frame")


@query("model_return_regression")
def model_return_regression(t):
    p = ML.return_regression(frame(t), A.FEATURES_12, "fwd")
    return p.select("code", "date", "is_train", r("prediction").alias("prediction"), "entry", "exit")


@query("model_direction_classifier")
def model_direction_classifier(t):
    p = ML.direction_classifier(frame(t), A.FEATURES_12, "fwd")
    return p.select("code", "date", "is_train", r("probability").alias("probability"), "entry", "exit")


@query("model_cross_section_picker")
def model_cross_section_picker(t):
    """Ensemble score of the second half, evaluated as periodic picks."""
    f = A.picker_features(with_shares(t), 3, ma_long=30)
    f = sinks.publish(f.withColumn("momentum", A.momentum_score(surge=1.0, lo=0.0, hi=1.0, chg=(0.0, 1e9), ma=5)).fillna(0.0, ["momentum"]), "frame")
    scored = ML.picker(f, A.FEATURES_18)
    bars = t.bars_m.join(scored.select("code", "date", "probability"), ["code", "date"], "left")
    return P.periodic_picks(bars, "probability", [(3, 5)], stop=-0.3).select("date", "n_picks", r("net_ret").alias("net_ret"))


@query("model_walk_forward")
def model_walk_forward(t):
    """Monthly predictions, each replacing its own slice of the prediction table."""
    path = sinks.new_path(t.spark, "pred")
    f = frame(t)
    for _, pred in ML.walk_forward(f, A.FEATURES_12, "fwd", ML.walk_months(f)):
        sinks.replace_slices(pred, path, "month")
    return t.spark.read.parquet(path).select("code", "date", r("score").alias("score"), F.col("month").cast("date").alias("month"))


@query("model_split", with_(BARS_M_SQL, "c AS (SELECT date,percent_rank() OVER (ORDER BY date)<0.6 AS is_train FROM (SELECT DISTINCT date FROM bars))") + "SELECT is_train,count(*) AS n,min(date) AS first_date,max(date) AS last_date FROM bars JOIN c USING (date) GROUP BY 1")
def model_split(t):
    """Sizes and dates of the training and the test rows: no training date follows a test date."""
    s = ML.time_split(t.bars_m.select("code", "date"))
    return s.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("model_walk_coverage", with_(BARS_M_SQL, "c AS (SELECT date,row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars))", "k AS (SELECT code,date,row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM bars)") + "SELECT date AS month,CAST(count(*) AS BIGINT) AS n_rows FROM k JOIN c USING (date) WHERE i>13 GROUP BY 1")
def model_walk_coverage(t):
    """Test rows of every month of the walk."""
    b = t.bars_m.select("code", "date")
    months = t.spark.createDataFrame([(m,) for m in ML.walk_months(b)], "month date")
    return b.join(months, b["date"] == months["month"]).groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"))
