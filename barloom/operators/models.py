"""Forward-return models on ``pyspark.ml``: all fits and predictions are distributed."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import rising_edge
from barloom.operators.ranking import calendar_join, quantiles, with_global
from barloom.sources.sinks import new_path, publish, write_partitioned


def time_split(df: DataFrame, share: float = 0.6, date: str = "date") -> DataFrame:
    """``is_train`` for rows on the first ``share`` of the calendar's dates: no train row follows a test row."""
    cal = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    cal = cal.select(date, (F.percent_rank().over(Window.orderBy(date)) < share).alias("is_train"))
    return calendar_join(df, cal, [date])


def return_regression(df: DataFrame, features: Sequence[str], label: str, *, share: float = 0.6, enter: float = 0.75, leave: float = 0.25, rounds: int = 20, depth: int = 4) -> DataFrame:
    """Predicted forward return; entry/exit edges at quantiles of the train predictions."""
    data = time_split(df.dropna(subset=[*features, label]), share)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=7)])
    model = pipe.fit(data.where("is_train"))
    pred = publish(model.transform(data).drop("_x"), "predictions")  # the cuts read them several times
    cuts = quantiles(pred.where("is_train"), [], "prediction", {"_hi": enter, "_lo": leave})
    scored = with_global(pred, cuts)
    test = ~F.col("is_train")
    return scored.withColumns({
        "entry": rising_edge(test & (F.col("prediction") > F.col("_hi"))), "exit": rising_edge(test & (F.col("prediction") < F.col("_lo")))}).drop("_hi", "_lo")


def direction_classifier(df: DataFrame, features: Sequence[str], label: str, *, share: float = 0.6, enter: float = 0.55, leave: float = 0.45) -> DataFrame:
    """Probability of a positive return; scaling is learned on the train rows only."""
    data = time_split(df.dropna(subset=[*features, label]), share).withColumn("_y", F.when(F.col(label) > 0, 1.0).otherwise(0.0))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=30)])
    pred = pipe.fit(data.where("is_train")).transform(data)
    pred = pred.withColumn("probability", vector_to_array("probability")[1]).drop("_raw", "_x", "rawPrediction", "_y", "prediction")
    test = ~F.col("is_train")
    return pred.withColumns({"entry": rising_edge(test & (F.col("probability") > enter)), "exit": rising_edge(test & (F.col("probability") < leave))})


def picker(df: DataFrame, features: Sequence[str], *, share: float = 0.5, rounds: int = 20) -> DataFrame:
    """Cross-sectional classifier on the first half of the dates; ``ensemble`` = probability x momentum."""
    data = time_split(df, share).withColumn("_y", F.col("target").cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=4, seed=7)])
    pred = pipe.fit(data.where("is_train")).transform(data.where("not is_train"))
    pred = pred.withColumn("probability", vector_to_array("probability")[1]).drop("_x", "_y", "rawPrediction", "prediction")
    return pred.withColumn("ensemble", F.col("probability") * F.col("momentum"))


def walk_months(df: DataFrame, *, train: int = 12, gap: int = 1) -> list:
    """Months of the calendar that have ``train`` months of history before the gap; one per month, so few."""
    months = [r.m for r in df.select(F.trunc("date", "month").alias("m")).distinct().orderBy("m").collect()]
    return months[train + gap:]


def by_month(df: DataFrame) -> DataFrame:
    """The table written with a directory per month, ``_month``, of which windows open their own only."""
    path = new_path(df.sparkSession, "by-month")
    out = df.withColumn("_month", F.trunc("date", "month"))
    write_partitioned(out, path, ["_month"], rows=200_000, sort=["date", "code"])
    return df.sparkSession.read.schema(out.schema).parquet(path)


def walk_window(df: DataFrame, month, *, train: int = 12, gap: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one test month: ``train`` months that end ``gap`` months before it, and the month.

    Of a table from ``by_month`` only the months of the window are read.
    """
    m, day = F.col("_month") if "_month" in df.columns else F.trunc("date", "month"), F.to_date(F.lit(str(month)))
    return df.where((m >= F.add_months(day, -(train + gap))) & (m < F.add_months(day, -gap))), df.where(m == day)


def walk_forward(
    df: DataFrame, features: Sequence[str], label: str, months: Sequence, *, train: int = 12, gap: int = 1, rounds: int = 10, learner: str = "gbt", parallel: int = 8,
):
    """Yield (month, predictions) for each test month, fitted on its window; months without training rows are passed over.

    ``learner`` is "gbt" or "linear".  Months do not depend on each other, so
    ``parallel`` of them are fitted at once, each on one window of the table,
    which is laid out by month for them; rows that can teach are counted once
    for all months.  "gbt" cuts features at a sample that the learner draws by
    the place of rows, so that another layout gives other trees.
    """
    df = by_month(df)
    taught = {r.m for r in df.dropna(subset=[*features, label]).select(F.col("_month").alias("m")).distinct().collect()}  # one per month, so few

    def fit(month):
        window, _ = walk_window(df, month, train=train, gap=gap)
        kind = LinearRegression(featuresCol="_x", labelCol=label, regParam=1e-3) if learner == "linear" else GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=4, seed=7)
        return month, Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), kind]).fit(window.dropna(subset=[*features, label]))

    def back(month, k: int):
        at = month.year * 12 + month.month - 1 - k
        return month.replace(year=at // 12, month=at % 12 + 1)

    usable = [x for x in months if any(back(x, k) in taught for k in range(gap + 1, gap + train + 1))]
    with ThreadPool(max(1, parallel)) as pool:
        for month, model in pool.imap(inheritable_thread_target(df.sparkSession)(fit), usable):
            _, test = walk_window(df, month, train=train, gap=gap)
            day = F.to_date(F.lit(str(month))).alias("month")
            yield month, model.transform(test.dropna(subset=list(features))).select("date", "code", F.col("prediction").alias("score"), day)
