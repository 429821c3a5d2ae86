"""Steps whose memory or time grew with the tables."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import common
from barloom.operators import indicators, panels, recur, signals
from tests.conftest import SMALL


def test_text_batches_are_bounded_in_bytes(spark):
    """Long texts come in small Arrow batches, in every stage of the pipeline; a lower bound stays."""
    before = spark.conf.get(common.BATCH_LIMIT)
    long = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 8000).alias("text"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    try:
        common.read(spark, SMALL, "documents")
        assert long.mapInArrow(size, "n long").agg(F.max("n")).first()[0] <= 2 * common.BATCH_BYTES
        spark.conf.set(common.BATCH_LIMIT, "1m")
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH_LIMIT) == "1m"
        docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES[1:]:
            spark.conf.set(common.BATCH_LIMIT, before)
            stage(spark, docs, SMALL)
            assert int(spark.conf.get(common.BATCH_LIMIT).rstrip("b")) == common.BATCH_BYTES
    finally:
        spark.conf.set(common.BATCH_LIMIT, before)


def test_event_sums_are_dealt_by_their_number(spark, monkeypatch):
    """More events are more tasks, not larger ones; each row of events is dealt once."""
    monkeypatch.setattr(panels, "EVENTS", 50)
    events = spark.range(900).select((F.col("id") % 90).cast("string").alias("code"), F.date_add(F.lit("2020-01-01"), (F.col("id") / 90).cast("int")).alias("date"), F.lit(1.0).alias("x"))
    runs, _ = panels.trailing(events.select("code"), events, events, {"s": ("x", 3)})
    assert runs.rdd.getNumPartitions() == 18
    got = panels.expand(runs, panels.places(events)).groupBy("place").agg(F.min("s"), F.max("s"), F.count("code"))
    assert {tuple(r) for r in got.collect()} == {(i, min(i + 1, 3.0), min(i + 1, 3.0), 90) for i in range(10)}


def test_rolled_windows(spark):
    """Values of the last n known rows of a symbol, in one pass; no window frame of hundreds of rows."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=40), np.full(20, 0.1), [np.nan], rng.normal(size=30), rng.normal(size=25)])
    ids = np.repeat([0, 1], [91, 25])
    got = recur.Rolled("z", "x", 12, recur.standing).compute({"x": pd.Series(x)}, ids).to_numpy()
    for i in range(len(x)):
        w = x[max(0, i - 11):i + 1]
        whole = len(w) == 12 and not np.isnan(w).any() and ids[i] == ids[i - 11]
        want = (w[-1] - w.mean()) / w.std(ddof=1) if whole and w.min() < w.max() else np.nan
        np.testing.assert_allclose(got[i], want, rtol=1e-9, atol=1e-9)
    d = recur.Change("d", "x", 2).compute({"x": pd.Series([1.0, 0.0, 3.0, 4.0, 5.0, 6.0])}, np.array([0, 0, 0, 0, 1, 1])).to_numpy()
    np.testing.assert_array_equal(d, [np.nan, np.nan, 2.0, np.nan, np.nan, np.nan])
    bars = spark.range(5).selectExpr("'a' code", "date'2020-01-01' + int(id) date", "double(id) high", "double(id) low", "double(id) close", "id volume")
    for df in (indicators.rsrs(bars, 3, 600), signals.factor_momentum(bars)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "-599" not in plan and "percentile" not in plan and "MapInArrow" in plan
