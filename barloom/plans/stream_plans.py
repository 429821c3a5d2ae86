"""Structured-streaming queries run to completion over files derived from the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import risk as Q
from barloom.plans.registry import BARS_D_SQL, Tables, query, r, r6, with_
from barloom.sources import sinks
from barloom.streaming import bars as SB
from barloom.streaming import positions as SP
from barloom.streaming.state import read_version


def five_minute(t: Tables) -> DataFrame:
    """Five-minute bars per event type."""
    e = t.table("events")
    slot = F.window(F.col("ts").cast("timestamp"), "5 minutes").start
    return e.groupBy(F.col("event_type").alias("code"), slot.alias("datetime")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("volume"), F.sum("value").alias("amount"))


FIVE_SQL = """fm AS (SELECT event_type AS code,time_bucket(INTERVAL 5 MINUTE,ts) AS datetime,arg_max(value,(ts,event_id)) AS close,CAST(count(*) AS BIGINT) AS volume FROM events GROUP BY 1,2)"""


def resent(t: Tables) -> str:
    """A feed that sends every bar, then the later half again with other values."""
    path = sinks.new_path(t.spark, "feed")
    b = five_minute(t)
    b.write.json(path)
    b.where(F.col("datetime") >= "2024-01-15").withColumn("close", F.col("close") + 1000.0).write.mode("append").json(path)
    return path


@query("stream_ingest_dedup", with_(FIVE_SQL) + "SELECT code,count(*) AS n FROM fm GROUP BY 1")
def stream_ingest_dedup(t):
    """Each bar key is stored once, whichever of its two copies comes first."""
    out = sinks.new_path(t.spark, "bars5")
    SB.ingest(SB.bar_stream(t.spark, resent(t)), out, sinks.new_path(t.spark, "ckpt"), "40 days").awaitTermination()
    return t.spark.read.parquet(out).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("stream_ingest_history", with_(FIVE_SQL) + "SELECT code,datetime,close FROM fm")
def stream_ingest_history(t):
    """Bars re-sent long after the watermark: the stored bar wins against the whole history."""
    out = sinks.new_path(t.spark, "bars5")
    first = sinks.new_path(t.spark, "feed1")
    b = five_minute(t)
    b.write.json(first)
    SB.ingest_against_history(SB.bar_stream(t.spark, first), out, sinks.new_path(t.spark, "ckpt")).awaitTermination()
    again = sinks.new_path(t.spark, "feed2")
    b.withColumn("close", F.col("close") + 1000.0).write.json(again)
    more = sinks.new_path(t.spark, "bars5b")
    stored = t.spark.read.parquet(out).drop("batch")
    stored.write.partitionBy("day").parquet(f"{more}/batch=-1")
    SB.ingest_against_history(SB.bar_stream(t.spark, again), more, sinks.new_path(t.spark, "ckpt")).awaitTermination()
    return t.spark.read.parquet(more).select("code", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "close")


@query("stream_live_view", with_(FIVE_SQL, "k AS (SELECT *,row_number() OVER (PARTITION BY code ORDER BY datetime DESC) AS k FROM fm)") +
       f"SELECT code,max(datetime) AS datetime,arg_max(close,datetime) AS close,count(*) AS n_spark,{r6('list(close ORDER BY datetime)[1]')} AS oldest,{r6('max(CASE WHEN k=1 THEN close END)/max(CASE WHEN k=2 THEN close END)-1')} AS ret FROM k WHERE k<=24 GROUP BY 1")
def stream_live_view(t):
    """Two runs of the stream: the second goes on from the state that the first left in the checkpoint."""
    feed, view, checkpoint = (sinks.new_path(t.spark, n) for n in ("feed", "view", "ckpt"))
    b = five_minute(t)
    for part in ("datetime < '2024-01-20'", "datetime >= '2024-01-20'"):
        b.where(part).write.mode("append").json(feed)
        SB.live_view_stream(SB.bar_stream(t.spark, feed), view, checkpoint).awaitTermination()
    v = read_version(t.spark, view)
    return v.select("code", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "close", F.size("spark").cast("bigint").alias("n_spark"), r(F.get("spark", F.lit(0))).alias("oldest"), r("ret").alias("ret"))


@query("stream_daily_merge", with_(BARS_D_SQL) + "SELECT code,date,CASE WHEN date>='2024-01-20' THEN close+7 ELSE close END AS close FROM bars")
def stream_daily_merge(t):
    """Daily rows arriving as files are merged into the main table; the new row wins."""
    b = t.bars_d.select("code", "date", "close")
    main = sinks.new_path(t.spark, "main")
    b.where("date < '2024-01-25'").write.partitionBy("date").parquet(main)
    inc = sinks.new_path(t.spark, "sidecar")
    b.where("date >= '2024-01-20'").withColumn("close", F.col("close") + 7.0).write.parquet(inc)
    stream = t.spark.readStream.schema(b.schema).parquet(inc)
    SB.daily_merge(stream, main, sinks.new_path(t.spark, "ckpt"), order=["close"]).awaitTermination()
    return t.spark.read.schema(b.schema).parquet(main)


@query("stream_positions", f"""WITH RECURSIVE e AS (SELECT lpad(CAST(user_id AS VARCHAR),6,'0') AS sym,CASE WHEN event_type IN ('view','click','purchase') THEN 'BUY' ELSE 'SELL' END AS action,value*1.000137 AS price,CAST(event_id%7+1 AS BIGINT) AS shares,row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS seq FROM events WHERE value>0),
f AS (SELECT sym,seq,CASE WHEN action='BUY' THEN shares ELSE -shares END AS held,CASE WHEN action='BUY' THEN round(price,4) ELSE 0 END AS cost,CAST(0 AS DOUBLE) AS realized FROM e WHERE seq=1 UNION ALL
SELECT x.sym,x.seq,f.held+CASE WHEN x.action='BUY' THEN x.shares ELSE -x.shares END,CASE WHEN x.action='BUY' THEN CASE WHEN f.held>0 THEN round((f.held*f.cost+x.shares*x.price)/(f.held+x.shares),4) ELSE round(x.price,4) END ELSE f.cost END,
CASE WHEN x.action='SELL' AND f.held>0 THEN round(f.realized+(x.price-f.cost)*least(x.shares,f.held),2) ELSE f.realized END FROM f JOIN e x ON x.sym=f.sym AND x.seq=f.seq+1)
SELECT sym,arg_max(held,seq) AS net_shares,{r6('arg_max(cost,seq)', 4)} AS weighted_avg_cost,{r6('arg_max(realized,seq)', 2)} AS realized_pnl,count(*) AS trade_count FROM f GROUP BY 1""")
def stream_positions(t):
    """Trades appended between two runs of the stream; the state after the last equals the fold of the whole log."""
    e = t.table("events").where("value > 0")
    path, out, checkpoint = (sinks.new_path(t.spark, n) for n in ("trade-feed", "positions", "ckpt"))
    rows = e.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("sym"), F.when(F.col("event_type").isin("view", "click", "purchase"), "BUY").otherwise("SELL").alias("action"),
        (F.col("value") * 1.000137).alias("price"), (F.col("event_id") % 7 + 1).alias("shares"), F.col("ts").cast("timestamp").alias("recorded_at"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for part in ("recorded_at < '2024-01-15'", "recorded_at >= '2024-01-15'"):
        rows.where(part).write.mode("append").parquet(path)
        SP.follow_positions(t.spark.readStream.schema(rows.schema).parquet(path), save, checkpoint).awaitTermination()
    every = t.spark.read.parquet(out)
    newest = every.join(every.groupBy("sym").agg(F.max("batch").alias("batch")), ["sym", "batch"])
    return newest.select("sym", "net_shares", r("weighted_avg_cost", 4).alias("weighted_avg_cost"), r("realized_pnl", 2).alias("realized_pnl"), "trade_count")


@query("stream_gate_events", with_(BARS_D_SQL) + "SELECT code,(arg_max(close,date)-max(close))/max(close)<=-0.15 AS blocked FROM bars GROUP BY 1 HAVING count(*)>=20 AND max(close)>0 AND (arg_max(close,date)-max(close))/max(close)<=-0.15")
def stream_gate_events(t):
    """Failed gates flow into an append-only event sink."""
    gates = Q.drawdown_gate(t.bars_d.select("code", "date", F.col("close").alias("nav")), ["code"], min_history=20)
    path, out = sinks.new_path(t.spark, "gates"), sinks.new_path(t.spark, "events")
    gates.write.parquet(path)
    SP.emit_events(t.spark.readStream.schema(gates.schema).parquet(path), out, sinks.new_path(t.spark, "ckpt")).awaitTermination()
    back = t.spark.read.schema("code string, gate string, ok boolean, reason string, metric double").json(out)
    return back.select("code", (~F.col("ok")).alias("blocked"))
