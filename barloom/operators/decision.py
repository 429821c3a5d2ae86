"""Latest-row decisions, whole-market scan, breadth and vote filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import lag, mean_n, series
from barloom.operators import indicators as I
from barloom.operators.ranking import top_k, with_global
from barloom.operators.signals import SLACK, THRESHOLD, VOTE_WEIGHTS, fusion_inputs, vote_score, votes

# Trend labels.
RISING, FALLING = "上升", "下降"
INDICATORS = ["ma5", "ma10", "ma20", "ma60", "rsi", "k", "d", "j", "dif", "dea", "hist", "boll_upper", "boll_mid", "boll_lower", "atr"]
THREE_DIGITS = {"dif", "dea", "hist"}


def analyze(bars: DataFrame) -> DataFrame:
    """One decision row per symbol from its latest bar."""
    df = votes(I.atr(fusion_inputs(bars), 14), latest_rule=True)
    df = df.withColumns({
        **{f"ma{n}": mean_n("close", n) for n in (5, 10, 20, 60)}, "_prev": lag("close"), "_n": F.row_number().over(series()),
        "buy_score": vote_score(1), "sell_score": vote_score(-1),
    })
    # the newest row per symbol: aggregated, not sorted again
    cols = [c for c in df.columns if c not in ("code",)]
    last = df.groupBy("code").agg(F.max_by(F.struct(*cols), "date").alias("_x")).select("code", "_x.*")
    return last.select(*_decision())


def _decision() -> list[Column]:
    px, a = F.col("close"), F.col("atr")
    b, s = F.col("buy_score"), F.col("sell_score")
    buy = (b + SLACK >= THRESHOLD) & (b > s)
    sell = (s + SLACK >= THRESHOLD) & (s > b)
    sig = F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD")
    up = F.coalesce(px > F.col("ma60"), F.lit(False))
    r2 = lambda c: F.round(c, 2)
    side = lambda x, y: F.when(buy, r2(x)).when(sell, r2(y))
    low = F.when(buy, F.least(px, F.col("ma5")) * 0.995).when(sell, px * 0.995)
    pos = F.when(buy, F.when(b >= 0.65, 15).otherwise(10) + F.when(up, 5).otherwise(0)).otherwise(0)
    return [
        F.col("code"), F.col("date"), r2(px).alias("price"), r2((px / F.col("_prev") - 1.0) * 100.0).alias("change_pct"),
        sig.alias("signal"), F.round(b, 3).alias("buy_score"), F.round(s, 3).alias("sell_score"),
        F.struct(*[F.col(f"v_{n.lower()}").alias(n) for n in VOTE_WEIGHTS]).alias("votes"),
        F.when(up, RISING).otherwise(FALLING).alias("trend_ma60"), r2((px / F.col("ma60") - 1.0) * 100.0).alias("above_ma60_pct"),
        F.struct(*[F.round(c, 3 if c in THREE_DIGITS else 2).alias(c) for c in INDICATORS]).alias("indicators"),
        F.when(buy | sell, F.array(r2(low), r2(px * 1.005))).alias("entry_range"),
        side(px - 1.8 * a, px + 1.8 * a).alias("stop_loss"), side(px + 2.0 * a, px - 2.0 * a).alias("target_1"),
        side(px + 3.5 * a, px - 3.5 * a).alias("target_2"), pos.alias("suggested_position_pct"), F.col("_n").alias("n_bars"),
    ]


def market_scan(bars: DataFrame, universe: DataFrame, *, window: int = 180, need: int = 90) -> DataFrame:
    """Decision per universe symbol on its last bars; too short or absent symbols carry an error instead."""
    recent = top_k(bars, ["code"], [F.desc("date")], window, "_k").drop("_k")
    sizes = recent.groupBy("code").agg(F.count(F.lit(1)).alias("_rows"))
    enough = recent.join(sizes.where(F.col("_rows") >= need), "code", "left_semi")
    out = universe.select("code", "name").join(analyze(enough), "code", "left").join(sizes, "code", "left")
    error = F.when(F.col("_rows").isNull(), "no data").when(F.col("_rows") < need, F.concat(F.lit("only "), F.col("_rows").cast("string"), F.lit(" bars")))
    return out.withColumn("error", error).drop("_rows")


def breadth(scan: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """BUY/SELL/HOLD and up-trend shares and weighted means per constituent set (members: group, code, weight)."""
    j = members.join(scan.where("error is null"), "code")
    pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    w = F.col("weight")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(w))
    return j.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[pct(F.col("signal") == s).alias(f"{s.lower()}_pct") for s in ("BUY", "SELL", "HOLD")],
        pct(F.col("trend_ma60") == RISING).alias("uptrend_pct"), mean("change_pct").alias("w_chg"), mean("buy_score").alias("w_buy"), mean("sell_score").alias("w_sell"))


def ranking(scan: DataFrame, side: str = "BUY", n: int = 20) -> DataFrame:
    """Best decisions of one side: score, up-trend first, RSI ascending (mirrored for SELL)."""
    up = F.when(F.col("trend_ma60") == RISING, 0).otherwise(1)
    rsi = F.col("indicators.rsi")
    if side == "BUY":
        order = [F.desc("buy_score"), up.asc(), rsi.asc(), F.asc("code")]
    else:
        order = [F.desc("sell_score"), up.desc(), rsi.desc(), F.asc("code")]
    return scan.where(F.col("signal") == side).orderBy(*order).limit(n)


def debate(df: DataFrame) -> DataFrame:
    """Additive-confidence rule votes of a bull, a bear and a neutral judge.

    Input columns: z_pred, z_amp, amp_imb, ma5, ma20, last_close, ret_1, vol_ratio, rec_price, stop_loss.
    """
    add = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    c = F.col
    bull = 0.4 + add(c("z_pred") > 2, 0.20) + add(c("ma5") > c("ma20"), 0.15) + add(c("vol_ratio") > 1.3, 0.10) + add(
        (c("rec_price") != 0) & (c("last_close") < c("rec_price") * 1.02), 0.10)
    points = [
        (c("z_amp") < -1.5, 0.15), (c("amp_imb") < -0.015, 0.15), (c("ma5") < c("ma20"), 0.15), (c("ret_1") < -0.03, 0.10),
        ((c("stop_loss") != 0) & (c("last_close") < c("stop_loss") * 1.05), 0.20), (c("vol_ratio") < 0.7, 0.10),
    ]
    risk = sum((add(p, x) for p, x in points[1:]), add(*points[0]))
    bear = F.when(risk > 0, 0.3 + risk).otherwise(0.20)
    df = df.withColumns({"_bear": bear, "bull_score": F.round(F.least(bull, F.lit(1.0)), 2)})
    df = df.withColumns({"bear_score": F.round(F.least(F.col("_bear"), F.lit(1.0)), 2), "bear_vote": F.when(F.col("_bear") > 0.55, "SELL").otherwise("HOLD")})
    gap = F.col("bull_score") - F.col("bear_score")
    return df.withColumns({
        "bull_vote": F.lit("BUY"),
        "vote": F.when(F.col("bull_score") > F.col("bear_score") + 0.15, "BUY").when(F.col("bear_score") > F.col("bull_score") + 0.15, "SELL").otherwise("HOLD"),
        "vote_score": F.round(F.abs(gap), 2),
    }).drop("_bear")


def latest_votes(log: DataFrame, on: Column | None = None) -> DataFrame:
    """Last vote per (sym, agent) on the newest (or given) date of a vote log (agent, sym, vote, ts)."""
    day = F.to_date("ts")
    if on is None:
        dated = with_global(log.withColumn("_d", day), log.agg(F.max(day).alias("_last")))
        chosen = dated.where(F.col("_d") == F.col("_last"))
    else:
        chosen = log.where(day == on)
    return chosen.groupBy("sym", "agent").agg(F.max_by("vote", F.struct("ts", "vote")).alias("vote"))


def veto(picks: DataFrame, vote_table: DataFrame, agent: str = "neutral") -> DataFrame:
    """Picks with ``vetoed``: only an explicit SELL of the primary agent drops a pick."""
    primary = vote_table.where(F.col("agent") == agent).select("sym", F.col("vote").alias("primary_vote"))
    j = picks.join(primary, "sym", "left")
    return j.withColumn("vetoed", F.coalesce(F.col("primary_vote") == "SELL", F.lit(False)))
