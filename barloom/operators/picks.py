"""Rule-based pick evaluation expressed as windows and aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import change, div
from barloom.operators.ranking import calendar_join, top_k


def market_calendar(bars: DataFrame) -> DataFrame:
    """Distinct dates numbered from 0: date, idx, n_dates (a calendar table)."""
    cal = bars.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    return cal.select(
        "date", (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n_dates"))


def with_calendar_leads(bars: DataFrame, cal: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Columns ``name`` = value of a column ``k`` market dates ahead (null if the symbol has no bar there)."""
    w = Window.partitionBy("code").orderBy("idx")
    df = calendar_join(bars, cal, ["date"])
    return df.withColumns({n: F.max(c).over(w.rangeBetween(k, k)) for n, (c, k) in wanted.items()})


def _daily(picked: DataFrame, cal: DataFrame, ret: str, cost: float, lo: int, hi: int) -> DataFrame:
    """Mean pick return per date on the calendar; dates without a valid pick earn 0 and pay nothing."""
    per = picked.where(F.col(ret).isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("n_picks"), F.avg(ret).alias("gross_ret"))
    days = cal.where((F.col("idx") >= lo) & (F.col("idx") < F.col("n_dates") - hi)).select("date")
    j = days.join(per, "date", "left").fillna({"n_picks": 0, "gross_ret": 0.0})
    return j.withColumn("net_ret", F.col("gross_ret") - F.when(F.col("n_picks") > 0, float(cost)).otherwise(0.0))


def daily_picks(
    bars: DataFrame, score: str, *, picks: int = 20, entry: str = "close_t", exit_: str = "open_t1", cost: float = 0.0025, warmup: int = 60
) -> DataFrame:
    """Top-N by score every date; entry at close[T] or open[T+1], exit at open[T+1] or open[T+2]."""
    cal = market_calendar(bars)
    k = {"open_t1": 1, "open_t2": 2}[exit_]
    df = with_calendar_leads(bars, cal, {"_o1": ("open", 1), "_o2": ("open", 2)})
    e = F.col("close") if entry == "close_t" else F.col("_o1")
    df = df.withColumn("_ret", F.when(e > 0, F.col(f"_o{k}") / e - 1.0))
    top = top_k(df.where(F.col(score).isNotNull()), ["date"], [F.desc(score), F.asc("code")], picks)
    return _daily(top, cal, "_ret", cost, warmup, k)


def hold_return(bars: DataFrame, cal: DataFrame, hold: int, stop: float | None) -> DataFrame:
    """Return of buying at open[T+1] and selling at open[T+1+hold], or the stop if a low breaks it after entry."""
    df = with_calendar_leads(bars, cal, {"_in": ("open", 1), "_out": ("open", 1 + hold)})
    w = Window.partitionBy("code").orderBy("idx")
    plain = F.col("_out") / F.col("_in") - 1.0
    ret = plain
    if stop is not None:
        low = F.min("low").over(w.rangeBetween(2, 1 + hold))
        ret = F.when(low < F.col("_in") * (1.0 + stop), F.lit(float(stop))).otherwise(plain)
    return df.withColumn("hold_ret", F.when(F.col("_in") > 0, ret)).drop("_in", "_out")


def multi_day_picks(bars: DataFrame, score: str, *, picks: int = 20, hold: int = 3, stop: float | None = -0.05, cost: float = 0.0025, warmup: int = 60) -> DataFrame:
    cal = market_calendar(bars)
    df = hold_return(bars, cal, hold, stop)
    top = top_k(df.where(F.col(score).isNotNull()), ["date"], [F.desc(score), F.asc("code")], picks)
    return _daily(top, cal, "hold_ret", cost, warmup, hold + 2)


def periodic_picks(bars: DataFrame, score: str, configs: Sequence[tuple[int, int]], *, stop: float | None = -0.05, cost: float = 0.0025, start: int = 0) -> DataFrame:
    """Rebalance every R-th date for every (rebalance, picks) configuration, in one job.

    Pool rows (at most the largest pick count per date) are multiplied by the
    listed configurations; the hold return of each distinct R is one column.
    """
    cal = market_calendar(bars)
    df = calendar_join(bars, cal, ["date"])
    w = Window.partitionBy("code").orderBy("idx")
    rebs = sorted({rb for rb, _ in configs})
    base = F.max("open").over(w.rangeBetween(1, 1))
    df = df.withColumn("_in", base)
    cols = {}
    for rb in rebs:
        plain = F.max("open").over(w.rangeBetween(1 + rb, 1 + rb)) / F.col("_in") - 1.0
        low = F.min("low").over(w.rangeBetween(2, 1 + rb))
        ret = plain if stop is None else F.when(low < F.col("_in") * (1.0 + stop), F.lit(float(stop))).otherwise(plain)
        cols[f"_r{rb}"] = F.when(F.col("_in") > 0, ret)
    df = df.withColumns(cols)
    most = max(k for _, k in configs)
    pool = top_k(df.where(F.col(score).isNotNull()), ["date"], [F.desc(score), F.asc("code")], most)
    conf = F.array(*[F.struct(F.lit(rb).alias("rebalance"), F.lit(k).alias("picks"), F.col(f"_r{rb}").alias("ret")) for rb, k in configs])
    rows = pool.select("date", "idx", "rank", F.explode(conf).alias("c")).select("date", "idx", "rank", "c.*")
    rows = rows.where(((F.col("idx") - start) % F.col("rebalance") == 0) & (F.col("rank") <= F.col("picks")) & F.col("ret").isNotNull())
    per = rows.groupBy("rebalance", "picks", "date").agg(F.count(F.lit(1)).alias("n_picks"), F.avg("ret").alias("gross_ret"))
    conf_days = cal.select("date", "idx", "n_dates", F.explode(F.array(*[F.struct(F.lit(rb).alias("rebalance"), F.lit(k).alias("picks")) for rb, k in configs])).alias("c")).select("date", "idx", "n_dates", "c.*")
    days = conf_days.where((F.col("idx") >= start) & ((F.col("idx") - start) % F.col("rebalance") == 0) & (F.col("idx") + 1 + F.col("rebalance") < F.col("n_dates")))
    j = days.join(per, ["rebalance", "picks", "date"], "left").fillna({"n_picks": 0, "gross_ret": 0.0})
    return j.select("rebalance", "picks", "date", "n_picks", "gross_ret", (F.col("gross_ret") - F.when(F.col("n_picks") > 0, float(cost)).otherwise(0.0)).alias("net_ret"))


def overlay_picks(
    bars: DataFrame, score: str, ladder: DataFrame, *, hold: int = 5, stop: float | None = -0.05, cost: float = 0.0025, full: tuple[int, float] = (5, 1.0),
) -> DataFrame:
    """Periodic picks under a valuation ladder (date, n_picks, budget): date, n_picks, gross_ret, net_ret, regime.

    Every ``hold`` dates the first ``n_picks`` symbols by score are bought at the
    next open and sold ``hold`` dates later; returns and costs are scaled by the
    budget.  A date without a ladder row has ``full``.  No picks are made with
    ``n_picks`` 0 ("empty"), without scored symbols ("no_data"), with fewer than
    wanted ("insufficient"), or when none of them has both prices ("no_valid").
    """
    cal = market_calendar(bars)
    most = max(full[0], int(ladder.agg(F.coalesce(F.max("n_picks"), F.lit(0))).first()[0]))
    ladder = ladder.select("date", F.col("n_picks").alias("_want"), F.col("budget").cast("double").alias("_budget"))
    pool = hold_return(bars, cal, hold, stop).where(F.col(score).isNotNull())
    n = pool.groupBy("date").agg(F.count(F.lit(1)).alias("_pool"))
    top = calendar_join(top_k(pool, ["date"], [F.desc(score), F.asc("code")], most), ladder, ["date"])
    chosen = top.where((F.col("rank") <= F.coalesce("_want", F.lit(full[0]))) & F.col("hold_ret").isNotNull())
    per = chosen.groupBy("date").agg(F.count(F.lit(1)).alias("_n"), F.avg("hold_ret").alias("_ret"))
    days = cal.where((F.col("idx") % hold == 0) & (F.col("idx") + 1 + hold < F.col("n_dates"))).select("date")
    for side in (ladder, n, per):
        days = days.join(side, "date", "left")
    want, budget = F.coalesce("_want", F.lit(full[0])), F.coalesce("_budget", F.lit(float(full[1])))
    regime = (
        F.when(want == 0, "empty").when(F.col("_pool").isNull(), "no_data").when(F.col("_pool") < want, "insufficient")
        .when(F.col("_n").isNull(), "no_valid").when(budget >= 0.99, "normal").otherwise("light"))
    made = regime.isin("normal", "light")
    gross = F.when(made, F.col("_ret") * budget).otherwise(0.0)
    return days.select(
        "date", F.when(made, F.col("_n")).otherwise(0).alias("n_picks"), gross.alias("gross_ret"),
        (gross - F.when(made, budget * float(cost)).otherwise(0.0)).alias("net_ret"), regime.alias("regime"))


def valuation_overlay(pe: str = "pe", pb: str = "pb", *, empty: tuple[float, float] = (35.0, 3.0), light: tuple[float, float] = (30.0, 2.6), picks: tuple[int, int] = (5, 3)) -> dict[str, Column]:
    """Picks count and budget share by market valuation; missing values do not trigger."""
    hot = F.coalesce(F.col(pe) > empty[0], F.lit(False)) | F.coalesce(F.col(pb) > empty[1], F.lit(False))
    warm = F.coalesce(F.col(pe) > light[0], F.lit(False)) | F.coalesce(F.col(pb) > light[1], F.lit(False))
    return {
        "n_picks": F.when(hot, 0).when(warm, picks[1]).otherwise(picks[0]),
        "budget": F.when(hot, 0.0).when(warm, 0.6).otherwise(1.0),
    }


def market_regime(index: DataFrame, *, ma: int = 200, bear: float = 0.95, vol_n: int = 20, panic: float = 0.35, dd_n: int = 60, drawdown: float = -0.15, periods: float = 252.0, key: str | None = None) -> DataFrame:
    """bear / panic / drawdown / normal per date; first match wins, normal before ``ma`` rows of history.

    The volatility uses the vol_n - 1 returns between the last vol_n closes.
    """
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy("date")
    df = index.withColumns({"_ret": change("close", 1, w), "_rn": F.row_number().over(w)})
    vol = F.stddev_samp("_ret").over(w.rowsBetween(-(vol_n - 2), 0)) * F.sqrt(F.lit(float(periods)))
    base = F.avg("close").over(w.rowsBetween(-(ma - 1), 0))
    label = (
        F.when(F.col("_rn") <= ma, "normal").when(F.col("close") < base * bear, "bear").when(vol > panic, "panic")
        .when(change("close", dd_n, w) < drawdown, "drawdown").otherwise("normal")
    )
    return df.withColumn("regime", label).drop("_ret", "_rn")


def vol_target(index: DataFrame, *, target: float = 0.2, n: int = 20, floor: float = 0.05, periods: float = 252.0, key: str | None = None) -> DataFrame:
    """min(target / max(realised vol, floor), 1); 1 before n rows of history."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy("date")
    df = index.withColumns({"_ret": change("close", 1, w), "_rn": F.row_number().over(w)})
    rv = F.stddev_samp("_ret").over(w.rowsBetween(-(n - 2), 0)) * F.sqrt(F.lit(float(periods)))
    scale = F.least(float(target) / F.greatest(rv, F.lit(floor)), F.lit(1.0))
    return df.withColumn("vol_scale", F.when(F.col("_rn") > n, scale).otherwise(1.0)).drop("_ret", "_rn")


def two_sleeves(df: DataFrame, active: str, passive: str, *, half: float = 0.5, order: str = "date", key: str | None = None) -> DataFrame:
    """50/50 mix rebalanced every period, and drifting sleeves with the active weight."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({
        "a_val": half * F.product(1.0 + F.col(active)).over(upto), "p_val": half * F.product(1.0 + F.col(passive)).over(upto)})
    df = df.withColumn("total", F.col("a_val") + F.col("p_val"))
    before = F.coalesce(F.lag("total", 1).over(w), F.lit(2 * half))
    return df.withColumns({
        "rebalanced": 0.5 * F.col(active) + 0.5 * F.col(passive), "drift_ret": F.col("total") / before - 1.0,
        "w_active": F.when(F.col("total") > 0, F.col("a_val") / F.col("total")).otherwise(0.0)})


def pick_accuracy(picks: DataFrame, index: DataFrame, *, limit: float = 25.0) -> DataFrame:
    """Returns after 1 and 5 bars, benchmark, alpha, artefact flag.

    ``picks``: code, date, price, t1, t5; ``index``: date, i0, i1, i5 (calendar table).
    """
    j = calendar_join(picks, index, ["date"])
    cols = {}
    for k in ("1", "5"):
        ret = (div(f"t{k}", "price") - 1.0) * 100.0
        bench = (div(f"i{k}", "i0") - 1.0) * 100.0
        cols |= {f"ret_t{k}": ret, f"bench_t{k}": bench, f"alpha_t{k}": ret - bench}
    big = lambda c: F.coalesce(F.abs(c) > limit, F.lit(False))
    cols["is_artifact"] = big(cols["ret_t1"]) | big(cols["ret_t5"])
    return j.withColumns(cols)


def monthly_track(picks: DataFrame, bars: DataFrame, capital: float = 50000.0) -> DataFrame:
    """Equal-weight month track: first to last close of the month, missing price flat, compounded.

    ``picks``: month, code (distinct).  One output row per month.
    """
    month = bars.where("close is not null").groupBy("code", F.trunc("date", "month").alias("month")).agg(
        F.min_by("close", "date").alias("_a"), F.max_by("close", "date").alias("_b"))
    j = picks.join(month, ["code", "month"], "left")
    ret = F.when(F.col("_a") > 0, F.col("_b") / F.col("_a") - 1.0).otherwise(0.0)
    per = j.groupBy("month").agg(F.avg(ret).alias("monthly_return"), F.count(F.lit(1)).alias("n_picks"))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    per = per.withColumn("_cum", F.product(1.0 + F.col("monthly_return")).over(w))
    return per.select(
        "month", "n_picks", "monthly_return", (F.col("_cum") - 1.0).alias("cum_return"), (capital * F.col("_cum")).alias("end_value"),
        (capital * F.col("_cum") / (1.0 + F.col("monthly_return"))).alias("start_value"))


def daily_curve(track: DataFrame) -> DataFrame:
    """Linear interpolation between start and end value over the weekdays of each track row.

    ``track``: start_date, end_date, start_value, end_value.  Same-day rows keep
    the end value; spans without a weekday give their two ends; later rows win.
    """
    days = F.filter(F.sequence("start_date", "end_date"), lambda d: F.weekday(d) < 5)
    df = track.withColumn("_days", days)
    n = F.size("_days")
    step = (F.coalesce("end_value", "start_value") - F.col("start_value")) / F.greatest(n - 1, F.lit(1))
    end = F.coalesce("end_value", "start_value")
    one = F.array(F.struct(F.col("start_date").alias("date"), end.alias("v")))
    two = F.array(F.struct(F.col("start_date").alias("date"), F.col("start_value").alias("v")), F.struct(F.col("end_date").alias("date"), end.alias("v")))
    many = F.transform("_days", lambda d, i: F.struct(d.alias("date"), (F.col("start_value") + step * i).alias("v")))
    pts = F.when(F.col("start_date") == F.col("end_date"), one).when(n == 0, two).otherwise(many)
    rows = df.select("start_date", F.posexplode(pts).alias("i", "p"))
    return rows.groupBy(F.col("p.date").alias("date")).agg(F.max_by("p.v", F.struct("start_date", "i")).alias("portfolio_value"))


def adaptive_k(df: DataFrame, score: str, *, normal: int = 8, tight: int = 3, pool: int = 4) -> DataFrame:
    """Picks per date shrink as the spread of the leading z-scores grows; returns the picked rows with ``k``."""
    stats = df.where(F.col(score).isNotNull()).groupBy("date").agg(F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    top = top_k(df.where(F.col(score).isNotNull()), ["date"], [F.desc(score), F.asc("code")], normal * pool)
    top = calendar_join(top, stats, ["date"])
    w = Window.partitionBy("date")  # at most normal * pool rows per date
    z = div(F.col(score) - F.col("_m"), "_s")
    top = top.withColumn("_z", z).withColumns({"z_std": F.stddev_samp("_z").over(w), "_n": F.count("_z").over(w)})
    part = (F.col("z_std") - 0.5) / 0.5
    k = F.when((F.col("_n") <= 3) | F.col("z_std").isNull(), normal).when(F.col("z_std") >= 1.0, tight).when(F.col("z_std") <= 0.5, normal).otherwise(
        F.greatest(F.lit(tight), F.rint(normal - part * (normal - tight)).cast("int")))
    return top.withColumn("k", k).where(F.col("rank") <= F.col("k")).drop("_m", "_s", "_z", "_n")


