"""Factor library: columns per (code, date) from bars and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.formula import cross_strict
from barloom.functions.frames import (
    change, div, full, lag, max_n, mean_n, min_n, prior, running, series, std_n, sum_n, trail,
)
from barloom.operators import indicators as I
from barloom.operators import recur as R
from barloom.operators import panels
from barloom.operators.joins import asof, interval_sums
from barloom.operators.ranking import calendar_join, global_quantiles, quantiles, with_global
from barloom.sources.sinks import publish


def _moves(bars: DataFrame) -> DataFrame:
    pc = lag("close")
    df = bars.withColumn("_pc", F.when((pc > 0) & (F.col("open") > 0), pc))
    p = F.col("_pc")
    amp = (F.col("high") - F.col("low")) / p
    delta = F.col("close") - p
    zero = F.lit(0.0)
    return df.withColumns({
        "_amp": amp,
        "_up": F.when(p.isNotNull(), F.greatest(delta, zero)) / p * amp,
        "_dn": F.when(p.isNotNull(), F.greatest(-delta, zero)) / p * amp,
        "_tc": (F.col("close") / F.when(p.isNotNull(), F.col("open")) - 1.0) * (F.col("open") / p - 1.0),
    })


_MOVES = ["_pc", "_amp", "_up", "_dn", "_tc"]


def amplitude_imbalance(bars: DataFrame, *ns: int) -> DataFrame:
    """(upward - downward amplitude) / total amplitude over n bars."""
    df = _moves(bars)
    outs = {}
    for n in ns:
        total = sum_n("_amp", n)
        outs[f"amp_imb_{n}"] = F.when(total > 0, (sum_n("_up", n) - sum_n("_dn", n)) / total)
    return df.withColumns(outs).drop(*_MOVES)


def price_action(bars: DataFrame, n: int) -> DataFrame:
    """Amplitude imbalance and team coin over n bars from one set of moves."""
    df = _moves(bars)
    total = sum_n("_amp", n)
    return df.withColumns({
        f"amp_imb_{n}": F.when(total > 0, (sum_n("_up", n) - sum_n("_dn", n)) / total), f"team_coin_{n}": sum_n("_tc", n),
    }).drop(*_MOVES)


def team_coin(bars: DataFrame, *ns: int) -> DataFrame:
    """Sum of intraday return times overnight return over n bars."""
    df = _moves(bars)
    return df.withColumns({f"team_coin_{n}": sum_n("_tc", n) for n in ns}).drop(*_MOVES)


def overnight_gap() -> Column:
    """Opening gap against the previous close, percent."""
    pc = lag("close")
    return div(F.col("open") - pc, pc) * 100.0


def internal_bar_strength(bars: DataFrame, *ns: int) -> DataFrame:
    """Close position in the day's range, and its mean over the n rows before."""
    df = bars.withColumn("ibs", div(F.col("close") - F.col("low"), F.col("high") - F.col("low")))
    return df.withColumns({f"ibs_{n}": full(F.avg("ibs"), "ibs", n, prior(n)) for n in ns})


def amihud(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean of |return| per traded value over the n rows before."""
    df = bars.withColumn("_ill", div(F.abs(change("close")), F.col("close") * F.col("volume")))
    return df.withColumn(f"amihud_{n}", full(F.avg("_ill"), "_ill", n, prior(n))).drop("_ill")


def high_distance(n: int) -> Column:
    """Distance of the close to the highest close of the n rows before."""
    top = full(F.max("close"), "close", n, prior(n))
    return div(F.col("close") - top, top)


def idiosyncratic_vol(bars: DataFrame, n: int = 20) -> DataFrame:
    """Rolling deviation of returns in excess of the market mean of the date."""
    df = bars.withColumn("_ret", change("close"))
    means = df.groupBy("date").agg(F.avg("_ret").alias("_mkt"))
    df = calendar_join(df, means, ["date"]).withColumn("_ex", F.col("_ret") - F.col("_mkt"))
    return df.withColumn(f"idio_vol_{n}", std_n("_ex", n)).drop("_ret", "_mkt", "_ex")


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    step = F.col("close") - lag("close")
    df = bars.withColumns({
        "_gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))),
        "_loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))),
    })
    df = R.recur(df, [R.Ewm("_ag", "_gain", 1 / n, min_periods=n), R.Ewm("_al", "_loss", 1 / n, min_periods=n)])
    return df.withColumn("rsi_wilder", 100.0 - 100.0 / (1.0 + div("_ag", "_al"))).drop("_gain", "_loss", "_ag", "_al")


def bollinger_position(n: int = 20) -> Column:
    return div(F.col("close") - mean_n("close", n), std_n("close", n))


def williams_r(n: int = 14) -> Column:
    hi, lo = max_n("high", n), min_n("low", n)
    return div(hi - F.col("close"), hi - lo) * -100.0


def money_flow_index(bars: DataFrame, n: int = 14) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    df = bars.withColumn("_tp", typical)
    df = df.withColumn("_dt", F.col("_tp") - lag("_tp"))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumns({
        "_pos": F.when(F.col("_dt") > 0, flow).otherwise(0.0),
        "_neg": F.when(F.col("_dt") < 0, flow).otherwise(0.0),
    })
    return df.withColumn("mfi", 100.0 - 100.0 / (1.0 + div(sum_n("_pos", n), sum_n("_neg", n)))).drop("_tp", "_dt", "_pos", "_neg")


def obv_slope(bars: DataFrame, n: int = 60) -> DataFrame:
    """Slope of cumulative signed volume over the last n rows."""
    step = F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0))
    df = bars.withColumns({"_sv": step * F.col("volume"), "_rn": F.row_number().over(series())})
    df = df.withColumn("_obv", F.sum("_sv").over(running()))
    slope = F.regr_slope(F.col("_obv"), F.col("_rn")).over(trail(n))
    return df.withColumn(f"obv_slope_{n}", F.when(F.col("_rn") >= n, slope)).drop("_sv", "_rn", "_obv")


def realized_vol(bars: DataFrame, *ns: int) -> DataFrame:
    ret = F.when(lag("close") > 0, change("close"))
    df = bars.withColumn("_sq", ret * ret)
    return df.withColumns({f"rv_{n}": F.sqrt(sum_n("_sq", n)) for n in ns}).drop("_sq")


def clip_quantiles(df: DataFrame, cols: Sequence[str], lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Clip each column at its own exact global quantiles, all taken from the unclipped rows in one pass."""
    sides = {f"_{side}_{c}": (c, p) for c in cols for side, p in (("lo", lo), ("hi", hi))}
    clipped = with_global(df, global_quantiles(df, sides))
    cut = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_hi_{c}")), F.col(f"_lo_{c}")))
    return clipped.withColumns({c: cut(c) for c in cols}).drop(*sides)


def max_returns(bars: DataFrame, n: int = 20, short: int = 5, top: int = 5) -> DataFrame:
    """Best past returns (rows before the current one) and the mean of the best few."""
    df = bars.withColumn("_ret", change("close"))
    best = F.slice(F.sort_array(F.collect_list("_ret").over(prior(n)), asc=False), 1, top)
    mean_best = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / float(top)
    return df.withColumns({
        f"max_{short}": full(F.max("_ret"), "_ret", short, prior(short)),
        f"max_{n}": full(F.max("_ret"), "_ret", n, prior(n)),
        f"max_top{top}_{n}": F.when(F.count("_ret").over(prior(n)) >= n, mean_best),
    }).drop("_ret")


def volume_z(bars: DataFrame, ns: Sequence[int] = (5, 20, 60), changes: Sequence[int] = (5, 20)) -> DataFrame:
    v = F.col("volume").cast("double")
    df = bars.withColumn("_v", v)
    outs = {
        f"vol_z_{n}": div(F.col("_v") - full(F.avg("_v"), "_v", n, prior(n)), full(F.stddev_samp("_v"), "_v", n, prior(n)))
        for n in ns
    }
    outs |= {f"vol_chg_{n}": change("_v", n) for n in changes}
    return df.withColumns(outs).drop("_v")


def industry_adjusted(bars: DataFrame, industry: DataFrame, ns: Sequence[int] = (5, 20, 60)) -> DataFrame:
    """Market-calendar return less the mean of the industry at the date.

    Industry means are a pre-aggregated table of (dates x industries) rows.
    """
    df = I.calendar_offsets(bars, {f"_c{n}": -n for n in ns})
    df = df.join(industry.select("code", "industry"), "code")
    df = df.withColumns({f"ret_{n}": F.when(F.col(f"_c{n}") > 0, F.col("close") / F.col(f"_c{n}") - 1.0) for n in ns})
    means = df.groupBy("date", "industry").agg(*[F.avg(f"ret_{n}").alias(f"_m{n}") for n in ns])
    df = df.join(means, ["date", "industry"], "left")
    return df.withColumns({f"adj_ret_{n}": F.col(f"ret_{n}") - F.col(f"_m{n}") for n in ns}).drop(
        *[f"_c{n}" for n in ns], *[f"_m{n}" for n in ns])


def collapse_events(events: DataFrame, keys: Sequence[str] = ("code", "date")) -> DataFrame:
    """Several reasons of one day to one row, with shares of the traded amount."""
    df = events.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("net_amt", "buy_amt", "sell_amt")],
        *[F.max(c).alias(c) for c in ("accum_amount", "turnover_pct", "change_rate")],
        F.count("reason").alias("n_reasons"),
    )
    base = F.when(F.col("accum_amount") > 0, F.col("accum_amount"))
    return df.withColumns({
        "net_buy_pct": F.col("net_amt") / base * 100.0,
        "top_buyer_pct": F.col("buy_amt") / base * 100.0,
        "top_seller_pct": F.col("sell_amt") / base * 100.0,
    })


def event_features(daily: DataFrame, keys: DataFrame, calendar: DataFrame, ns: Sequence[int] = (30, 60), avg_n: int = 30) -> DataFrame:
    """Per-day event features: flag, rolling counts and sums (10k units), rolling mean share, from runs of trailing sums."""
    sparse = daily.select("code", "date", F.lit(1).alias("on_list"), "net_amt", F.col("net_buy_pct").alias("net_buy_evt"))
    sums = {"on_list": ("on_list", 1), "net_amt": ("net_amt", 1), "net_buy_evt": ("net_buy_evt", 1), "_avg": ("net_buy_evt", avg_n)}
    sums |= {f"count_{n}": ("on_list", n) for n in ns} | {f"net_sum_{n}_wan": ("net_amt", n) for n in ns}
    panel, cal = panels.trailing(keys, calendar, sparse, sums)
    panel = panel.fillna(0, subset=list(sums)).withColumns({f"net_sum_{n}_wan": F.col(f"net_sum_{n}_wan") / 1e4 for n in ns} | {"on_list": F.col("on_list").cast("int")})
    out = panels.expand(panel, cal)
    return out.withColumn(f"net_buy_evt_avg_{avg_n}", F.col("_avg") / panels.within("place", avg_n)).drop("_avg", "place")


def margin_features(margin: DataFrame) -> DataFrame:
    """Balance changes over rows, log balances, repay ratio; input has balance, buy, repay."""
    one = F.lit(1.0)
    df = margin.withColumns({
        "chg_5": change("balance", 5), "chg_20": change("balance", 20),
        "log_balance": F.log(F.greatest(F.col("balance"), one)),
        "log_buy_5": F.log(F.greatest(F.avg("buy").over(trail(5)), one)),
        "buy_chg_5": change("buy", 5),
        "repay_ratio": div("repay", "buy"),
    })
    return df.withColumn("chg_5_minus_20", F.col("chg_5") - F.col("chg_20"))


def fund_flow_shares(raw: DataFrame) -> DataFrame:
    """Net main flow (two largest order classes) and shares of the total, null when there is none."""
    total = F.when(F.col("total") > 0, F.col("total"))
    return raw.withColumn("net_main", F.col("r0_net") + F.col("r1_net")).withColumns({
        "pct_super_big": F.col("r0_net") / total,
        "pct_main": (F.col("r0_net") + F.col("r1_net")) / total,
    })


def fund_flow_features(flow: DataFrame, ns: Sequence[int] = (5, 10, 20)) -> DataFrame:
    prev = lag("r0_net", 5)
    outs = {f"pct_super_big_{n}": mean_n("pct_super_big", n) for n in ns}
    outs["net_super_big_chg_5"] = F.when(F.abs(prev) > 0, (F.col("r0_net") - prev) / F.abs(prev))
    outs["main_ratio_5"] = mean_n("pct_main", 5)
    return flow.withColumns(outs)


def holder_runs(reports: DataFrame, keys: DataFrame, cal: DataFrame, *, keep: int = 6, max_age: int = 365) -> DataFrame:
    """Runs of what is known of a symbol's holders: newest announcement, sums of changes over half a year and a year.

    They change where an announcement appears, leaves a span or grows too old.
    """
    w = Window.partitionBy("code").orderBy("announce_date").rowsBetween(-(keep - 1), 0)
    known = reports.withColumn("hist", F.collect_list(F.struct(F.col("announce_date").alias("d"), F.col("change_pct").alias("p"))).over(w))
    value = F.struct(F.col("announce_date").alias("at"), "change_pct", "avg_holding", "hist")
    points = known.select("code", F.col("announce_date").alias("day"), value.alias("v"))
    for k in (183, 366, max_age + 1):
        points = points.unionByName(known.select("code", F.date_add("announce_date", k).alias("day")), allowMissingColumns=True)
    points = panels.place_from(points, cal, "day")
    upto = Window.partitionBy("code").orderBy("place", "day", F.col("v").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("code", "place").orderBy(F.desc("day"), F.col("v").isNull())
    points = points.withColumns({"v": F.last("v", ignorenulls=True).over(upto), "_k": F.row_number().over(last)}).where("_k = 1")
    points = points.join(F.broadcast(cal.select("place", "date")), "place")
    fresh = F.datediff("date", "v.at") <= max_age

    def total(days: int) -> Column:
        recent = F.filter("v.hist", lambda h: (h["d"] > F.date_sub("date", days)) & h["p"].isNotNull())
        return F.when(fresh & (F.size(recent) > 0), F.aggregate(recent, F.lit(0.0), lambda a, h: a + h["p"]))

    points = points.select(
        "code", "place", F.when(fresh, F.col("v.change_pct")).alias("change_3m"), total(183).alias("change_6m"), total(366).alias("change_12m"),
        F.when(fresh, F.col("v.avg_holding")).alias("avg_holding"), F.when(fresh, F.col("v.at")).alias("at"))
    return panels.runs(keys, cal, points, ["change_3m", "change_6m", "change_12m", "avg_holding", "at"])


def holder_features(reports: DataFrame, keys: DataFrame, calendar: DataFrame, *, keep: int = 6, max_age: int = 365) -> DataFrame:
    """Holder-count changes known at each calendar date.

    ``reports`` is unique on (code, announce_date) with change_pct and
    avg_holding; sums look at the newest ``keep`` announcements only.
    """
    cal = panels.places(calendar)
    df = panels.expand(holder_runs(reports, keys, cal, keep=keep, max_age=max_age), cal)
    # the medians read the expanded rows several times: write them once, cut the lineage
    df = publish(df.withColumn("age_days", F.coalesce(F.datediff("date", "at"), F.lit(-1))).drop("at", "place"), "holders")
    med = quantiles(df, ["date"], "avg_holding", {"_med": 0.5})
    df = calendar_join(df, med, ["date"])
    return df.withColumn("concentration", 1.0 - div("avg_holding", "_med")).drop("_med")


def quarterly_eps(fund: DataFrame) -> DataFrame:
    """Single-quarter earnings from year-to-date figures, trailing four quarters, last annual.

    ``fund``: code, report_date, eps_ytd, bps.
    """
    y, m = F.year("report_date"), F.month("report_date")
    df = fund.withColumns({"_y": y, "_q": m})
    in_year = Window.partitionBy("code", "_y").orderBy("report_date")
    df = df.withColumn("eps_q", F.when(F.col("_q") == 3, F.col("eps_ytd")).otherwise(F.col("eps_ytd") - F.lag("eps_ytd", 1).over(in_year)))
    by_report = Window.partitionBy("code").orderBy("report_date")
    upto = by_report.rowsBetween(Window.unboundedPreceding, 0)
    # the last four known quarters end at a known report and hold until the next one
    known = Window.partitionBy("code", F.col("eps_q").isNull()).orderBy("report_date").rowsBetween(-3, 0)
    df = df.withColumn("_four", F.when(F.col("eps_q").isNotNull(), F.struct(
        F.when(F.count("eps_q").over(known) == 4, F.sum("eps_q").over(known)).alias("s"))))
    return df.withColumns({
        "ttm_eps": F.last("_four", ignorenulls=True).over(upto)["s"],
        "annual_eps": F.last(F.when(F.col("_q") == 12, F.struct("eps_ytd")), ignorenulls=True).over(upto)["eps_ytd"],
    }).drop("_y", "_four")


def valuation_ratios(price: Column | str = "close") -> dict[str, Column]:
    """Null when the denominator is missing or not positive."""
    p = F.col(price) if isinstance(price, str) else price
    ratio = lambda c: F.when(F.col(c) > 0, p / F.col(c))
    return {"pe_static": ratio("annual_eps"), "pe_ttm": ratio("ttm_eps"), "pb": ratio("bps")}


def rating_revisions(reports: DataFrame, grid: DataFrame) -> DataFrame:
    """Analyst-report factors over trailing calendar spans (strictly before the date).

    ``reports``: code, date, score (nullable), last_score (nullable).
    """
    d = F.col("score") - F.col("last_score")
    one = lambda c: F.when(c, 1)
    measures = {
        "n": F.lit(1), "rated": one(F.col("score").isNotNull()), "sum": F.col("score"),
        "pos": one(F.col("score") >= 1), "neg": one(F.col("score") <= -1),
        "upg": one(d > 0), "dng": one(d < 0), "dsum": d, "dn": one(d.isNotNull()),
    }
    spans = {"30": (-30, -1), "30_60": (-60, -31), "90": (-90, -1), "90_180": (-180, -91)}
    df = interval_sums(grid, reports, measures, spans)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    outs: dict[str, Column] = {}
    for s, before in (("30", "30_60"), ("90", "90_180")):
        mean = div(f"sum_{s}", f"rated_{s}")
        rated = zero(f"rated_{s}") > 0
        outs |= {
            f"n_reports_{s}d": zero(f"n_{s}"),
            f"avg_rating_{s}d": mean,
            f"rating_chg_{s}d": mean - div(f"sum_{before}", f"rated_{before}"),
            f"up_pct_{s}d": F.when(rated, zero(f"pos_{s}") / F.col(f"rated_{s}")),
            f"net_up_{s}d": zero(f"pos_{s}") - zero(f"neg_{s}"),
            f"n_upgrade_{s}d": zero(f"upg_{s}"),
            f"n_downgrade_{s}d": zero(f"dng_{s}"),
            f"net_revision_{s}d": zero(f"upg_{s}") - zero(f"dng_{s}"),
            f"mean_delta_{s}d": div(f"dsum_{s}", f"dn_{s}"),
        }
    return df.select(*grid.columns, *[c.alias(n) for n, c in outs.items()])


def macd_crosses(bars: DataFrame) -> DataFrame:
    """MACD histogram, its strict golden cross, and the same-bar triple cross with KDJ and MA5/MA10."""
    df = I.rsv(bars, 9)
    steps = [*R.macd_steps(), *R.kdj_steps("rsv", 1 / 9, 1 / 9, skip_null=True)]
    df = R.recur(df, steps, keep=["dif", "dea", "hist", "k", "d"])
    df = df.withColumns({"_ma5": mean_n("close", 5), "_ma10": mean_n("close", 10)})
    df = df.withColumns({
        "macd_cross": cross_strict("dif", "dea"), "_kd": cross_strict("k", "d"), "_mc": cross_strict("_ma5", "_ma10"),
    })
    known = F.col("macd_cross").isNotNull() & F.col("_kd").isNotNull() & F.col("_mc").isNotNull()
    all3 = (F.col("macd_cross") == 1) & (F.col("_kd") == 1) & (F.col("_mc") == 1)
    return df.withColumn("triple_cross", F.when(known, F.when(all3, 1.0).otherwise(0.0))).drop(
        "rsv", "dif", "dea", "k", "d", "_ma5", "_ma10", "_kd", "_mc").withColumnRenamed("hist", "macd_hist")


FEATURES_12 = ["ret_1", "ret_5", "ret_20", "rsi_14", "bias_6", "macd_hist", "kdj_k", "kdj_d", "kdj_j", "atr_14", "sma_ratio", "vol_z"]


def model_features(bars: DataFrame) -> DataFrame:
    """The twelve-column model frame; recursions first, then all windows in one sort."""
    df = I.rsv(bars, 9)
    df = R.recur(df, [*R.macd_steps(), *R.kdj_steps()], keep=["hist", "k", "d", "j"])
    df = I.rsi(df, 14, out="rsi_14")
    df = I.atr(df, 14, out="atr_14")
    v = F.col("volume").cast("double")
    return df.withColumns({
        "ret_1": change("close", 1), "ret_5": change("close", 5), "ret_20": change("close", 20),
        "bias_6": I.bias("close", 6),
        "sma_ratio": div(mean_n("close", 5), mean_n("close", 20)) - 1.0,
        "vol_z": div(v - mean_n(v, 20), std_n(v, 20)),
    }).withColumnsRenamed({"hist": "macd_hist", "k": "kdj_k", "d": "kdj_d", "j": "kdj_j"}).drop("rsv")


FEATURES_18 = [
    "ret_1d", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "intraday", "ma5_dist", "ma20_dist", "ma60_dist",
    "ma5_ma10", "vol10", "vol20", "vol_ratio", "rsi", "bb_pos", "macd", "turnover", "mkt_cap",
]


def picker_features(bars: DataFrame, horizon: int = 5, *, ma_long: int = 60, min_turnover: float = 0.005) -> DataFrame:
    """Eighteen-column frame, momentum score and forward label.

    ``bars`` carries ``shares`` outstanding.  Unknown forward returns give a
    null label.  Rows with any missing feature or label are dropped.
    """
    c, o, h, lo = (F.col(x) for x in ("close", "open", "high", "low"))
    v = F.col("volume").cast("double")
    steps = [
        R.Ewm("_e12", "close", 2 / 13, adjust=True), R.Ewm("_e26", "close", 2 / 27, adjust=True),
        R.Combine("_m", lambda x: x["_e12"] - x["_e26"]), R.Ewm("_s", "_m", 2 / 10, adjust=True),
        R.Combine("macd", lambda x: x["_m"] - x["_s"]),
    ]
    df = R.recur(bars, steps, keep=["macd"])
    step = c - lag("close")
    df = df.withColumns({
        "ret_1d": change("close", 1), "_up": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))),
        "_dn": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))),
        "_ma5": mean_n("close", 5), "_ma10": mean_n("close", 10), "_ma20": mean_n("close", 20), "_mal": mean_n("close", ma_long),
        "_sd20": std_n("close", 20),
    })
    df = df.withColumns({
        **{f"ret_{k}d": change("close", k) for k in (3, 5, 10, 20)},
        "intraday": (c - o) / o,
        "ma5_dist": div(c - F.col("_ma5"), "_ma5"), "ma20_dist": div(c - F.col("_ma20"), "_ma20"),
        "ma60_dist": div(c - F.col("_mal"), "_mal"), "ma5_ma10": div(F.col("_ma5") - F.col("_ma10"), "_ma10"),
        "vol10": std_n("ret_1d", 10) * F.sqrt(F.lit(10.0)), "vol20": std_n("ret_1d", 20) * F.sqrt(F.lit(20.0)),
        "vol_ratio": div(v, mean_n(v, 20)),
        "rsi": 100.0 - 100.0 / (1.0 + div(mean_n("_up", 14), mean_n("_dn", 14))),
        "bb_pos": div(c - (F.col("_ma20") - 2.0 * F.col("_sd20")), 4.0 * F.col("_sd20")),
        "turnover": div(v, "shares"), "mkt_cap": F.col("shares") * c / 1e8,
        "target": F.when(I.forward_return(horizon).isNotNull(), F.when(I.forward_return(horizon) > 0, 1).otherwise(0)),
        "momentum": momentum_score(min_turnover=min_turnover),
    })
    return df.dropna(subset=[*FEATURES_18, "target"]).drop("_up", "_dn", "_ma5", "_ma10", "_ma20", "_mal", "_sd20")


def momentum_score(*, surge: float = 1.3, lo: float = 0.5, hi: float = 0.95, chg: tuple[float, float] = (0.01, 9.0),
                   ma: int = 20, min_turnover: float = 0.005) -> Column:
    """Volume surge x change x range position where every condition holds; needs ``shares``."""
    c, o = F.col("close"), F.col("open")
    v = F.col("volume").cast("double")
    move = change("close") * 100.0
    ratio = div(v, full(F.avg(v), v, 5, prior(5)))
    pos = div(c - F.col("low"), F.col("high") - F.col("low"))
    base = full(F.avg("close"), "close", ma, prior(ma))
    ok = (
        (c > o) & move.between(*chg) & (ratio > surge) & (c > base) & pos.between(lo, hi)
        & (div(v, "shares") > min_turnover)
    )
    return F.when(ok, ratio * move * pos)


def reversal_score(*, surge: float = 1.3, lo: float = 0.05, hi: float = 0.5, chg: tuple[float, float] = (-9.5, -2.0),
                   ma: int = 60, floor: float = 0.85, min_turnover: float = 0.005) -> Column:
    """Mirror image: a heavy down bar above a floor of its long average."""
    c, o = F.col("close"), F.col("open")
    v = F.col("volume").cast("double")
    move = change("close") * 100.0
    ratio = div(v, full(F.avg(v), v, 5, prior(5)))
    pos = div(c - F.col("low"), F.col("high") - F.col("low"))
    base = full(F.avg("close"), "close", ma, prior(ma))
    ok = (
        (c < o) & move.between(*chg) & (ratio > surge) & (c > base * floor) & pos.between(lo, hi)
        & (div(v, "shares") > min_turnover)
    )
    return F.when(ok, ratio * F.abs(move) * (1.0 - pos))


def pick_metrics(bars: DataFrame, need: int = 30) -> DataFrame:
    """Latest MA5, MA20, one-bar return, volume ratio of symbols with enough bars."""
    w = series()
    v = F.col("volume").cast("double")
    early = F.avg(v).over(w.rowsBetween(-(need - 1), -(need - 20)))
    df = bars.withColumns({
        "_n": F.row_number().over(w), "ma5": F.avg("close").over(trail(5)), "ma20": F.avg("close").over(trail(20)),
        "ret_1": F.coalesce(change("close"), F.lit(0.0)),
        "vol_ratio": F.coalesce(div(F.avg(v).over(trail(5)), early), F.lit(1.0)),
    })
    cols = ["ma5", "ma20", "close", "ret_1", "vol_ratio", "_n"]
    last = df.groupBy("code").agg(F.max_by(F.struct("date", *cols), "date").alias("x"))
    return last.where(F.col("x._n") >= need).select("code", "x.*").drop("_n").withColumnRenamed("close", "last_close")


def board_rotation(features: DataFrame, n: int = 5) -> DataFrame:
    """Lagged n-date mean of each board's mean one-bar return: date, board, board_score.

    The board table holds (dates x boards) rows.
    """
    daily = features.groupBy("date", "board").agg(F.avg("ret_1d").alias("_r"))
    w = Window.partitionBy("board").orderBy("date")
    return daily.withColumn(
        "board_score", full(F.avg("_r"), "_r", n, w.rowsBetween(-n, -1))
    ).drop("_r")


def in_top_boards(features: DataFrame, rotation: DataFrame, k: int = 3, fallback: Sequence[str] = ()) -> DataFrame:
    """Keep rows of the k best boards of their date; dates without scores use the fallback boards."""
    w = Window.partitionBy("date").orderBy(F.desc("board_score"), "board")
    scored = rotation.where(F.col("board_score").isNotNull())
    best = scored.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).groupBy("date").agg(F.collect_set("board").alias("_top"))
    df = calendar_join(features, best, ["date"])
    fall = F.col("board").isin(*fallback) if fallback else F.lit(True)
    return df.where(F.when(F.col("_top").isNull(), fall).otherwise(F.array_contains("_top", F.col("board")))).drop("_top")


def unlock_pressure(z20: str = "z_20", z60: str = "z_60") -> Column:
    """Negative mean of the two forward-supply z-scores (z-scored again by the caller)."""
    return -(F.col(z20) + F.col(z60)) / 2.0


def signed_log(c: Column | str, unit: float = 1e6) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.signum(x) * F.log1p(F.abs(x) / unit)
