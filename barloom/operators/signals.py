"""Trading signals: each adds ``entry`` and ``exit`` booleans to bars.

A signal is a function bars -> bars; ``REGISTRY`` maps names to functions, and
``df.transform(REGISTRY[name])`` applies one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import (
    change, div, falling_edge, false_if_null, lag, mean_n, rising_edge, series, std_n,
)
from barloom.operators import indicators as I
from barloom.operators import recur as R

Signal = Callable[..., DataFrame]
REGISTRY: dict[str, Signal] = {}


def signal(name: str) -> Callable[[Signal], Signal]:
    def add(fn: Signal) -> Signal:
        REGISTRY[name] = fn
        return fn

    return add


def _edges(df: DataFrame, enter: Column, leave: Column | None = None) -> DataFrame:
    """Entry when ``enter`` turns true; exit when ``leave`` turns true, or when ``enter`` ends."""
    out = {"entry": rising_edge(enter), "exit": falling_edge(enter) if leave is None else rising_edge(leave)}
    return df.withColumns(out)


@signal("sma_cross")
def sma_cross(bars: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    if fast >= slow:
        raise ValueError("fast must be shorter than slow")
    df = bars.withColumn("_above", mean_n("close", fast) > mean_n("close", slow))
    return _edges(df, F.col("_above")).drop("_above")


@signal("macd_cross")
def macd_cross(bars: DataFrame) -> DataFrame:
    df = I.macd(bars)
    return _edges(df, F.col("dif") > F.col("dea")).drop("dif", "dea", "hist")


@signal("rsi_threshold")
def rsi_threshold(bars: DataFrame, n: int = 14, lower: float = 30.0, upper: float = 70.0) -> DataFrame:
    df = I.rsi(bars, n, out="_rsi")
    return _edges(df, F.col("_rsi") < lower, F.col("_rsi") > upper).drop("_rsi")


@signal("kdj_cross")
def kdj_cross(bars: DataFrame) -> DataFrame:
    df = I.kdj(bars)
    above = F.col("k") > F.col("d")
    return df.withColumns({
        "entry": rising_edge(above) & false_if_null(F.col("k") < 80),
        "exit": falling_edge(above) & false_if_null(F.col("k") > 20),
    }).drop("k", "d", "j")


@signal("boll_reversion")
def boll_reversion(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    df = I.boll(bars, n, k)
    c = F.col("close")
    return _edges(df, c < F.col("boll_lower"), c > F.col("boll_mid")).drop("boll_lower", "boll_mid", "boll_upper")


@signal("boll_breakout")
def boll_breakout(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    df = I.boll(bars, n, k)
    c = F.col("close")
    return _edges(df, c > F.col("boll_upper"), c < F.col("boll_mid")).drop("boll_lower", "boll_mid", "boll_upper")


@signal("cci")
def cci(bars: DataFrame, n: int = 14, lower: float = -100.0, upper: float = 100.0) -> DataFrame:
    df = I.cci(bars, n, out="_cci")
    c, p = F.col("_cci"), lag("_cci")
    return df.withColumns({
        "entry": false_if_null((c > lower) & (p <= lower)), "exit": false_if_null((c < upper) & (p >= upper)),
    }).drop("_cci")


@signal("adx_trend")
def adx_trend(bars: DataFrame, n: int = 14, ema_n: int = 55, floor: float = 20.0) -> DataFrame:
    df = I.adx(I.ema(bars, "_ema", "close", ema_n), n)
    up = F.col("plus_di") > F.col("minus_di")
    bull = up & (F.col("adx") > floor) & (F.col("close") > F.col("_ema"))
    return _edges(df, bull, F.col("plus_di") < F.col("minus_di")).drop("_ema", "plus_di", "minus_di", "adx")


@signal("aroon")
def aroon(bars: DataFrame, n: int = 25, energy: float = 50.0) -> DataFrame:
    df = I.aroon(bars, n)
    up, down = F.col("aroon_up"), F.col("aroon_down")
    return _edges(df, (up > down) & (up + down >= energy)).drop("aroon_up", "aroon_down")


@signal("arbr")
def arbr(bars: DataFrame, n: int = 26, low: float = 50.0, high: float = 150.0) -> DataFrame:
    df = I.arbr(bars, n)
    a, b = F.col("ar"), F.col("br")
    return _edges(df, (a < low) & (b < low), (a > high) & (b > high)).drop("ar", "br")


@signal("stoch_rsi")
def stoch_rsi(bars: DataFrame, rsi_n: int = 14, n: int = 14, lower: float = 20.0, upper: float = 80.0) -> DataFrame:
    df = I.stoch_rsi(bars, rsi_n, n)
    return _edges(df, F.col("stoch_rsi") < lower, F.col("stoch_rsi") > upper).drop("stoch_rsi")


@signal("factor_momentum")
def factor_momentum(bars: DataFrame, mom_n: int = 20, vol_n: int = 20, lookback: int = 60, enter: float = 0.8, leave: float = 0.2) -> DataFrame:
    """Mean of three rolling z-scores against its own rolling quantiles."""
    z = lambda out, src, n: R.Rolled(out, src, n, R.standing)
    at = lambda out, p: R.Rolled(out, "_score", lookback, lambda w: np.quantile(w, p, axis=1))

    def inverse(windows: np.ndarray) -> np.ndarray:
        d = R.deviation(windows)
        return 1.0 / np.where(d > 0, d, np.nan)

    df = R.recur(bars, [
        R.Change("_r", "close"), R.Change("_mom", "close", mom_n), R.Rolled("_inv", "_r", vol_n, inverse), z("_vz", "volume", vol_n),
        z("_z0", "_mom", lookback), z("_z1", "_inv", lookback), z("_z2", "_vz", lookback), R.Combine("_score", lambda c: (c["_z0"] + c["_z1"] + c["_z2"]) / 3.0),
        at("_hi", enter), at("_lo", leave)], keep=["_score", "_hi", "_lo"])
    hi, lo = F.col("_hi"), F.col("_lo")
    df = df.withColumns({"_strong": F.col("_score") > hi, "_weak": F.col("_score") < lo})
    return _edges(df, F.col("_strong"), F.col("_weak")).drop("_score", "_hi", "_lo", "_strong", "_weak")


@signal("rsrs_timing")
def rsrs_timing(bars: DataFrame, n: int = 18, m: int = 600, buy: float = 0.7, sell: float = -0.7) -> DataFrame:
    df = I.rsrs(bars, n, m)
    return _edges(df, F.col("rsrs") > buy, F.col("rsrs") < sell).drop("slope", "rsrs")


@signal("ssa_trend")
def ssa_trend(bars: DataFrame, window: int = 30) -> DataFrame:
    df = I.ssa(bars, window)
    return _edges(df, F.col("close") > F.col("ssa")).drop("ssa")


@signal("rsi_divergence")
def rsi_divergence(bars: DataFrame, n: int = 14, order: int = 5) -> DataFrame:
    """Price and RSI extremes disagree, using only bars seen so far.

    A row is an extremum at bar i if it beats every neighbour within ``order``
    rows that exists by i.  So it turns active one bar later and stays so until
    a neighbour spoils it; after ``order`` bars it is final.  The last two
    active extrema of a bar are the active ones among the previous order-1 rows
    plus the last two final ones before them.
    """
    w = series()
    df = I.rsi(bars, n, out="_rsi").withColumn("_rn", F.row_number().over(w))
    kinds = {"pl": ("close", 1), "ph": ("close", -1), "rl": ("_rsi", 1), "rh": ("_rsi", -1)}
    first = {}
    for k, (c, s) in kinds.items():
        x = F.col(c) * float(s)
        left = F.col("_rn") > 1
        for j in range(1, order + 1):
            # a missing neighbour does not count, a missing value spoils
            left = left & ((F.col("_rn") <= j) | false_if_null(x < F.lag(x, j).over(w)))
        bad = F.lit(order + 1)
        for j in range(order, 0, -1):
            ahead = F.lead(F.struct(x.alias("v")), j).over(w)
            bad = F.when(ahead.isNotNull() & ~false_if_null(x < ahead["v"]), j).otherwise(bad)
        first[f"_f_{k}"] = F.when(false_if_null(left), bad).otherwise(0)  # 0: never an extremum
    df = df.withColumns(first)
    upto = lambda k: w.rowsBetween(Window.unboundedPreceding, -k)
    item = lambda c: F.struct(F.col("_rn").alias("p"), F.col(c).alias("v"))
    df = df.withColumns({
        f"_l_{k}": F.last(F.when(F.col(f"_f_{k}") == order + 1, item(c)), ignorenulls=True).over(upto(1)) for k, (c, _) in kinds.items()})
    recent = {}
    for k, (c, _) in kinds.items():
        items = [F.when(F.lag(f"_f_{k}", d).over(w) > d, F.lag(item(c), d).over(w)) for d in range(1, order)]
        pair = F.struct(item(c).alias("a"), F.col(f"_l_{k}").alias("b"))
        final = F.last(F.when(F.col(f"_f_{k}") == order + 1, pair), ignorenulls=True).over(upto(order))
        recent[f"_a_{k}"] = F.slice(F.array_compact(F.array(*items, final["a"], final["b"])), 1, 2)
    df = df.withColumns(recent)
    newest = lambda k: F.get(F.col(f"_a_{k}"), F.lit(0))["v"]
    older = lambda k: F.get(F.col(f"_a_{k}"), F.lit(1))["v"]
    ready = F.col("_rn") > 2 * order + n
    bull = ready & (newest("pl") < older("pl")) & (newest("rl") > older("rl")) & (F.col("_rsi") < 50)
    bear = ready & (newest("ph") > older("ph")) & (newest("rh") < older("rh")) & (F.col("_rsi") > 50)
    tmp = [c for c in df.columns if c.startswith("_")]
    return df.withColumns({"entry": false_if_null(bull), "exit": false_if_null(bear)}).drop(*tmp)


# Vote weights, normalised by their sum.
VOTE_WEIGHTS = {"BIAS": 0.10, "KDJ": 0.20, "RSI": 0.15, "BOLL": 0.25, "MACD": 0.20}
THRESHOLD, SLACK = 0.50, 1e-9


def fusion_inputs(bars: DataFrame) -> DataFrame:
    """All indicator columns of the five votes: one recursion pass, then windows."""
    df = I.rsv(bars, 9)
    df = R.recur(df, [*R.macd_steps(), *R.kdj_steps()], keep=["dif", "dea", "hist", "k", "d", "j"]).drop("rsv")
    df = I.boll(I.rsi(df, 14, out="rsi"), 20, 2.0)
    return df.withColumns({f"bias{n}": I.bias("close", n) for n in (5, 10, 20)})


def votes(df: DataFrame, *, latest_rule: bool = False) -> DataFrame:
    """Five votes in {-1, 0, 1}.

    The series rule treats "not above" as below; the latest-row rule needs a
    strict fall for a cross-down.
    """
    k, d, j = F.col("k"), F.col("d"), F.col("j")
    dif, dea, hist = F.col("dif"), F.col("dea"), F.col("hist")
    above, k_above = false_if_null(dif > dea), false_if_null(k > d)
    if latest_rule:
        below, k_below = dif < dea, k < d
        up, dn = above & (lag("dif") <= lag("dea")), below & (lag("dif") >= lag("dea"))
        kup, kdn = k_above & (lag("k") <= lag("d")), k_below & (lag("k") >= lag("d"))
    else:
        below = ~above
        up, dn = rising_edge(above), falling_edge(above)
        kup, kdn = rising_edge(k_above), falling_edge(k_above)
    vote = lambda buy, sell: F.when(false_if_null(buy), 1).when(false_if_null(sell), -1).otherwise(0)
    last_wins = lambda buy, sell: F.when(false_if_null(sell), -1).when(false_if_null(buy), 1).otherwise(0)
    b5, b10, b20 = F.col("bias5"), F.col("bias10"), F.col("bias20")
    rising, falling = hist > lag("hist"), hist < lag("hist")
    if latest_rule:
        v_kdj = F.when(false_if_null(kup & (k < 80)), 1).when(false_if_null(kdn & (k > 20)), -1).when(
            false_if_null((k < 20) & (j < 0)), 1).when(false_if_null((k > 80) & (j > 100)), -1).otherwise(0)
        v_macd = vote(up | (above & rising), dn | (below & falling))
    else:
        v_kdj = last_wins((kup & (k < 80)) | ((k < 20) & (j < 0)), (kdn & (k > 20)) | ((k > 80) & (j > 100)))
        v_macd = last_wins(up | (above & rising), dn | (below & falling))
    return df.withColumns({
        "v_bias": vote((b5 > b10) & (b10 > b20), (b5 < b10) & (b10 < b20)),
        "v_macd": v_macd, "v_kdj": v_kdj,
        "v_rsi": vote(F.col("rsi") < 30, F.col("rsi") > 70),
        "v_boll": vote(F.col("close") < F.col("boll_lower"), F.col("close") > F.col("boll_upper")),
    })


def vote_score(side: int) -> Column:
    total = sum(VOTE_WEIGHTS.values())
    parts = [F.when(F.col(f"v_{n.lower()}") == side, w / total).otherwise(0.0) for n, w in VOTE_WEIGHTS.items()]
    return sum(parts[1:], parts[0])


@signal("multi_fusion")
def multi_fusion(bars: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    df = votes(fusion_inputs(bars)).withColumns({"_b": vote_score(1), "_s": vote_score(-1)})
    buy = (F.col("_b") + SLACK >= threshold) & (F.col("_b") > F.col("_s"))
    sell = (F.col("_s") + SLACK >= threshold) & (F.col("_s") > F.col("_b"))
    return _edges(df, buy, sell).select(*bars.columns, "entry", "exit")


