"""Technical indicators: each adds columns to a bars DataFrame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import (
    div, full, lag, max_n, mean_n, min_n, running, series, std_n, sum_n, trail,
)
from barloom.operators import recur as R
from barloom.operators.ranking import calendar_join


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """dif, dea, hist = 2*(dif-dea)."""
    return R.recur(bars, R.macd_steps("close", fast, slow, signal), keep=["dif", "dea", "hist"])


def ema(bars: DataFrame, out: str, src: str, n: int) -> DataFrame:
    return R.recur(bars, [R.ema(out, src, n)])


def rsi(bars: DataFrame, n: int = 14, src: str = "close", out: str = "rsi") -> DataFrame:
    """Simple-mean RSI: no down moves -> 100, no moves at all -> 50."""
    step = F.col(src) - lag(src)
    df = bars.withColumn("_step", step)
    up = mean_n(F.greatest(F.col("_step"), F.when(F.col("_step").isNotNull(), 0.0)), n)
    down = mean_n(-F.least(F.col("_step"), F.when(F.col("_step").isNotNull(), 0.0)), n)
    df = df.withColumns({"_up": up, "_down": down})
    value = (
        F.when(F.col("_down").isNull(), F.lit(None).cast("double"))
        .when((F.col("_down") == 0) & (F.col("_up") == 0), 50.0)
        .when(F.col("_down") == 0, 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + div("_up", "_down")))
    )
    return df.withColumn(out, value).drop("_step", "_up", "_down")


def rsv(bars: DataFrame, n: int = 9) -> DataFrame:
    """Raw stochastic value; a flat window gives null."""
    lo, hi = min_n("low", n), max_n("high", n)
    return bars.withColumn("rsv", div(F.col("close") - lo, hi - lo) * 100.0)


def kdj(bars: DataFrame, n: int = 9, m1: int = 3, m2: int = 3) -> DataFrame:
    return R.recur(rsv(bars, n), R.kdj_steps("rsv", 1 / m1, 1 / m2)).drop("rsv")


def boll(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    df = bars.withColumns({"boll_mid": mean_n("close", n), "_sd": std_n("close", n)})
    return df.withColumns({
        "boll_upper": F.col("boll_mid") + k * F.col("_sd"),
        "boll_lower": F.col("boll_mid") - k * F.col("_sd"),
    }).drop("_sd")


def true_range() -> Column:
    """Largest of the three ranges; the first bar has only high - low."""
    pc = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def atr(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    return bars.withColumn("_tr", true_range()).withColumn(out, mean_n("_tr", n)).drop("_tr")


def bias(c: Column | str, n: int) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    ma = mean_n(c, n)
    return div(x - ma, ma) * 100.0


def cci(bars: DataFrame, n: int = 14, out: str = "cci") -> DataFrame:
    """Deviation of the typical price against the mean absolute deviation of its own window."""
    df = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    df = df.withColumns({
        "_mean": mean_n("_tp", n),
        "_win": F.collect_list("_tp").over(trail(n)),
    })
    mad = F.aggregate("_win", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / float(n)
    return df.withColumn(out, div(F.col("_tp") - F.col("_mean"), 0.015 * mad)).drop("_tp", "_mean", "_win")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """plus_di, minus_di, adx from rolling sums (not Wilder smoothing)."""
    up = F.col("high") - lag("high")
    dn = lag("low") - F.col("low")
    df = bars.withColumns({"_up": up, "_dn": dn, "_tr": true_range()})
    u, d = F.col("_up"), F.col("_dn")
    df = df.withColumns({
        "_pdm": F.when((u > d) & (u > 0), u).otherwise(0.0),
        "_mdm": F.when((d > u) & (d > 0), d).otherwise(0.0),
    })
    tr = mean_n("_tr", n) * float(n)
    df = df.withColumns({
        "plus_di": div(100.0 * sum_n("_pdm", n), tr),
        "minus_di": div(100.0 * sum_n("_mdm", n), tr),
    })
    dx = div(100.0 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))
    return df.withColumn("_dx", dx).withColumn("adx", mean_n("_dx", n)).drop("_up", "_dn", "_tr", "_pdm", "_mdm", "_dx")


def aroon(bars: DataFrame, n: int = 25) -> DataFrame:
    """Position of the window's first high/low among n+1 bars, in percent."""
    w = trail(n + 1)
    df = bars.withColumn("_rn", F.row_number().over(series()))
    first_pos = lambda c, agg: agg(F.col("_rn"), F.struct(F.col(c), -F.col("_rn") if agg is F.max_by else F.col("_rn"))).over(w)
    pos = lambda c, agg: (first_pos(c, agg) - (F.col("_rn") - n)) * 100.0 / float(n)
    return df.withColumns({
        "aroon_up": F.when(F.count("high").over(w) > n, pos("high", F.max_by)),
        "aroon_down": F.when(F.count("low").over(w) > n, pos("low", F.min_by)),
    }).drop("_rn")


def arbr(bars: DataFrame, n: int = 26) -> DataFrame:
    floor0 = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    pc = lag("close")
    df = bars.withColumns({
        "_ho": floor0(F.col("high") - F.col("open")),
        "_ol": floor0(F.col("open") - F.col("low")),
        "_hc": floor0(F.col("high") - pc),
        "_cl": floor0(pc - F.col("low")),
    })
    return df.withColumns({
        "ar": div(sum_n("_ho", n), sum_n("_ol", n)) * 100.0,
        "br": div(sum_n("_hc", n), sum_n("_cl", n)) * 100.0,
    }).drop("_ho", "_ol", "_hc", "_cl")


def stoch_rsi(bars: DataFrame, rsi_n: int = 14, n: int = 14) -> DataFrame:
    df = rsi(bars, rsi_n, out="_rsi")
    lo, hi = min_n("_rsi", n), max_n("_rsi", n)
    return df.withColumn("stoch_rsi", div(F.col("_rsi") - lo, hi - lo) * 100.0).drop("_rsi")


def rsrs(bars: DataFrame, n: int = 18, m: int = 600) -> DataFrame:
    """Rolling slope of high on low, z-scored over m slopes and weighted by R2."""
    df = R.recur(bars, [
        R.Rolled("slope", "high", n, R.slope, "low"), R.Rolled("_r2", "high", n, R.explained, "low"), R.Rolled("_z", "slope", m, R.standing)])
    return df.withColumn("rsrs", F.col("_z") * F.col("_r2")).drop("_r2", "_z")


def trend_ends(windows: np.ndarray) -> np.ndarray:
    """Last value of the rank-one trend of each row.

    Lagged copies of a row, as long as half of it, have a small Gram matrix.
    Its powers, by squaring, turn into the projection on the leading direction
    v; the newest lagged copy, projected on v, gives the trend's last value.
    """
    n = windows.shape[1]
    lags = n - n // 2
    copies = np.lib.stride_tricks.sliding_window_view(windows, lags, axis=1)
    gram = np.einsum("wia,wib->wab", copies, copies)
    for _ in range(60):
        size = np.trace(gram, axis1=1, axis2=2)[:, None, None]
        gram /= np.where(size > 0, size, 1.0)
        power = gram @ gram
        if np.abs(power - gram).max(initial=0.0) < 1e-15:
            break
        gram = power
    size = np.trace(gram, axis1=1, axis2=2)
    return np.einsum("wa,wa->w", copies[:, -1], gram[:, :, -1]) / np.where(size > 0, size, 1.0)


def ssa(bars: DataFrame, window: int = 30, src: str = "close") -> DataFrame:
    """Singular-spectrum trend from the ``window`` bars before the current one."""

    def compute(cols: dict[str, pd.Series], ids: np.ndarray) -> dict[str, np.ndarray]:
        x = cols[src].to_numpy(float)
        out = np.full(len(x), np.nan)
        if len(x) > window:
            i = np.arange(window, len(x))
            i = i[ids[i] == ids[i - window]]  # the whole window lies in one symbol
            views = np.lib.stride_tricks.sliding_window_view(x, window)
            good = i[~np.isnan(views[i - window]).any(axis=1)]
            for part in np.array_split(good, max(1, len(good) // 4096)):
                if len(part):
                    out[part] = trend_ends(views[part - window])
        return {"ssa": out}

    return R.ordered_pass(bars, [T.StructField("ssa", T.DoubleType())], compute, [src])


def rolling_quantile(c: str, n: int, p: float) -> Column:
    """Linear-interpolated quantile over a full trailing window."""
    return full(F.percentile(F.col(c), F.lit(p)), c, n, trail(n))


def forward_return(h: int, src: str = "close") -> Column:
    """Return over the symbol's own next h rows."""
    return div(F.lead(src, h).over(series()), F.col(src)) - 1.0


def delayed_label(entry: int = 1, exit_: int = 6, src: str = "close") -> Column:
    """Return from ``entry`` to ``exit_`` rows ahead: the trade starts after the signal."""
    w = series()
    return div(F.lead(src, exit_).over(w), F.lead(src, entry).over(w)) - 1.0


def calendar_offsets(bars: DataFrame, offsets: dict[str, int], src: str = "close") -> DataFrame:
    """Value of ``src`` at the market date ``offset`` steps away; null where the symbol has no bar.

    The calendar (one row per distinct date) numbers the dates; a one-point
    range frame then reads the exact step, so suspended symbols give null.
    """
    cal = bars.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).select(
        "date", F.row_number().over(Window.orderBy("date")).alias("_i"))
    w = Window.partitionBy("code").orderBy("_i")
    return calendar_join(bars, cal, ["date"]).withColumns(
        {name: F.max(src).over(w.rangeBetween(k, k)) for name, k in offsets.items()}
    ).drop("_i")


def calendar_forward_return(bars: DataFrame, h: int, src: str = "close") -> DataFrame:
    """Return to the h-th later market date."""
    return calendar_offsets(bars, {"_then": h}, src).withColumn(f"fwd_{h}", div("_then", src) - 1.0).drop("_then")


def running_drawdown(c: str, w=None) -> Column:
    """Fall from the running peak."""
    peak = F.max(c).over(running(w))
    return div(F.col(c) - peak, peak)


