"""Return statistics of equity curves: one row per (variant, date) in, one row per variant out.

Curves are already aggregated (a row per period), so a window over a variant's
curve is bounded by the calendar; all variants are evaluated in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import div, ratio
from barloom.operators.ranking import attach, quantiles, with_global


def compounded(r: Column | str) -> Column:
    c = F.col(r) if isinstance(r, str) else r
    return F.product(1.0 + c) - 1.0


def equity(df: DataFrame, ret: str, by: Sequence[str], order: str = "date") -> DataFrame:
    """Append the compounded curve ``eq`` and its drawdown ``dd``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("eq", F.product(1.0 + F.col(ret)).over(w))
    peak = F.max("eq").over(w)
    return df.withColumn("dd", (F.col("eq") - peak) / peak)


def return_stats(
    df: DataFrame, ret: str, by: Sequence[str] = (), *, order: str = "date", periods: float = 12.0,
    sharpe: str = "mean", win: str = "all", min_obs: int = 1, undefined: float | None = 0.0,
) -> DataFrame:
    """total, ann, vol, sharpe, mdd, calmar, win, n.

    ``sharpe``: 'mean' = mean/std*sqrt(periods), 'ann' = annual return/volatility.
    ``win``: share of positive periods among 'all' or among 'nonzero' ones.
    ``undefined`` replaces ratios without a denominator and, below ``min_obs``
    periods, every statistic.
    """
    c = F.col(ret)
    curve = equity(df.where(c.isNotNull()), ret, by, order)
    base = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("eq", order) - 1.0).alias("total"), F.stddev_samp(c).alias("_sd"),
        F.avg(c).alias("_mu"), F.min("dd").alias("mdd"), F.count_if(c > 0).alias("_up"), F.count_if(c != 0).alias("_nz"),
    )
    none = F.lit(undefined).cast("double")
    root = F.sqrt(F.lit(float(periods)))
    ann = F.pow(1.0 + F.col("total"), F.lit(float(periods)) / F.col("n")) - 1.0
    base = base.withColumns({"ann": ann, "vol": F.col("_sd") * root})
    ratio = F.col("_mu") / F.col("_sd") * root if sharpe == "mean" else F.col("ann") / F.col("vol")
    stats = base.withColumns({
        "sharpe": F.when(F.col("_sd") > 0, ratio).otherwise(none),
        "calmar": F.when(F.col("mdd") < 0, F.col("ann") / F.abs("mdd")).otherwise(none),
        "win": F.col("_up") / (F.greatest(F.lit(1), F.col("_nz")) if win == "nonzero" else F.col("n")),
    }).drop("_sd", "_mu", "_up", "_nz")
    if min_obs > 1:
        cols = [x for x in stats.columns if x not in (*by, "n")]
        stats = stats.withColumns({x: F.when(F.col("n") >= min_obs, F.col(x)).otherwise(none) for x in cols})
    return stats


def attribution(df: DataFrame, ret: str, bench: str, by: Sequence[str] = (), *, order: str = "date", periods: float = 252.0) -> DataFrame:
    """Risk and attribution set against a benchmark, from the published definitions.

    Quantiles are selected (``ranking.quantiles``); the tail beyond them is a condition of the one aggregation.
    Ratios to nothing (no loss, no spread) are infinite, or NaN for 0/0.
    """
    r, b = F.col(ret), F.col(bench)
    root = F.sqrt(F.lit(float(periods)))
    w = Window.partitionBy(*by).orderBy(order)
    x = df.where(r.isNotNull() & b.isNotNull()).withColumns({
        "_i": F.row_number().over(w), "_log": F.sum(F.log1p(r)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    x = attach(x, quantiles(x, list(by), ret, {"_q95": 0.95, "_q05": 0.05}), list(by))
    a = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("_mu"), F.stddev_samp(r).alias("_sd"), compounded(r).alias("_tot"),
        F.avg(F.pow(F.least(r, F.lit(0.0)), 2)).alias("_down"), F.sum(F.greatest(r, F.lit(0.0))).alias("_gain"),
        F.sum(F.greatest(-r, F.lit(0.0))).alias("_loss"), F.max("_q95").alias("_p95"), F.max("_q05").alias("var_95"),
        F.when(F.var_pop("_log") == 0, float("nan")).otherwise(F.regr_r2("_log", "_i")).alias("stability"), F.regr_slope(r, b).alias("beta"), F.regr_intercept(r, b).alias("_alpha"),
        F.avg(r - b).alias("_xm"), F.stddev_samp(r - b).alias("_xs"), F.avg(F.when(r <= F.col("_q05"), r)).alias("cvar_95"),
    )
    a = a.withColumns({
        "annual_return": F.pow(1.0 + F.col("_tot"), F.lit(float(periods)) / F.col("n")) - 1.0,
        "annual_vol": F.col("_sd") * root,
        "downside_risk": F.sqrt("_down") * root,
        "sortino": ratio(F.col("_mu") * float(periods), F.sqrt("_down") * root),
        "omega": ratio("_gain", "_loss"),
        "tail_ratio": ratio(F.abs("_p95"), F.abs("var_95")),
        "alpha": F.pow(1.0 + F.col("_alpha"), F.lit(float(periods))) - 1.0,
        "excess_sharpe": ratio("_xm", "_xs"),
    })
    keep = ["n", "annual_return", "annual_vol", "sortino", "omega", "tail_ratio", "stability", "var_95", "cvar_95", "alpha", "beta", "downside_risk", "excess_sharpe"]
    return a.select(*by, *keep)


def by_regime(df: DataFrame, regimes: DataFrame, ret: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Statistics per named period (name, start, end); periods may overlap.

    The regime list is a short table; its rows are kept in an array beside each
    row and filtered, which needs neither a range join nor a product of tables.
    """
    spans = regimes.agg(F.collect_list(F.struct("name", "start", "end")).alias("_spans"))
    tagged = with_global(df, spans).withColumn(
        "regime", F.explode(F.filter("_spans", lambda s: (F.col("date") >= s["start"]) & (F.col("date") <= s["end"]))["name"]))
    return return_stats(tagged, ret, [*by, "regime"], **kw)


def by_bucket(df: DataFrame, ret: str, by: Sequence[str], k: int = 5, *, order: str = "date", **kw) -> DataFrame:
    """Statistics per equal row-count bucket; the last one takes the remainder."""
    w = Window.partitionBy(*by)
    rn = F.row_number().over(w.orderBy(order)) - 1
    n = F.count(F.lit(1)).over(w)
    bucket = F.least(F.floor(F.try_divide(rn.cast("double"), F.floor(n / k))), F.lit(k - 1)).cast("int")
    return return_stats(df.withColumn("bucket", bucket), ret, [*by, "bucket"], order=order, **kw)


def span_ranks(df: DataFrame, ret: str, variant: str, split: Column, **kw) -> DataFrame:
    """Selection-span and hold-out metrics per variant, each ranked by calmar."""
    tagged = df.withColumn("span", F.when(split, "holdout").otherwise("selection"))
    s = return_stats(tagged, ret, [variant, "span"], **kw)
    w = Window.partitionBy("span").orderBy(F.desc("calmar"), variant)  # one row per variant
    return s.withColumn("rank", F.row_number().over(w))


def cagr(df: DataFrame, price: str, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    g = df.groupBy(*by).agg(
        F.max_by(price, date).alias("_b"), F.min_by(price, date).alias("_a"), F.datediff(F.max(date), F.min(date)).alias("days"))
    return g.select(*by, F.when(F.col("days") > 0, F.pow(F.col("_b") / F.col("_a"), 365.0 / F.nullif(F.col("days"), F.lit(0))) - 1.0).alias("cagr"))


def portfolio_risk(returns: DataFrame, bench: DataFrame, *, periods: float = 252.0, min_obs: int = 10) -> DataFrame:
    """Volatility %, historical VaR 95 % and beta of the equal-weight book.

    ``returns``: code, date, ret; ``bench``: date, bench_ret.
    """
    book = returns.where("ret is not null").groupBy("date").agg(F.avg("ret").alias("p"))
    j = book.join(bench, "date", "left")
    a = j.agg(
        F.count("p").alias("n"), F.stddev_samp("p").alias("sd"), F.percentile("p", F.lit(0.05)).alias("q"),
        F.covar_samp("p", "bench_ret").alias("cv"),
        F.var_samp(F.when(F.col("p").isNotNull(), F.col("bench_ret"))).alias("vb"), F.count("bench_ret").alias("nb"))
    ok = F.col("n") >= min_obs
    return a.select(
        "n", F.when(ok, F.col("sd") * F.sqrt(F.lit(float(periods))) * 100.0).alias("vol_pct"), F.when(ok, -F.col("q") * 100.0).alias("var95_pct"),
        F.when(ok & (F.col("nb") >= min_obs), div("cv", "vb")).alias("beta"))
