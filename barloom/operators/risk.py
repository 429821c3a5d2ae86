"""Risk gates, alert levels and data-quality verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import change, div
from barloom.operators.ranking import with_global


def _gate(df: DataFrame, name: str, ok: Column, reason: Column, metric: Column, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.lit(name).alias("gate"), ok.alias("ok"), reason.alias("reason"), metric.cast("double").alias("metric"))


def drawdown_gate(nav: DataFrame, by: Sequence[str] = (), *, limit: float = 0.15, min_history: int = 30) -> DataFrame:
    """Fall of the last value from the peak; blocks at or beyond the limit."""
    a = nav.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("nav").alias("peak"), F.max_by("nav", "date").alias("cur"))
    dd = div(F.col("cur") - F.col("peak"), "peak")
    short, dead = F.col("n") < min_history, F.col("peak") <= 0
    hit = dd <= -limit
    reason = F.when(short, "insufficient_history").when(dead, "peak_not_positive").when(hit, "drawdown").otherwise("dd_ok")
    return _gate(a, "drawdown", short | dead | ~hit, reason, F.when(~short & ~dead, dd), by)


def daily_loss_gate(nav: DataFrame, by: Sequence[str] = (), *, limit: float = 0.04) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("date")
    a = nav.withColumn("_prev", F.lag("nav", 1).over(w)).groupBy(*by).agg(F.max_by(F.struct("nav", "_prev"), "date").alias("x"))
    prev = F.col("x._prev")
    chg = div("x.nav", "x._prev") - 1.0
    dead = F.coalesce(prev <= 0, F.lit(True))
    reason = F.when(dead, "prev_nav_not_positive").when(chg <= -limit, "daily_loss").otherwise("daily_ok")
    return _gate(a, "daily_loss", dead | ~(chg <= -limit), reason, F.when(~dead, chg), by)


def position_weight_gate(weights: DataFrame, by: Sequence[str] = (), *, limit: float = 0.20) -> DataFrame:
    """Largest weight; blocks only beyond the limit (weights: sym, weight)."""
    a = weights.groupBy(*by).agg(F.max("weight").alias("w"), F.max_by("sym", F.struct("weight", "sym")).alias("sym"))
    none = F.col("w").isNull()
    over = F.coalesce(F.col("w") > limit, F.lit(False))
    reason = F.when(none, "no_positions").when(over, F.concat(F.lit("max_weight "), "sym")).otherwise("weights_ok")
    return _gate(a, "position_weight", ~over, reason, F.col("w"), by)


def self_check(nav: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """pass / insufficient / blocked from the drawdown and daily-loss gates."""
    gates = drawdown_gate(nav, by).unionByName(daily_loss_gate(nav, by))
    n = nav.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    g = gates.groupBy(*by).agg(F.bool_and("ok").alias("ok"))
    j = n.join(g, list(by)) if by else with_global(n, g)
    return j.withColumn("verdict", F.when(F.col("n") < 2, "insufficient").when(F.col("ok"), "pass").otherwise("blocked"))


def trailing_negative_months(df: DataFrame, ret: str, by: Sequence[str] = (), *, order: str = "date", out: str = "neg_run") -> DataFrame:
    """Length of the run of negative returns ending at each row; a missing return ends it."""
    w = Window.partitionBy(*by).orderBy(order)
    neg = F.coalesce(F.col(ret) < 0, F.lit(False))
    df = df.withColumn("_rn", F.row_number().over(w))
    brk = F.last(F.when(~neg, F.col("_rn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, (F.col("_rn") - F.coalesce(brk, F.lit(0))).cast("int")).drop("_rn")


def rolling_sharpe(ret: str, n: int, by: Sequence[str] = (), *, order: str = "date", periods: float = 12.0) -> Column:
    """Over the last n known returns; null below n or without spread.  Rows must hold known returns."""
    f = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp(ret).over(f)
    return F.when(F.count(ret).over(f) >= n, div(F.avg(ret).over(f), sd) * F.sqrt(F.lit(float(periods))))


def value_rows_ago(c: str, n: int, by: Sequence[str] = (), order: str = "date") -> Column:
    return F.lag(c, n).over(Window.partitionBy(*by).orderBy(order))


# Alert thresholds.
BLACK_SHARPE_6M = 0.0
RED_CUM_60, RED_SHARPE_3M, RED_NEG_MONTHS = -0.30, 0.3, 3
ORANGE_CUM_60, ORANGE_NEG_MONTHS = -0.20, 3
YELLOW_CUM_60, YELLOW_REL_60 = -0.10, -0.05


def alert_level(cum: str = "cum_60", rel: str = "rel_60", s3: str = "sharpe_3m", s6: str = "sharpe_6m", neg: str = "neg_run") -> Column:
    """black > red > orange > yellow > green; missing inputs trigger nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    return (
        F.when(yes(c(s6) < BLACK_SHARPE_6M), "black")
        .when(yes(c(cum) < RED_CUM_60) | yes((c(s3) < RED_SHARPE_3M) & (c(neg) >= RED_NEG_MONTHS)), "red")
        .when(yes(c(cum) < ORANGE_CUM_60) | yes(c(neg) >= ORANGE_NEG_MONTHS), "orange")
        .when(yes(c(cum) < YELLOW_CUM_60) | yes(c(rel) < YELLOW_REL_60), "yellow")
        .otherwise("green")
    )


def alerts(curve: DataFrame, *, by: Sequence[str] = (), rows: int = 60) -> DataFrame:
    """Alert inputs and level per curve row (columns: date, value, bench, ret)."""
    df = trailing_negative_months(curve, "ret", by)
    df = df.withColumns({
        "cum_60": div("value", value_rows_ago("value", rows, by)) - 1.0, "_b": div("bench", value_rows_ago("bench", rows, by)) - 1.0,
        "sharpe_3m": rolling_sharpe("ret", 3, by), "sharpe_6m": rolling_sharpe("ret", 6, by),
    })
    df = df.withColumn("rel_60", F.col("cum_60") - F.col("_b")).drop("_b")
    return df.withColumn("level", alert_level())


# Defaults of the data-quality checks.
RECENT_DAYS, MAX_JUMP, MAX_LAG_DAYS, MIN_COVERAGE, PRICE_FLOOR = 30, 0.11, 3, 0.80, 0.5


def sanity_checks(
    bars: DataFrame, n_universe: DataFrame, today: Column, *, recent_days: int = RECENT_DAYS, max_jump: float = MAX_JUMP,
    max_lag: int = MAX_LAG_DAYS, min_coverage: float = MIN_COVERAGE, floor: float = PRICE_FLOOR,
) -> DataFrame:
    """Five checks, one row each: check, critical, passed, n_bad, value.  One aggregation over the bars."""
    latest = bars.agg(F.max("date").alias("_last"))
    df = with_global(bars, latest)
    recent = F.col("date") >= F.date_sub("_last", recent_days)
    # the change inside the recent scope: its first row has no predecessor
    df = df.withColumn("_chg", F.when(recent & F.lag(recent, 1).over(Window.partitionBy("code").orderBy("date")), change("close")))
    a = df.agg(
        F.count_if(F.col("close") < 0).alias("neg"), F.count_if(F.col("close") < floor).alias("low"),
        F.count_if(F.abs("_chg") > max_jump).alias("jump"), F.max("date").alias("last"),
        F.count_if(F.col("date") == F.col("_last")).alias("covered"))
    a = with_global(a, n_universe.agg(F.count(F.lit(1)).alias("expected")))
    lag_days = F.datediff(today, "last")
    share = F.coalesce(div("covered", "expected"), F.lit(0.0))
    row = lambda n, crit, ok, bad, val: F.struct(F.lit(n).alias("check"), F.lit(crit).alias("critical"), ok.alias("passed"), bad.cast("bigint").alias("n_bad"), val.cast("double").alias("value"))
    rows = F.array(
        row("neg_close", True, F.col("neg") == 0, F.col("neg"), F.lit(None)), row("extreme_low", True, F.col("low") == 0, F.col("low"), F.lit(floor)),
        row("extreme_jump", False, F.col("jump") == 0, F.col("jump"), F.lit(max_jump)), row("freshness", False, lag_days <= max_lag, F.lit(0), lag_days),
        row("coverage", False, share >= min_coverage, F.col("expected") - F.col("covered"), share))
    return a.select(F.explode(rows).alias("r")).select("r.*")


def sanity_verdict(checks: DataFrame) -> DataFrame:
    """One row: critical when a critical check failed, warning when another did."""
    bad = F.count_if(~F.col("passed"))
    return checks.agg(F.count_if(~F.col("passed") & F.col("critical")).alias("critical_failures"), bad.alias("failures")).withColumn(
        "verdict", F.when(F.col("critical_failures") > 0, "critical").when(F.col("failures") > 0, "warning").otherwise("ok"))


def completeness(bars: DataFrame, universe: DataFrame, index: DataFrame, must_have: DataFrame, *, ok: float = 0.95, critical: float = 0.80, warn: float = 0.90, must_critical: int = 8) -> DataFrame:
    """Coverage of universe, index and must-have codes with verdict and reasons."""
    have = bars.select("code").distinct().withColumn("_hit", F.lit(1))
    lists = universe.select(F.lit("universe").alias("list"), "code").unionByName(index.select(F.lit("index").alias("list"), "code")).unionByName(must_have.select(F.lit("must").alias("list"), "code"))
    c = lists.distinct().join(have, "code", "left")
    pick = lambda n: (F.count_if(F.col("list") == n).alias(f"{n}_total"), F.count_if((F.col("list") == n) & F.col("_hit").isNotNull()).alias(f"{n}_covered"))
    a = c.agg(*pick("universe"), *pick("index"), *pick("must"))
    pct = lambda n: F.coalesce(div(f"{n}_covered", f"{n}_total"), F.lit(0.0))
    a = a.withColumns({"universe_pct": pct("universe"), "index_pct": pct("index")})
    i_bad, i_low = F.col("index_pct") < critical, F.col("index_pct") < ok
    m_bad, m_low = F.col("must_covered") < must_critical, F.col("must_covered") < F.col("must_total")
    u_low = F.col("universe_pct") < warn
    reasons = F.array_compact(F.array(F.when(i_low, F.lit("index")), F.when(m_bad | m_low, F.lit("must_have")), F.when(u_low, F.lit("universe"))))
    return a.withColumns({"verdict": F.when(i_bad | m_bad, "CRITICAL").when(i_low | m_low | u_low, "WARNING").otherwise("OK"), "reasons": reasons})


def coverage_by(universe: DataFrame, bars: DataFrame, group: str) -> DataFrame:
    have = bars.select("code").distinct().withColumn("_hit", F.lit(1))
    g = universe.join(have, "code", "left").groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count("_hit").alias("covered"))
    return g.withColumn("pct", F.col("covered") / F.col("total"))


def alert_board(logs: Sequence[DataFrame], severity: dict[str, int], last: int = 10) -> DataFrame:
    """Newest row of each log with its severity and the number of bad rows among its last ones.

    Each log: source, date, level, summary.
    """
    table = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])
    alls = logs[0]
    for x in logs[1:]:
        alls = alls.unionByName(x)
    w = Window.partitionBy("source").orderBy(F.desc("date"), F.desc("level"))
    recent = alls.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last)
    recent = recent.withColumn("severity", F.coalesce(F.try_element_at(table, F.lower("level")), F.lit(0)))
    board = recent.groupBy("source").agg(
        F.max("date").alias("date"), F.min_by(F.struct("level", "severity", "summary"), "_k").alias("x"), F.count_if(F.col("severity") >= 1).alias("recent_bad"))
    return board.select("source", "date", "x.level", "x.severity", "x.summary", "recent_bad").orderBy(F.desc("severity"), F.desc("date"), "source")
