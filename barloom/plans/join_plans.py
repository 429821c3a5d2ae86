"""Point-in-time, interval, calendar and lookup joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.frames import change, div, mean_n, series
from barloom.operators import crosssec as C
from barloom.operators import joins as J
from barloom.operators import panels as N
from barloom.operators.factors import amplitude_imbalance
from barloom.operators.ranking import calendar_join, top_k, with_global
from barloom.plans.registry import (
    ANN_SQL, BARS_M_SQL, SUPPLIERS_SQL, TRADES_SQL, W, full_sql, on_bars, query, r, r6, with_,
)

FWD1 = f"lead(close,1) OVER ({W})/close-1"


def amp_sql(n: int = 5, name: str = "amp") -> str:
    return f"""{name}_p AS (SELECT *,lag(close) OVER ({W}) AS pc FROM bars),
{name}_d AS (SELECT *,CASE WHEN pc>0 AND open>0 THEN (high-low)/pc END AS amp,
CASE WHEN pc>0 AND open>0 THEN greatest(close-pc,0)/pc*((high-low)/pc) END AS up,
CASE WHEN pc>0 AND open>0 THEN greatest(pc-close,0)/pc*((high-low)/pc) END AS dn,
CASE WHEN pc>0 AND open>0 THEN (close/open-1)*(open/pc-1) END AS tc FROM {name}_p),
{name} AS MATERIALIZED (SELECT code,date,open,high,low,close,volume,CASE WHEN {full_sql('sum', 'amp', n)}>0 THEN ({full_sql('sum', 'up', n)}-{full_sql('sum', 'dn', n)})/{full_sql('sum', 'amp', n)} END AS amp_imb,
{full_sql('sum', 'tc', n)} AS team_coin FROM {name}_d)"""


@query("join_factor_return", on_bars(f"SELECT a.code,a.date,{r6('amp_imb')} AS amp_imb,{r6('fwd')} AS fwd FROM amp a JOIN f USING (code,date) WHERE amp_imb IS NOT NULL AND fwd IS NOT NULL",
       amp_sql(), f"f AS (SELECT code,date,{FWD1} AS fwd FROM bars)"))
def join_factor_return(t):
    """Factor and forward return share keys and partitioning: one window pass instead of a join."""
    b = amplitude_imbalance(t.bars_m, 5).withColumn("fwd", div(F.lead("close", 1).over(series()), "close") - 1.0)
    return b.where(F.col("amp_imb_5").isNotNull() & F.col("fwd").isNotNull()).select(
        "code", "date", r("amp_imb_5").alias("amp_imb"), r("fwd").alias("fwd"))


EVENT_DAY_SQL = "ev AS (SELECT code,date,sum(value) AS value,count(*) AS n FROM ann GROUP BY 1,2)"


@query("join_left_neutral", with_(BARS_M_SQL, ANN_SQL, "em AS (SELECT code,CAST(date_trunc('month',date) AS DATE) AS date,sum(value) AS value FROM ann GROUP BY 1,2)") +
       f"SELECT b.code,b.date,{r6('coalesce(value,0)', 4)} AS value FROM bars b LEFT JOIN em USING (code,date)")
def join_left_neutral(t):
    em = t.announcements.groupBy("code", F.trunc("date", "month").alias("date")).agg(F.sum("value").alias("value"))
    return t.bars_m.join(em, ["code", "date"], "left").select("code", "date", r(F.coalesce("value", F.lit(0.0)), 4).alias("value"))


@query("join_dimension", with_(BARS_M_SQL, SUPPLIERS_SQL) + f"SELECT code,date,name,industry,{r6('close')} AS close FROM bars LEFT JOIN suppliers USING (code)")
def join_dimension(t):
    return J.lookup(t.bars_m, t.suppliers, "code").select("code", "date", "name", "industry", r("close").alias("close"))


ADJ_SQL = "adj AS (SELECT code,date,1+value/1000000 AS f,id FROM ann)"


@query("join_asof_adjustment", with_(BARS_M_SQL, ANN_SQL, ADJ_SQL, """adj1 AS (SELECT code,date,arg_max(f,id) AS f FROM adj GROUP BY 1,2)""") +
       f"""SELECT b.code,b.date,{r6('open*coalesce(f,1)')} AS open,{r6('high*coalesce(f,1)')} AS high,{r6('low*coalesce(f,1)')} AS low,{r6('close*coalesce(f,1)')} AS close
FROM bars b ASOF LEFT JOIN adj1 a ON b.code=a.code AND b.date>=a.date""")
def join_asof_adjustment(t):
    """Adjustment factor in force at each bar (1.0 before the first), applied to the prices."""
    adj = t.announcements.select("code", "date", (1.0 + F.col("value") / 1e6).alias("f"), "id")
    hit = J.asof(t.bars_m, adj, ["f"], tie=["id"])
    f = F.coalesce("f", F.lit(1.0))
    return hit.select("code", "date", *[r(F.col(c) * f).alias(c) for c in ("open", "high", "low", "close")])


def axis(t):
    """Prediction axis: every customer's order days."""
    return t.announcements.select("code", "date", F.col("value").alias("pred")).groupBy("code", "date").agg(F.sum("pred").alias("pred"))


AXIS_SQL = "ax AS (SELECT code,date,sum(value) AS pred FROM ann GROUP BY 1,2)"


def z_sql(x: str, by: str = "date", std: str = "stddev_samp") -> str:
    return f"(CASE WHEN coalesce({std}({x}) OVER (PARTITION BY {by}),0)=0 THEN 0 ELSE coalesce(({x}-avg({x}) OVER (PARTITION BY {by}))/{std}({x}) OVER (PARTITION BY {by}),0) END)"


@query("join_asof_pit_zscore", with_(BARS_M_SQL, ANN_SQL, AXIS_SQL, amp_sql()) +
       f"""SELECT code,date,{r6(z_sql('f', 'm'))} AS z FROM (SELECT ax.code,ax.date,CAST(date_trunc('month',ax.date) AS DATE) AS m,a.amp_imb AS f FROM ax ASOF LEFT JOIN amp a ON ax.code=a.code AND ax.date>=a.date)""")
def join_asof_pit_zscore(t):
    """Last known factor on a sparse prediction axis, z-scored across the month."""
    fac = amplitude_imbalance(t.bars_m, 5).select("code", "date", F.col("amp_imb_5").alias("f"))
    hit = J.asof(axis(t), fac, ["f"]).withColumn("m", F.trunc("date", "month"))
    return C.zscore(hit, ["f"], "m").select("code", "date", r("z_f").alias("z"))


@query("join_asof_publication_lag", with_(BARS_M_SQL, ANN_SQL, "an1 AS (SELECT code,CAST(date + INTERVAL 60 DAY AS DATE) AS vis,arg_max(value,id) AS value FROM ann GROUP BY 1,2)") +
       f"SELECT b.code,b.date,{r6('value', 4)} AS value,vis AS visible_on FROM bars b ASOF LEFT JOIN an1 a ON b.code=a.code AND b.date>=a.vis")
def join_asof_publication_lag(t):
    vis = t.announcements.withColumn("vis", F.date_add("date", 60))
    hit = J.asof(t.bars_m, vis, ["value"], right_on="vis", tie=["id"], matched_on="visible_on")
    return hit.select("code", "date", r("value", 4).alias("value"), "visible_on")


@query("join_asof_tolerance", with_(BARS_M_SQL, ANN_SQL, "an1 AS (SELECT code,date,arg_max(value,id) AS value FROM ann GROUP BY 1,2)") +
       f"SELECT b.code,b.date,CASE WHEN date_diff('day',a.date,b.date)<=10 THEN {r6('value', 4)} END AS value FROM bars b ASOF LEFT JOIN an1 a ON b.code=a.code AND b.date>=a.date")
def join_asof_tolerance(t):
    hit = J.asof(t.bars_m, t.announcements, ["value"], tie=["id"], tolerance_days=10)
    return hit.select("code", "date", r("value", 4).alias("value"))


GRID_SQL = "grid AS (SELECT code,date FROM (SELECT DISTINCT code FROM suppliers) CROSS JOIN (SELECT DISTINCT date FROM bars))"


@query("join_asof_grid_max_age", with_(BARS_M_SQL, SUPPLIERS_SQL, ANN_SQL, GRID_SQL, "an1 AS (SELECT code,date,arg_max(value,id) AS value FROM ann GROUP BY 1,2)") +
       f"""SELECT g.code,g.date,CASE WHEN date_diff('day',a.date,g.date)<=365 THEN {r6('value', 4)} END AS value,
CAST(CASE WHEN date_diff('day',a.date,g.date)<=365 THEN date_diff('day',a.date,g.date) ELSE -1 END AS INTEGER) AS age_days
FROM grid g ASOF LEFT JOIN an1 a ON g.code=a.code AND g.date>=a.date""")
def join_asof_grid_max_age(t):
    """Full code x date grid; a value older than 365 days reads as missing."""
    newest = t.announcements.groupBy("code", "date").agg(F.max_by("value", "id").alias("value"))
    hit = N.carried(t.suppliers.select("code"), t.bars_m, newest, ["value"], at="at")
    fresh = F.datediff("date", "at") <= 365
    return hit.select("code", "date", F.when(fresh, r("value", 4)).alias("value"), F.when(fresh, F.datediff("date", "at")).otherwise(-1).alias("age_days"))


def fwd_sql(n: int) -> str:
    return (f"coalesce(sum(CASE WHEN e.date<=g.date+{n} THEN e.value/1000 END),0) AS pct_{n},coalesce(sum(CASE WHEN e.date<=g.date+{n} THEN e.value END),0)/1e5 AS val_{n},"
            f"max(CASE WHEN e.date<=g.date+{n} THEN 1 ELSE 0 END) AS imm_{n}")


@query("join_forward_interval", with_(BARS_M_SQL, ANN_SQL, f"""j AS (SELECT g.code,g.date,{fwd_sql(5)},{fwd_sql(20)},{fwd_sql(60)}
FROM bars g LEFT JOIN ann e ON e.code=g.code AND e.date>g.date AND e.date<=g.date+60 GROUP BY 1,2)""") +
       "SELECT code,date," + ",".join(f"{r6(f'pct_{n}', 4)} AS pct_{n},{r6(f'val_{n}')} AS val_{n},CAST(imm_{n} AS INTEGER) AS imm_{n}" for n in (5, 20, 60)) + " FROM j")
def join_forward_interval(t):
    """Events in (T, T+N] calendar days: summed ratio, summed value, any-event flag."""
    out = J.interval_sums(
        t.bars_m.select("code", "date"), t.announcements,
        {"v": F.col("value"), "n": F.lit(1)}, {str(n): (1, n) for n in (5, 20, 60)})
    cols = []
    for n in (5, 20, 60):
        v = F.coalesce(f"v_{n}", F.lit(0.0))
        cols += [r(v / 1000.0, 4).alias(f"pct_{n}"), r(v / 1e5).alias(f"val_{n}"),
                 F.when(F.col(f"n_{n}") > 0, 1).otherwise(0).alias(f"imm_{n}")]
    return out.select("code", "date", *cols)


@query("join_backward_interval", with_(BARS_M_SQL, ANN_SQL, """j AS (SELECT g.code,g.date,
count(CASE WHEN e.date>=g.date-30 THEN 1 END) AS n_30,avg(CASE WHEN e.date>=g.date-30 THEN value END) AS a_30,
avg(CASE WHEN e.date>=g.date-60 AND e.date<g.date-30 THEN value END) AS a_30_60,
count(CASE WHEN e.date>=g.date-90 THEN 1 END) AS n_90,avg(CASE WHEN e.date>=g.date-90 THEN value END) AS a_90,
avg(CASE WHEN e.date>=g.date-180 AND e.date<g.date-90 THEN value END) AS a_90_180
FROM bars g LEFT JOIN ann e ON e.code=g.code AND e.date<g.date AND e.date>=g.date-180 GROUP BY 1,2)""") +
       f"SELECT code,date,n_30,n_90,{r6('a_30', 4)} AS avg_30,{r6('a_90', 4)} AS avg_90,{r6('a_30-a_30_60', 4)} AS chg_30,{r6('a_90-a_90_180', 4)} AS chg_90 FROM j")
def join_backward_interval(t):
    """Trailing calendar-day spans [T-30,T), [T-60,T-30), [T-90,T), [T-180,T-90)."""
    spans = {"30": (-30, -1), "30_60": (-60, -31), "90": (-90, -1), "90_180": (-180, -91)}
    out = J.interval_sums(t.bars_m.select("code", "date"), t.announcements, {"v": F.col("value"), "n": F.lit(1)}, spans)
    avg = {s: div(f"v_{s}", f"n_{s}") for s in spans}
    return out.select(
        "code", "date", F.coalesce("n_30", F.lit(0)).alias("n_30"), F.coalesce("n_90", F.lit(0)).alias("n_90"),
        r(avg["30"], 4).alias("avg_30"), r(avg["90"], 4).alias("avg_90"),
        r(avg["30"] - avg["30_60"], 4).alias("chg_30"), r(avg["90"] - avg["90_180"], 4).alias("chg_90"))


@query("join_densify", with_(BARS_M_SQL, SUPPLIERS_SQL, ANN_SQL, GRID_SQL, "em AS (SELECT code,CAST(date_trunc('month',date) AS DATE) AS date,sum(value) AS value,count(*) AS n FROM ann GROUP BY 1,2)") +
       f"SELECT code,date,{r6('coalesce(value,0)', 4)} AS value,coalesce(n,0) AS n FROM grid LEFT JOIN em USING (code,date)")
def join_densify(t):
    em = t.announcements.groupBy("code", F.trunc("date", "month").alias("date")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    d = N.zero_filled(t.suppliers.select("code"), t.bars_m, em, ["value", "n"])
    return d.select("code", "date", r("value", 4).alias("value"), "n")


@query("join_anti", with_(BARS_M_SQL, ANN_SQL) + f"SELECT code,date,{r6('close')} AS close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.code=b.code AND date_trunc('month',a.date)=b.date)")
def join_anti(t):
    em = t.announcements.select("code", F.trunc("date", "month").alias("date"))
    return t.bars_m.join(em, ["code", "date"], "left_anti").select("code", "date", r("close").alias("close"))


@query("join_semi", with_(BARS_M_SQL, SUPPLIERS_SQL) + f"SELECT code,date,{r6('close')} AS close FROM bars WHERE code IN (SELECT code FROM suppliers WHERE acctbal>0)")
def join_semi(t):
    return t.bars_m.join(t.suppliers.where("acctbal > 0"), "code", "left_semi").select("code", "date", r("close").alias("close"))


@query("join_two_snapshots", with_(BARS_M_SQL, SUPPLIERS_SQL) + f"""SELECT a.code,name,{r6('a.close')} AS close_now,{r6('b.close')} AS close_then,{r6('(a.close/b.close-1)*100')} AS chg_pct
FROM bars a JOIN bars b USING (code) JOIN suppliers USING (code) WHERE a.date=(SELECT max(date) FROM bars)
AND b.date=(SELECT max(date) FROM bars WHERE date<=(SELECT max(date) FROM bars)-150) ORDER BY a.close/b.close DESC,a.code LIMIT 10""")
def join_two_snapshots(t):
    """Latest close against the close about five periods earlier, ten largest changes."""
    b = t.bars_m
    now = b.agg(F.max("date").alias("d"))
    b2 = with_global(b.select("code", "date", "close"), now)
    then = b2.where(F.col("date") <= F.date_sub("d", 150)).agg(F.max("date").alias("d5"))
    b3 = with_global(b2, then).where(F.col("date").isin(F.col("d"), F.col("d5")))
    per = b3.groupBy("code").agg(
        F.max(F.when(F.col("date") == F.col("d"), F.col("close"))).alias("c1"),
        F.max(F.when(F.col("date") == F.col("d5"), F.col("close"))).alias("c0"),
    ).where("c1 is not null and c0 is not null")
    per = per.join(t.suppliers.select("code", "name"), "code")
    per = per.withColumn("q", F.col("c1") / F.col("c0")).orderBy(F.desc("q"), "code").limit(10)
    return per.select("code", "name", r("c1").alias("close_now"), r("c0").alias("close_then"), r((F.col("q") - 1) * 100).alias("chg_pct"))


@query("join_three_tables", with_(BARS_M_SQL, SUPPLIERS_SQL, ANN_SQL) + f"""SELECT p.code,{r6('p.volume', 2)} AS score,{r6('l.close')} AS last_close,{r6('m.value', 4)} AS balance FROM
(SELECT code,CAST(volume AS DOUBLE) AS volume FROM bars WHERE date=(SELECT max(date) FROM bars WHERE date<(SELECT max(date) FROM bars)) ORDER BY volume DESC,code LIMIT 20) p
LEFT JOIN (SELECT code,arg_max(close,date) AS close FROM bars GROUP BY 1) l USING (code)
LEFT JOIN (SELECT code,arg_max(value,(date,id)) AS value FROM ann GROUP BY 1) m USING (code)""")
def join_three_tables(t):
    """Top predictions with last close and last reported balance."""
    b = t.bars_m
    last = b.agg(F.max("date").alias("d"))
    before = with_global(b, last).where(F.col("date") < F.col("d"))
    ref = before.agg(F.max("date").alias("d1"))
    top = with_global(b, ref).where(F.col("date") == F.col("d1")).orderBy(F.desc("volume"), "code").limit(20)
    close = b.groupBy("code").agg(F.max_by("close", "date").alias("last_close"))
    bal = t.announcements.groupBy("code").agg(F.max_by("value", F.struct("date", "id")).alias("balance"))
    return top.select("code", F.col("volume").cast("double").alias("score")).join(close, "code", "left").join(bal, "code", "left").select(
        "code", r("score", 2).alias("score"), r("last_close").alias("last_close"), r("balance", 4).alias("balance"))


@query("join_rewritten_key", with_(BARS_M_SQL, TRADES_SQL, "td AS (SELECT 'SH'||sym AS symbol,date,sum(shares) AS shares FROM trades GROUP BY 1,2)") +
       f"SELECT code,date_trunc('month',td.date)::DATE AS month,td.date AS day,CAST(shares AS BIGINT) AS shares,{r6('open')} AS open FROM td JOIN bars b ON b.code=substr(td.symbol,3) AND b.date=date_trunc('month',td.date)")
def join_rewritten_key(t):
    """Fine-grained rows under a prefixed symbol against coarse bars under the bare code."""
    td = t.trades.groupBy("sym", F.col("date").alias("day")).agg(F.sum("shares").alias("shares"))
    td = td.withColumn("symbol", F.concat(F.lit("SH"), "sym"))
    fine = td.select(F.substring("symbol", 3, 20).alias("code"), F.trunc("day", "month").alias("month"), "day", "shares")
    return fine.join(t.bars_m.select("code", F.col("date").alias("month"), "open"), ["code", "month"]).select(
        "code", "month", "day", "shares", r("open").alias("open"))


@query("join_reindex_ffill", with_(BARS_M_SQL, SUPPLIERS_SQL, GRID_SQL) + f"""SELECT g.code,g.date,{r6('last_value(close IGNORE NULLS) OVER (PARTITION BY g.code ORDER BY g.date)')} AS close
FROM grid g LEFT JOIN bars b ON b.code=g.code AND b.date=g.date""")
def join_reindex_ffill(t):
    out = N.carried(t.suppliers.select("code"), t.bars_m, t.bars_m.where("close is not null").select("code", "date", "close"), ["close"])
    return out.select("code", "date", r("close").alias("close"))


@query("join_nth_row_after", with_(BARS_M_SQL, ANN_SQL, f"nb AS (SELECT *,lead(close,1) OVER ({W}) AS t1,lead(close,5) OVER ({W}) AS t5 FROM bars)") +
       f"SELECT a.code,a.date,id,b.date AS bar_date,{r6('close')} AS at,{r6('t1')} AS t1,{r6('t5')} AS t5 FROM ann a ASOF JOIN nb b ON a.code=b.code AND a.date<=b.date")
def join_nth_row_after(t):
    hit = J.nth_row_after(t.announcements.join(t.suppliers, "code", "left_semi"), t.bars_m, [1, 5]).where(F.col("bar_date").isNotNull())
    return hit.select("code", "date", "id", "bar_date", r("at").alias("at"), r("t1").alias("t1"), r("t5").alias("t5"))


@query("join_benchmark_alignment", with_(BARS_M_SQL) + f"""SELECT code,b.date,{r6('ret')} AS ret,{r6('iret')} AS bench_ret FROM (SELECT *,close/lag(close) OVER ({W})-1 AS ret FROM bars) b
JOIN (SELECT date,c/lag(c) OVER (ORDER BY date)-1 AS iret FROM (SELECT date,avg(close) AS c FROM bars GROUP BY 1)) i ON i.date=b.date WHERE ret IS NOT NULL AND iret IS NOT NULL""")
def join_benchmark_alignment(t):
    idx = t.bars_m.groupBy("date").agg(F.avg("close").alias("c"))
    idx = idx.withColumn("bench_ret", div("c", F.lag("c").over(Window.orderBy("date"))) - 1.0).drop("c")
    b = calendar_join(t.bars_m.withColumn("ret", change("close")), idx, ["date"])
    return b.where("ret is not null and bench_ret is not null").select("code", "date", r("ret").alias("ret"), r("bench_ret").alias("bench_ret"))


@query("join_cte_semi", with_(ANN_SQL, BARS_M_SQL) + f"""SELECT code FROM (SELECT code FROM (SELECT code,value-lag(value) OVER (PARTITION BY code ORDER BY date,id) AS dv,row_number() OVER (PARTITION BY code ORDER BY date DESC,id DESC) AS k FROM ann) WHERE k=1 AND dv<0)
JOIN (SELECT code FROM (SELECT code,volume-lag(volume,5) OVER ({W}) AS dv,row_number() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM bars) WHERE k=1 AND dv>0) USING (code)""")
def join_cte_semi(t):
    """Symbols whose newest report fell and whose volume rose over five bars."""
    a = top_k(t.announcements, ["code"], [F.desc("date"), F.desc("id")], 2, "k")
    v = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    falling = a.groupBy("code").agg((v(1) - v(2)).alias("dv")).where("dv < 0").select("code")
    b = top_k(t.bars_m, ["code"], [F.desc("date")], 6, "k")
    u = lambda k: F.max(F.when(F.col("k") == k, F.col("volume")))
    rising = b.groupBy("code").agg((u(1) - u(6)).alias("dv")).where("dv > 0").select("code")
    return falling.join(rising, "code")


@query("scan_with_buffer", on_bars(f"SELECT code,date,{r6('ma')} AS ma12 FROM (SELECT *,{full_sql('avg', 'close', 12)} AS ma FROM bars) WHERE date>='1998-01-01' AND date<='1998-12-31'"))
def scan_with_buffer(t):
    """Trailing window on a date range: narrowed early (with warm-up), cut exactly late.

    The buffer counts calendar time; a symbol with gaps may need more rows, so it is generous.
    """
    wide, exact = J.with_buffer(t.bars_m, "1998-01-01", "1998-12-31", 4 * 366, 0)
    return wide.withColumn("ma12", mean_n("close", 12)).where(exact).select("code", "date", r("ma12").alias("ma12"))
