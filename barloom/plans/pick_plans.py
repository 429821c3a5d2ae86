"""Return statistics and rule-based pick evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.frames import change, div
from barloom.operators import joins as J
from barloom.operators import metrics as M
from barloom.operators import picks as P
from barloom.operators.bars import equal_weight_index
from barloom.operators.ranking import top_k
from barloom.plans.registry import BARS_D_SQL, BARS_M_SQL, SUPPLIERS_SQL, W, daily, on_bars, query, r, r6, with_, wn

LAG = f"lag(close) OVER ({W})"
# monthly returns per nation (variant): equal-weight mean of member returns, damped to stay positive
VAR_SQL = f"vr AS MATERIALIZED (SELECT industry AS variant,date,avg(ret)/500 AS ret FROM (SELECT code,date,close/{LAG}-1 AS ret FROM bars) JOIN suppliers USING (code) WHERE ret IS NOT NULL GROUP BY 1,2)"
CURVE_SQL = "{n} AS MATERIALIZED (SELECT *,eq/max(eq) OVER (PARTITION BY {by} ORDER BY date)-1 AS dd FROM (SELECT *,product(1+ret) OVER (PARTITION BY {by} ORDER BY date) AS eq FROM {src}))"


def variants(t):
    b = t.bars_m.withColumn("ret", change("close")).where("ret is not null")
    return b.join(t.suppliers.select("code", F.col("industry").alias("variant")), "code").groupBy("variant", "date").agg((F.avg("ret") / 500.0).alias("ret"))


def stat_cols(df, *by):
    return df.select(*by, "n", *[r(c).alias(c) for c in ("total", "ann", "vol", "sharpe", "mdd", "calmar", "win")])


def stats_sql(by: str, src: str, periods: float = 12, sharpe: str = "mean", win: str = "all", extra: str = "") -> str:
    tot = "arg_max(eq,date)-1"
    ann = f"power({tot}+1,{periods}.0/count(*))-1"
    vol = f"stddev_samp(ret)*sqrt({periods})"
    sh = f"avg(ret)/stddev_samp(ret)*sqrt({periods})" if sharpe == "mean" else f"({ann})/({vol})"
    wn_ = "count(*) FILTER (WHERE ret>0)/CAST(greatest(1,count(*) FILTER (WHERE ret<>0)) AS DOUBLE)" if win == "nonzero" else "count(*) FILTER (WHERE ret>0)/CAST(count(*) AS DOUBLE)"
    return f"""SELECT {by},count(*) AS n,{r6(tot)} AS total,{r6(ann)} AS ann,{r6(vol)} AS vol,{r6(f'CASE WHEN stddev_samp(ret)>0 THEN {sh} ELSE 0 END')} AS sharpe,{r6('min(dd)')} AS mdd,
{r6(f'CASE WHEN min(dd)<0 THEN ({ann})/abs(min(dd)) ELSE 0 END')} AS calmar,{r6(wn_)} AS win FROM {src} GROUP BY {by} {extra}"""


VBASE = [BARS_M_SQL, SUPPLIERS_SQL, VAR_SQL]


@query("metric_compounded", with_(*VBASE) + f"SELECT variant,CAST(year(date) AS INTEGER) AS y,{r6('product(1+ret)-1')} AS ret FROM vr GROUP BY 1,2")
def metric_compounded(t):
    return variants(t).groupBy("variant", F.year("date").alias("y")).agg(r(M.compounded("ret")).alias("ret"))


@query("metric_return_stats", with_(*VBASE, CURVE_SQL.format(n="cv", by="variant", src="vr")) + stats_sql("variant", "cv"))
def metric_return_stats(t):
    return stat_cols(M.return_stats(variants(t), "ret", ["variant"]), "variant")


@query("metric_return_stats_daily", with_(*VBASE, CURVE_SQL.format(n="cv", by="variant", src="vr")) + stats_sql("variant", "cv", 252, "ann", "nonzero"))
def metric_return_stats_daily(t):
    """Variant basis: Sharpe as annual return over volatility, wins among non-zero periods."""
    return stat_cols(M.return_stats(variants(t), "ret", ["variant"], periods=252, sharpe="ann", win="nonzero"), "variant")


IDX_SQL = "ix AS (SELECT date,c/lag(c) OVER (ORDER BY date)-1 AS b FROM (SELECT date,avg(close) AS c FROM bars GROUP BY 1))"


@query("metric_attribution", with_(*VBASE, IDX_SQL, """aj AS (SELECT variant,date,ret,b,row_number() OVER w AS i,sum(ln(1+ret)) OVER w AS lg FROM vr JOIN ix USING (date) WHERE b IS NOT NULL WINDOW w AS (PARTITION BY variant ORDER BY date)),
v AS (SELECT variant,quantile_cont(ret,0.05) AS q5,quantile_cont(ret,0.95) AS q95 FROM aj GROUP BY 1)""") + f"""SELECT variant,count(*) AS n,{r6('power(product(1+ret),252.0/count(*))-1')} AS annual_return,{r6('stddev_samp(ret)*sqrt(252)')} AS annual_vol,
{r6('avg(ret)*252/(sqrt(avg(power(least(ret,0),2)))*sqrt(252))')} AS sortino,{r6('sum(greatest(ret,0))/sum(greatest(-ret,0))')} AS omega,{r6('abs(max(q95))/abs(max(q5))')} AS tail_ratio,{r6('power(corr(lg,i),2)')} AS stability,
{r6('max(q5)')} AS var_95,{r6('avg(CASE WHEN ret<=q5 THEN ret END)')} AS cvar_95,{r6('power(1+regr_intercept(ret,b),252)-1')} AS alpha,{r6('regr_slope(ret,b)')} AS beta,{r6('sqrt(avg(power(least(ret,0),2)))*sqrt(252)')} AS downside_risk,
{r6('avg(ret-b)/stddev_samp(ret-b)')} AS excess_sharpe FROM aj JOIN v USING (variant) GROUP BY 1""")
def metric_attribution(t):
    idx = t.bars_m.groupBy("date").agg(F.avg("close").alias("c"))
    idx = idx.withColumn("b", div("c", F.lag("c").over(Window.orderBy("date"))) - 1.0).select("date", "b")
    a = M.attribution(variants(t).join(F.broadcast(idx), "date"), "ret", "b", ["variant"])
    return a.select("variant", "n", *[r(c).alias(c) for c in a.columns if c not in ("variant", "n")])


REG_SQL = "rg AS (SELECT * FROM (VALUES ('early',DATE '1995-01-01',DATE '1996-12-31'),('middle',DATE '1996-06-01',DATE '1999-06-30'),('late',DATE '1999-07-01',DATE '2001-12-31')) v(regime,s,e)),tg AS (SELECT variant,regime,date,ret FROM vr JOIN rg ON date>=s AND date<=e)"


@query("metric_by_regime", with_(*VBASE, REG_SQL, CURVE_SQL.format(n="cv", by="variant,regime", src="tg")) + stats_sql("variant,regime", "cv"))
def metric_by_regime(t):
    rows = [("early", "1995-01-01", "1996-12-31"), ("middle", "1996-06-01", "1999-06-30"), ("late", "1999-07-01", "2001-12-31")]
    reg = t.spark.createDataFrame(rows, "name string, start string, end string").select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return stat_cols(M.by_regime(variants(t), reg, "ret", ["variant"]), "variant", "regime")


BKT_SQL = "bk AS (SELECT variant,date,ret,CAST(least(floor((row_number() OVER (PARTITION BY variant ORDER BY date)-1)/CAST(floor(count(*) OVER (PARTITION BY variant)/5) AS DOUBLE)),4) AS INTEGER) AS bucket FROM vr)"


@query("metric_by_bucket", with_(*VBASE, BKT_SQL, CURVE_SQL.format(n="cv", by="variant,bucket", src="bk")) + stats_sql("variant,bucket", "cv"))
def metric_by_bucket(t):
    return stat_cols(M.by_bucket(variants(t), "ret", ["variant"]), "variant", "bucket")


@query("metric_span_ranks", with_(*VBASE, "sp AS (SELECT *,CASE WHEN date>='1999-01-01' THEN 'holdout' ELSE 'selection' END AS span FROM vr)", CURVE_SQL.format(n="cv", by="variant,span", src="sp")) +
       f"SELECT variant,span,{r6('c')} AS calmar,row_number() OVER (PARTITION BY span ORDER BY c DESC,variant) AS rank FROM (SELECT variant,span,CASE WHEN min(dd)<0 THEN (power(arg_max(eq,date),12.0/count(*))-1)/abs(min(dd)) ELSE 0 END AS c FROM cv GROUP BY 1,2)")
def metric_span_ranks(t):
    s = M.span_ranks(variants(t), "ret", "variant", F.col("date") >= "1999-01-01")
    return s.select("variant", "span", r("calmar").alias("calmar"), "rank")


@query("metric_cagr", on_bars(f"SELECT code,{r6('power(arg_max(close,date)/arg_min(close,date),365.0/date_diff(chr(100)||chr(97)||chr(121),min(date),max(date)))-1')} AS cagr FROM bars GROUP BY 1".replace("chr(100)||chr(97)||chr(121)", "'day'")))
def metric_cagr(t):
    return M.cagr(t.bars_m, "close", ["code"]).select("code", r("cagr").alias("cagr"))


@query("metric_portfolio_risk", on_bars(f"SELECT count(p) AS n,{r6('stddev_samp(p)*sqrt(252)*100', 4)} AS vol_pct,{r6('-quantile_cont(p,0.05)*100')} AS var95_pct,{r6('covar_samp(p,b)/var_samp(CASE WHEN p IS NOT NULL THEN b END)')} AS beta FROM (SELECT date,avg(ret) AS p FROM (SELECT date,close/{LAG}-1 AS ret FROM bars) WHERE ret IS NOT NULL GROUP BY 1) LEFT JOIN ix USING (date)", IDX_SQL))
def metric_portfolio_risk(t):
    idx = t.bars_m.groupBy("date").agg(F.avg("close").alias("c"))
    idx = idx.select("date", (div("c", F.lag("c").over(Window.orderBy("date"))) - 1.0).alias("bench_ret"))
    m = M.portfolio_risk(t.bars_m.withColumn("ret", change("close")), idx)
    return m.select("n", r("vol_pct", 4).alias("vol_pct"), r("var95_pct").alias("var95_pct"), r("beta").alias("beta"))


# --- picks -----------------------------------------------------------------
CAL_SQL = "cal AS (SELECT date,row_number() OVER (ORDER BY date)-1 AS i,count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM bars)),bc AS MATERIALIZED (SELECT b.*,i,nd FROM bars b JOIN cal USING (date))"
DAY_COLS = "n_picks,{g} AS gross_ret,{n} AS net_ret".format(g=r6("g"), n=r6("g-CASE WHEN n_picks>0 THEN 0.0025 ELSE 0 END"))


def daily_sql(lo: int, hi: int, src: str) -> str:
    return f"SELECT date,{DAY_COLS} FROM (SELECT cal.date,coalesce(n,0) AS n_picks,coalesce(g,0) AS g FROM cal LEFT JOIN (SELECT date,count(*) AS n,avg(ret) AS g FROM {src} WHERE ret IS NOT NULL GROUP BY 1) p ON p.date=cal.date WHERE i>={lo} AND i<nd-{hi})"


TOPS = "(SELECT *,row_number() OVER (PARTITION BY date ORDER BY volume DESC,code) AS k FROM bc)"


def pick_out(df):
    return df.select("date", "n_picks", r("gross_ret").alias("gross_ret"), r("net_ret").alias("net_ret"))


@query("pick_daily_close_to_open", on_bars(daily_sql(12, 1, "pk"), CAL_SQL, f"pk AS (SELECT s.date,CASE WHEN s.close>0 THEN o.open/s.close-1 END AS ret FROM {TOPS} s LEFT JOIN bc o ON o.code=s.code AND o.i=s.i+1 WHERE k<=10)"))
def pick_daily_close_to_open(t):
    return pick_out(P.daily_picks(t.bars_m, "volume", picks=10, warmup=12))


@query("pick_daily_open_to_open", on_bars(daily_sql(12, 2, "pk"), CAL_SQL, f"pk AS (SELECT s.date,CASE WHEN o.open>0 THEN x.open/o.open-1 END AS ret FROM {TOPS} s LEFT JOIN bc o ON o.code=s.code AND o.i=s.i+1 LEFT JOIN bc x ON x.code=s.code AND x.i=s.i+2 WHERE k<=10)"))
def pick_daily_open_to_open(t):
    return pick_out(P.daily_picks(t.bars_m, "volume", picks=10, entry="open_t1", exit_="open_t2", warmup=12))


HOLD_SQL = "(SELECT s.date,s.i,s.k,CASE WHEN o.open>0 THEN CASE WHEN (SELECT min(low) FROM bc l WHERE l.code=s.code AND l.i BETWEEN s.i+2 AND s.i+1+{h})<o.open*0.7 THEN -0.3 ELSE x.open/o.open-1 END END AS ret FROM " + TOPS + " s LEFT JOIN bc o ON o.code=s.code AND o.i=s.i+1 LEFT JOIN bc x ON x.code=s.code AND x.i=s.i+1+{h} WHERE k<={k})"


@query("pick_multi_day_stop", on_bars(daily_sql(12, 5, "pk"), CAL_SQL, "pk AS " + HOLD_SQL.format(h=3, k=10)))
def pick_multi_day_stop(t):
    return pick_out(P.multi_day_picks(t.bars_m, "volume", picks=10, hold=3, stop=-0.3, warmup=12))


CONFS = [(3, 5), (3, 10), (6, 5)]


@query("pick_periodic_grid", on_bars(" UNION ALL ".join(
    f"SELECT {rb} AS rebalance,{k} AS picks,date,{DAY_COLS} FROM (SELECT cal.date,coalesce(n,0) AS n_picks,coalesce(g,0) AS g FROM cal LEFT JOIN (SELECT date,count(*) AS n,avg(ret) AS g FROM {HOLD_SQL.format(h=rb, k=k)} WHERE ret IS NOT NULL GROUP BY 1) p ON p.date=cal.date WHERE i%{rb}=0 AND i+1+{rb}<nd)" for rb, k in CONFS), CAL_SQL))
def pick_periodic_grid(t):
    """All (rebalance, picks) configurations in one job."""
    g = P.periodic_picks(t.bars_m, "volume", CONFS, stop=-0.3)
    return g.select("rebalance", "picks", "date", "n_picks", r("gross_ret").alias("gross_ret"), r("net_ret").alias("net_ret"))


@query("pick_grid_ranked", on_bars(f"SELECT rebalance,picks,n,{r6('tot')} AS total,row_number() OVER (ORDER BY tot DESC,rebalance,picks) AS rank FROM (SELECT rebalance,picks,count(*) AS n,product(1+net/20)-1 AS tot FROM (" + " UNION ALL ".join(
    f"SELECT {rb} AS rebalance,{k} AS picks,g-CASE WHEN n_picks>0 THEN 0.0025 ELSE 0 END AS net FROM (SELECT cal.date,coalesce(n,0) AS n_picks,coalesce(g,0) AS g FROM cal LEFT JOIN (SELECT date,count(*) AS n,avg(ret) AS g FROM {HOLD_SQL.format(h=rb, k=k)} WHERE ret IS NOT NULL GROUP BY 1) p ON p.date=cal.date WHERE i%{rb}=0 AND i+1+{rb}<nd)" for rb, k in CONFS) + ") GROUP BY 1,2)", CAL_SQL))
def pick_grid_ranked(t):
    g = P.periodic_picks(t.bars_m, "volume", CONFS, stop=-0.3).withColumn("x", F.col("net_ret") / 20.0)
    s = g.groupBy("rebalance", "picks").agg(F.count(F.lit(1)).alias("n"), M.compounded("x").alias("total"))
    w = Window.orderBy(F.desc("total"), "rebalance", "picks")  # one row per configuration
    return s.select("rebalance", "picks", "n", r("total").alias("total"), F.row_number().over(w).alias("rank"))


@query("pick_valuation_overlay", on_bars(f"SELECT date,CASE WHEN pe>35 OR pb>3 THEN 0 WHEN pe>30 OR pb>2.6 THEN 3 ELSE 5 END AS n_picks,CAST(CASE WHEN pe>35 OR pb>3 THEN 0 WHEN pe>30 OR pb>2.6 THEN 0.6 ELSE 1 END AS DOUBLE) AS budget FROM (SELECT date,avg(close)/150 AS pe,avg(high)/avg(low) AS pb FROM bars GROUP BY 1)"))
def pick_valuation_overlay(t):
    m = t.bars_m.groupBy("date").agg((F.avg("close") / 150.0).alias("pe"), (F.avg("high") / F.avg("low")).alias("pb"))
    return m.select("date", *[c.alias(n) for n, c in P.valuation_overlay().items()])


LADDER_SQL = "lad AS (SELECT date,CASE WHEN pe>45 OR pb>1.6 THEN 0 WHEN pe>38 OR pb>1.45 THEN 3 ELSE 5 END AS want,CASE WHEN pe>45 OR pb>1.6 THEN 0 WHEN pe>38 OR pb>1.45 THEN 0.6 ELSE 1 END AS budget FROM (SELECT date,avg(close)/150 AS pe,avg(high)/avg(low)/20 AS pb FROM bars GROUP BY 1))"
APPLIED_SQL = """ap AS (SELECT cal.date,want,budget,pool,n,g,CASE WHEN want=0 THEN 'empty' WHEN pool IS NULL THEN 'no_data' WHEN pool<want THEN 'insufficient' WHEN n IS NULL THEN 'no_valid' WHEN budget>=0.99 THEN 'normal' ELSE 'light' END AS regime
FROM cal JOIN lad USING (date) LEFT JOIN (SELECT date,count(*) AS pool FROM bars GROUP BY 1) USING (date) LEFT JOIN (SELECT h.date,count(*) AS n,avg(h.ret) AS g FROM pk h JOIN lad l ON l.date=h.date WHERE h.k<=l.want AND h.ret IS NOT NULL GROUP BY 1) USING (date) WHERE i%3=0 AND i+1+3<nd)"""


@query("pick_overlay_applied", on_bars(f"SELECT date,CASE WHEN regime IN ('normal','light') THEN n ELSE 0 END AS n_picks,{r6('CASE WHEN regime IN (' + chr(39) + 'normal' + chr(39) + ',' + chr(39) + 'light' + chr(39) + ') THEN g*budget ELSE 0 END')} AS gross_ret,{r6('CASE WHEN regime IN (' + chr(39) + 'normal' + chr(39) + ',' + chr(39) + 'light' + chr(39) + ') THEN (g-0.0025)*budget ELSE 0 END')} AS net_ret,regime FROM ap", CAL_SQL, LADDER_SQL, "pk AS " + HOLD_SQL.format(h=3, k=5), APPLIED_SQL))
def pick_overlay_applied(t):
    """The valuation ladder limits the picks of a date and scales its return."""
    m = t.bars_m.groupBy("date").agg((F.avg("close") / 150.0).alias("pe"), (F.avg("high") / F.avg("low") / 20.0).alias("pb"))
    steps = P.valuation_overlay(empty=(45.0, 1.6), light=(38.0, 1.45))
    out = P.overlay_picks(t.bars_m, "volume", m.select("date", *[c.alias(n) for n, c in steps.items()]), hold=3, stop=-0.3)
    return out.select("date", "n_picks", r("gross_ret").alias("gross_ret"), r("net_ret").alias("net_ret"), "regime")


@query("pick_benchmark_excess", on_bars(f"SELECT date,{r6('c/lag(c) OVER (ORDER BY date)-1')} AS bench_ret,{r6('g-(c/lag(c) OVER (ORDER BY date)-1)')} AS excess FROM (SELECT date,avg(close) AS c FROM bars GROUP BY 1) LEFT JOIN (SELECT date,avg(ret) AS g FROM (SELECT date,close/{LAG}-1 AS ret,row_number() OVER (PARTITION BY date ORDER BY volume DESC,code) AS k FROM bars) WHERE k<=10 GROUP BY 1) USING (date)"))
def pick_benchmark_excess(t):
    idx = equal_weight_index(t.bars_m).withColumn("bench_ret", div("close", F.lag("close").over(Window.orderBy("date"))) - 1.0)
    top = top_k(t.bars_m.withColumn("ret", change("close")), ["date"], [F.desc("volume"), F.asc("code")], 10)
    g = top.groupBy("date").agg(F.avg("ret").alias("g"))
    return idx.join(g, "date", "left").select("date", r("bench_ret").alias("bench_ret"), r(F.col("g") - F.col("bench_ret")).alias("excess"))


@query("pick_market_regime", on_bars(f"""SELECT code,date,CASE WHEN rn<=24 THEN 'normal' WHEN close<ma*0.95 THEN 'bear' WHEN v>4.5 THEN 'panic' WHEN close/lag(close,6) OVER ({W})-1<-0.15 THEN 'drawdown' ELSE 'normal' END AS regime FROM
(SELECT *,row_number() OVER ({W}) AS rn,avg(close) OVER {wn(24)} AS ma,stddev_samp(ret) OVER {wn(9)}*sqrt(12) AS v FROM (SELECT *,close/{LAG}-1 AS ret FROM bars))"""))
def pick_market_regime(t):
    m = P.market_regime(t.bars_m, ma=24, vol_n=10, panic=4.5, dd_n=6, periods=12, key="code")
    return m.select("code", "date", "regime")


@query("pick_market_regime_daily", daily(on_bars(f"""SELECT code,date,CASE WHEN rn<=200 THEN 'normal' WHEN close<ma*0.95 THEN 'bear' WHEN v>0.35 THEN 'panic' WHEN close/lag(close,60) OVER ({W})-1<-0.15 THEN 'drawdown' ELSE 'normal' END AS regime FROM
(SELECT *,row_number() OVER ({W}) AS rn,avg(close) OVER {wn(200)} AS ma,stddev_samp(ret) OVER {wn(19)}*sqrt(252) AS v FROM (SELECT *,close/{LAG}-1 AS ret FROM bars))""")))
def pick_market_regime_daily(t):
    """Default lengths on daily bars."""
    return P.market_regime(t.bars_s, key="code").select("code", "date", "regime")


@query("pick_vol_target", on_bars(f"SELECT code,date,{r6('CASE WHEN rn>12 THEN least(2.0/greatest(v,0.05),1) ELSE 1 END')} AS vol_scale FROM (SELECT *,row_number() OVER ({W}) AS rn,stddev_samp(ret) OVER {wn(11)}*sqrt(12) AS v FROM (SELECT *,close/{LAG}-1 AS ret FROM bars))"))
def pick_vol_target(t):
    return P.vol_target(t.bars_m, target=2.0, n=12, periods=12, key="code").select("code", "date", r("vol_scale").alias("vol_scale"))


@query("pick_two_sleeves", with_(*VBASE, "pv AS (SELECT date,avg(ret) AS p FROM vr GROUP BY 1)", "sl AS (SELECT variant,date,ret,p,0.5*product(1+ret) OVER w AS a,0.5*product(1+p) OVER w AS b FROM vr JOIN pv USING (date) WINDOW w AS (PARTITION BY variant ORDER BY date))") +
       f"SELECT variant,date,{r6('0.5*ret+0.5*p')} AS rebalanced,{r6('(a+b)/coalesce(lag(a+b) OVER (PARTITION BY variant ORDER BY date),1)-1')} AS drift_ret,{r6('a/(a+b)')} AS w_active FROM sl")
def pick_two_sleeves(t):
    v = variants(t)
    p = v.groupBy("date").agg(F.avg("ret").alias("p"))
    s = P.two_sleeves(v.join(F.broadcast(p), "date"), "ret", "p", key="variant")
    return s.select("variant", "date", r("rebalanced").alias("rebalanced"), r("drift_ret").alias("drift_ret"), r("w_active").alias("w_active"))


@query("pick_accuracy", on_bars(f"""SELECT s.code,s.date,{r6('(n1/close-1)*100', 5)} AS ret_t1,{r6('(n5/close-1)*100', 5)} AS ret_t5,{r6('(i1/i0-1)*100')} AS bench_t1,{r6('(n1/close-1)*100-(i1/i0-1)*100', 5)} AS alpha_t1,
coalesce(abs((n1/close-1)*100)>25,false) OR coalesce(abs((n5/close-1)*100)>25,false) AS is_artifact FROM (SELECT *,lead(close,1) OVER ({W}) AS n1,lead(close,5) OVER ({W}) AS n5,row_number() OVER (PARTITION BY date ORDER BY volume DESC,code) AS k FROM bars) s JOIN ix USING (date) WHERE k<=10""",
       "ix AS (SELECT date,c AS i0,lead(c,1) OVER (ORDER BY date) AS i1,lead(c,5) OVER (ORDER BY date) AS i5 FROM (SELECT date,avg(close) AS c FROM bars GROUP BY 1))"))
def pick_accuracy(t):
    b = t.bars_m
    w = Window.orderBy("date")
    idx = b.groupBy("date").agg(F.avg("close").alias("i0")).withColumns({"i1": F.lead("i0", 1).over(w), "i5": F.lead("i0", 5).over(w)})
    top = top_k(b, ["date"], [F.desc("volume"), F.asc("code")], 10).select("code", "date", F.col("close").alias("price"))
    hit = J.nth_row_after(top, b, [1, 5])
    a = P.pick_accuracy(hit, idx)
    return a.select("code", "date", r("ret_t1", 5).alias("ret_t1"), r("ret_t5", 5).alias("ret_t5"), r("bench_t1").alias("bench_t1"), r("alpha_t1", 5).alias("alpha_t1"), "is_artifact")


MT_SQL = """pk AS (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR),6,'0') AS code,CAST(date_trunc('month',ts) AS DATE) AS month FROM events WHERE event_type='purchase'),
mo AS (SELECT code,CAST(date_trunc('month',date) AS DATE) AS month,arg_min(close,date) AS a,arg_max(close,date) AS b FROM bars GROUP BY 1,2)"""


@query("pick_monthly_track", with_(BARS_D_SQL, MT_SQL) + f"""SELECT month,n AS n_picks,{r6('m')} AS monthly_return,{r6('c-1')} AS cum_return,{r6('50000*c', 3)} AS end_value,{r6('50000*c/(1+m)', 3)} AS start_value FROM
(SELECT *,product(1+m) OVER (ORDER BY month) AS c FROM (SELECT month,count(*) AS n,avg(CASE WHEN a>0 THEN b/a-1 ELSE 0 END) AS m FROM pk LEFT JOIN mo USING (code,month) GROUP BY 1))""")
def pick_monthly_track(t):
    e = t.table("events").where("event_type = 'purchase'")
    pk = e.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), F.trunc(F.to_date("ts"), "month").alias("month")).distinct()
    m = P.monthly_track(pk, t.bars_d)
    return m.select("month", "n_picks", *[r(c).alias(c) for c in ("monthly_return", "cum_return")], r("end_value", 3).alias("end_value"), r("start_value", 3).alias("start_value"))


@query("pick_track_statistics", with_(*VBASE, CURVE_SQL.format(n="cv", by="variant", src="vr")) + f"""SELECT variant,n,{r6('cum')} AS cum,{r6('CASE WHEN n>=82 THEN ann END')} AS ann,{r6('CASE WHEN n>=83 THEN sharpe END')} AS sharpe,{r6('CASE WHEN n>=82 THEN mdd END')} AS mdd FROM
(SELECT variant,count(*) AS n,arg_max(eq,date)-1 AS cum,power(arg_max(eq,date),12.0/count(*))-1 AS ann,avg(ret)/stddev_samp(ret)*sqrt(12) AS sharpe,min(dd) AS mdd FROM cv GROUP BY 1)""")
def pick_track_statistics(t):
    """Statistics hidden until enough periods exist (thresholds near the data's length so that both sides occur)."""
    s = M.return_stats(variants(t), "ret", ["variant"], undefined=None)
    gate = lambda c, k: F.when(F.col("n") >= k, F.col(c))
    return s.select("variant", "n", r("total").alias("cum"), r(gate("ann", 82)).alias("ann"), r(gate("sharpe", 83)).alias("sharpe"), r(gate("mdd", 82)).alias("mdd"))


@query("pick_daily_curve", on_bars(f"""SELECT d AS date,{r6('s+(e-s)*(rk-1)/greatest(n-1,1)', 4)} AS portfolio_value FROM (SELECT s,e,d,row_number() OVER (PARTITION BY m ORDER BY d) AS rk,count(*) OVER (PARTITION BY m) AS n FROM
(SELECT date AS m,avg(open) AS s,avg(close) AS e,CAST(UNNEST(generate_series(CAST(date AS TIMESTAMP),CAST(last_day(date) AS TIMESTAMP),INTERVAL 1 DAY)) AS DATE) AS d FROM bars GROUP BY 1) WHERE dayofweek(d) BETWEEN 1 AND 5)"""))
def pick_daily_curve(t):
    tr = t.bars_m.groupBy("date").agg(F.avg("open").alias("start_value"), F.avg("close").alias("end_value"))
    tr = tr.select(F.col("date").alias("start_date"), F.last_day("date").alias("end_date"), "start_value", "end_value")
    return P.daily_curve(tr).select("date", r("portfolio_value", 4).alias("portfolio_value"))


@query("pick_adaptive_k", on_bars("""SELECT date,code,rank,k FROM (SELECT *,CAST(CASE WHEN n<=3 OR zs IS NULL THEN 8 WHEN zs>=1 THEN 3 WHEN zs<=0.5 THEN 8 ELSE greatest(3,round_even(8-(zs-0.5)/0.5*5,0)) END AS INTEGER) AS k FROM
(SELECT *,stddev_samp(z) OVER (PARTITION BY date) AS zs,count(z) OVER (PARTITION BY date) AS n FROM (SELECT date,code,row_number() OVER (PARTITION BY date ORDER BY amount DESC,code) AS rank,(amount-avg(amount) OVER (PARTITION BY date))/stddev_samp(amount) OVER (PARTITION BY date) AS z FROM bars) WHERE rank<=32)) WHERE rank<=k"""))
def pick_adaptive_k(t):
    return P.adaptive_k(t.bars_m, "amount").select("date", "code", "rank", "k")
