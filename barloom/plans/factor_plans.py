"""Factor library over monthly bars, reports and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.frames import change
from barloom.operators import crosssec as C
from barloom.operators import factors as A
from barloom.operators import joins as J
from barloom.operators.panels import EVENTS
from barloom.plans.indicator_plans import pick
from barloom.plans.join_plans import amp_sql, z_sql
from barloom.plans.registry import (
    ANN_SQL, BARS_M_SQL, MACD_SQL, NUMBERED_SQL, SUPPLIERS_SQL, TRADES_SQL, W, ewm_sql, full_sql, daily, kdj_sql, on_bars, query, r,
    r6, rsi_sql, with_, wn, wp,
)
from barloom.session import tasks_for
from barloom.sources import sinks

LAG = f"lag(close) OVER ({W})"
RET_SQL = f"rt AS (SELECT *,close/{LAG}-1 AS ret,row_number() OVER ({W}) AS rn FROM bars)"


@query("factor_team_coin", on_bars(f"SELECT code,date,{r6('a.team_coin')} AS team_coin_5,{r6('b.team_coin')} AS team_coin_20 FROM a JOIN b USING (code,date)", amp_sql(5, "a"), amp_sql(20, "b")))
def factor_team_coin(t):
    return pick(A.team_coin(t.bars_m, 5, 20), "team_coin_5", "team_coin_20")


@query("factor_amp_imb", on_bars(f"SELECT code,date,{r6('a.amp_imb')} AS amp_imb_5,{r6('b.amp_imb')} AS amp_imb_20 FROM a JOIN b USING (code,date)", amp_sql(5, "a"), amp_sql(20, "b")))
def factor_amp_imb(t):
    return pick(A.amplitude_imbalance(t.bars_m, 5, 20), "amp_imb_5", "amp_imb_20")


@query("factor_overnight_gap", on_bars(f"SELECT code,date,{r6(f'(open-{LAG})/{LAG}*100')} AS jzf FROM bars"))
def factor_overnight_gap(t):
    return pick(t.bars_m.withColumn("jzf", A.overnight_gap()), "jzf")


@query("factor_ibs", on_bars("SELECT code,date," + r6("ibs") + " AS ibs," + ",".join(f"{r6(full_sql('avg', 'ibs', n, wp(n)))} AS ibs_{n}" for n in (5, 10, 20, 60)) +
       " FROM (SELECT *,(close-low)/nullif(high-low,0) AS ibs FROM bars)"))
def factor_ibs(t):
    return pick(A.internal_bar_strength(t.bars_m, 5, 10, 20, 60), "ibs", "ibs_5", "ibs_10", "ibs_20", "ibs_60")


@query("factor_amihud", on_bars(f"SELECT code,date,{r6(full_sql('avg', 'i', 20, wp(20)))} AS amihud_20 FROM (SELECT *,1e6*abs(close/{LAG}-1)/nullif(close*volume,0) AS i FROM bars)"))
def factor_amihud(t):
    return pick(A.amihud(t.bars_m).withColumn("amihud_20", F.col("amihud_20") * 1e6), "amihud_20")


@query("factor_high_distance", on_bars("SELECT code,date," + ",".join(f"{r6(f'close/{full_sql(chr(109)+chr(97)+chr(120), chr(99)+chr(108)+chr(111)+chr(115)+chr(101), n, wp(n))}-1')} AS high_{n}" for n in (20, 60)) + " FROM bars"))
def factor_high_distance(t):
    return pick(t.bars_m.withColumns({f"high_{n}": A.high_distance(n) for n in (20, 60)}), "high_20", "high_60")


@query("factor_high_distance_daily", daily(on_bars("SELECT code,date," + ",".join(f"{r6(f'close/{full_sql(chr(109)+chr(97)+chr(120), chr(99)+chr(108)+chr(111)+chr(115)+chr(101), n, wp(n))}-1')} AS high_{n}" for n in (20, 60, 252)) + " FROM bars")))
def factor_high_distance_daily(t):
    """Distance from the high of 20, 60 and 252 days."""
    return pick(t.bars_s.withColumns({f"high_{n}": A.high_distance(n) for n in (20, 60, 252)}), "high_20", "high_60", "high_252")


@query("factor_idio_vol", on_bars(f"SELECT code,date,{r6(full_sql('stddev_samp', 'ex', 20))} AS idio_vol_20 FROM (SELECT *,ret-avg(ret) OVER (PARTITION BY date) AS ex FROM rt)", RET_SQL))
def factor_idio_vol(t):
    return pick(A.idiosyncratic_vol(t.bars_m), "idio_vol_20")


@query("factor_rsi_wilder", with_(BARS_M_SQL, f"nb AS MATERIALIZED (SELECT *,row_number() OVER ({W}) AS rn,CASE WHEN {LAG} IS NOT NULL THEN greatest(close-{LAG},0) END AS g,CASE WHEN {LAG} IS NOT NULL THEN greatest({LAG}-close,0) END AS l FROM bars)",
       ewm_sql("e", "nb", {"ag": ("g", 1 / 14), "al": ("l", 1 / 14)}), recursive=True) +
       f"SELECT code,date,{r6('CASE WHEN rn>14 THEN 100-100/(1+ag/nullif(al,0)) END')} AS rsi_wilder FROM nb JOIN e USING (code,rn)")
def factor_rsi_wilder(t):
    return pick(A.rsi_wilder(t.bars_m), "rsi_wilder")


@query("factor_bb_position", on_bars(f"SELECT code,date,{r6('(close-' + full_sql('avg', 'close', 20) + ')/nullif(' + full_sql('stddev_samp', 'close', 20) + ',0)')} AS bb_pos FROM bars"))
def factor_bb_position(t):
    return pick(t.bars_m.withColumn("bb_pos", A.bollinger_position()), "bb_pos")


@query("factor_williams_r", on_bars(f"SELECT code,date,{r6('(hh-close)/nullif(hh-ll,0)*-100')} AS williams_r FROM (SELECT *,{full_sql('max', 'high', 14)} AS hh,{full_sql('min', 'low', 14)} AS ll FROM bars)"))
def factor_williams_r(t):
    return pick(t.bars_m.withColumn("williams_r", A.williams_r()), "williams_r")


@query("factor_mfi", on_bars(f"SELECT code,date,{r6('100-100/(1+' + full_sql('sum', 'p', 14) + '/nullif(' + full_sql('sum', 'q', 14) + ',0))')} AS mfi FROM (SELECT *,CASE WHEN tp>lag(tp) OVER ({W}) THEN tp*volume ELSE 0 END AS p,CASE WHEN tp<lag(tp) OVER ({W}) THEN tp*volume ELSE 0 END AS q FROM (SELECT *,(high+low+close)/3 AS tp FROM bars))"))
def factor_mfi(t):
    return pick(A.money_flow_index(t.bars_m), "mfi")


@query("factor_obv_slope", on_bars(f"""SELECT code,date,{r6(f'CASE WHEN rn>=60 THEN covar_samp(obv,rn) OVER {wn(60)}/var_samp(rn) OVER {wn(60)} END')} AS obv_slope_60 FROM
(SELECT *,sum(sv) OVER ({W}) AS obv FROM (SELECT *,row_number() OVER ({W}) AS rn,coalesce(sign(close-{LAG}),0)*volume AS sv FROM bars))"""))
def factor_obv_slope(t):
    return pick(A.obv_slope(t.bars_m), "obv_slope_60")


@query("factor_realized_vol", on_bars("SELECT code,date," + ",".join(f"{r6('sqrt(' + full_sql('sum', 'sq', n) + ')')} AS rv_{n}" for n in (5, 20, 60)) + " FROM (SELECT *,ret*ret AS sq FROM rt)", RET_SQL))
def factor_realized_vol(t):
    return pick(A.realized_vol(t.bars_m, 5, 20, 60), "rv_5", "rv_20", "rv_60")


RV = ("rv_5", "rv_20", "rv_60")


@query("factor_realized_vol_clipped", on_bars("SELECT code,date," + ",".join(f"{r6(f'CASE WHEN {c} IS NOT NULL THEN greatest(least({c},hi_{c}),lo_{c}) END')} AS {c}" for c in RV) + " FROM rv,(SELECT " + ",".join(f"quantile_cont({c},0.005) AS lo_{c},quantile_cont({c},0.995) AS hi_{c}" for c in RV) + " FROM rv)",
       RET_SQL, "rv AS MATERIALIZED (SELECT code,date," + ",".join(f"sqrt({full_sql('sum', 'sq', n)}) AS rv_{n}" for n in (5, 20, 60)) + " FROM (SELECT *,ret*ret AS sq FROM rt))"))
def factor_realized_vol_clipped(t):
    """All three columns clipped at their own borders in one pass."""
    return pick(A.clip_quantiles(A.realized_vol(t.bars_m, 5, 20, 60).select("code", "date", *RV), RV), *RV)


@query("factor_clip_quantiles", on_bars(f"""SELECT code,date,{r6('CASE WHEN ret IS NOT NULL THEN greatest(least(ret,hi),lo) END')} AS ret FROM rt,
(SELECT quantile_cont(ret,0.005) AS lo,quantile_cont(ret,0.995) AS hi FROM rt)""", RET_SQL))
def factor_clip_quantiles(t):
    b = t.bars_m.withColumn("ret", change("close")).select("code", "date", "ret")
    return pick(A.clip_quantiles(b, ["ret"]), "ret")


@query("factor_max_returns", on_bars(f"""SELECT code,date,{r6(full_sql('max', 'ret', 5, wp(5)))} AS max_5,{r6(full_sql('max', 'ret', 20, wp(20)))} AS max_20,
{r6(f'CASE WHEN count(ret) OVER {wp(20)}>=20 THEN list_sum(list_reverse_sort(list(ret) OVER {wp(20)})[1:5])/5 END')} AS max_top5_20 FROM rt""", RET_SQL))
def factor_max_returns(t):
    return pick(A.max_returns(t.bars_m), "max_5", "max_20", "max_top5_20")


@query("factor_volume_z", on_bars("SELECT code,date," + ",".join(f"{r6(f'(volume-' + full_sql('avg', 'volume', n, wp(n)) + ')/nullif(' + full_sql('stddev_samp', 'volume', n, wp(n)) + ',0)')} AS vol_z_{n}" for n in (5, 20, 60)) +
       "," + ",".join(f"{r6(f'volume/CAST(nullif(lag(volume,{n}) OVER ({W}),0) AS DOUBLE)-1')} AS vol_chg_{n}" for n in (5, 20)) + " FROM bars"))
def factor_volume_z(t):
    return pick(A.volume_z(t.bars_m), "vol_z_5", "vol_z_20", "vol_z_60", "vol_chg_5", "vol_chg_20")


@query("factor_industry_adjusted", with_(BARS_M_SQL, SUPPLIERS_SQL, "cal AS (SELECT date,row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars))",
       "x AS (SELECT b.code,b.date,industry,b.close,i FROM bars b JOIN cal USING (date) JOIN suppliers USING (code))",
       "y AS (SELECT x.*,x.close/a.close-1 AS r5,x.close/b.close-1 AS r20 FROM x LEFT JOIN x a ON a.code=x.code AND a.i=x.i-5 LEFT JOIN x b ON b.code=x.code AND b.i=x.i-20)") +
       f"SELECT code,date,industry,{r6('r5-avg(r5) OVER (PARTITION BY date,industry)')} AS adj_ret_5,{r6('r20-avg(r20) OVER (PARTITION BY date,industry)')} AS adj_ret_20 FROM y")
def factor_industry_adjusted(t):
    d = A.industry_adjusted(t.bars_m, t.suppliers, (5, 20))
    return d.select("code", "date", "industry", r("adj_ret_5").alias("adj_ret_5"), r("adj_ret_20").alias("adj_ret_20"))


def board_events(t):
    """Billboard-like rows: one per trade, the order class as reason."""
    x = t.trades
    amt = F.col("price") * F.col("shares")
    return x.select(
        F.col("sym").alias("code"), "date", F.col("action").alias("reason"),
        F.when(F.col("action") == "BUY", amt).otherwise(-amt).alias("net_amt"),
        F.when(F.col("action") == "BUY", amt).otherwise(0.0).alias("buy_amt"),
        F.when(F.col("action") == "SELL", amt).otherwise(0.0).alias("sell_amt"),
        (amt * 2).alias("accum_amount"), F.col("shares").cast("double").alias("turnover_pct"), F.col("price").alias("change_rate"),
    )


EVD_SQL = """evd AS (SELECT code,date,sum(CASE WHEN action='BUY' THEN a ELSE -a END) AS net_amt,sum(CASE WHEN action='BUY' THEN a ELSE 0 END) AS buy_amt,
sum(CASE WHEN action='SELL' THEN a ELSE 0 END) AS sell_amt,max(a*2) AS accum_amount,max(CAST(shares AS DOUBLE)) AS turnover_pct,max(price) AS change_rate,count(*) AS n_reasons
FROM (SELECT *,sym AS code,price*shares AS a FROM trades) GROUP BY 1,2)"""


@query("agg_collapse_events", with_(TRADES_SQL, EVD_SQL) + f"""SELECT code,date,{r6('net_amt', 3)} AS net_amt,{r6('buy_amt', 3)} AS buy_amt,{r6('sell_amt', 3)} AS sell_amt,{r6('accum_amount', 3)} AS accum_amount,
turnover_pct,{r6('change_rate')} AS change_rate,n_reasons,{r6('net_amt/nullif(accum_amount,0)*100')} AS net_buy_pct,{r6('buy_amt/nullif(accum_amount,0)*100')} AS top_buyer_pct,{r6('sell_amt/nullif(accum_amount,0)*100')} AS top_seller_pct FROM evd""")
def agg_collapse_events(t):
    d = A.collapse_events(board_events(t))
    return d.select("code", "date", *[r(c, 3).alias(c) for c in ("net_amt", "buy_amt", "sell_amt", "accum_amount")], "turnover_pct",
                    r("change_rate").alias("change_rate"), "n_reasons", *[r(c).alias(c) for c in ("net_buy_pct", "top_buyer_pct", "top_seller_pct")])


@query("factor_event_features", with_(TRADES_SQL, EVD_SQL, "grid AS (SELECT code,date FROM (SELECT DISTINCT code FROM evd) CROSS JOIN (SELECT DISTINCT date FROM evd))",
       "g AS (SELECT code,date,CASE WHEN net_amt IS NULL THEN 0 ELSE 1 END AS f,coalesce(net_amt,0) AS a,coalesce(net_amt/nullif(accum_amount,0)*100,0) AS p FROM grid LEFT JOIN evd USING (code,date))") +
       f"""SELECT code,date,CAST(f AS INTEGER) AS on_list,CAST(sum(f) OVER {wn(30)} AS BIGINT) AS count_30,CAST(sum(f) OVER {wn(60)} AS BIGINT) AS count_60,{r6(f'sum(a) OVER {wn(30)}/1e4', 5)} AS net_sum_30_wan,
{r6(f'sum(a) OVER {wn(60)}/1e4', 5)} AS net_sum_60_wan,{r6(f'avg(p) OVER {wn(30)}')} AS net_buy_evt_avg_30 FROM g""")
def factor_event_features(t):
    d = A.collapse_events(board_events(t)).where("n_reasons > 0").select("code", "date", "net_amt", "net_buy_pct")
    d = sinks.publish(d, "event-days", tasks=tasks_for(t.spark, t.trades.count(), EVENTS))
    x = A.event_features(d, d.select("code").distinct(), d)
    return x.select("code", "date", "on_list", "count_30", "count_60", r("net_sum_30_wan", 5).alias("net_sum_30_wan"),
                    r("net_sum_60_wan", 5).alias("net_sum_60_wan"), r("net_buy_evt_avg_30").alias("net_buy_evt_avg_30"))


@query("factor_margin", on_bars(f"""SELECT code,date,{r6(f'amount/lag(amount,5) OVER ({W})-1')} AS chg_5,{r6(f'amount/lag(amount,20) OVER ({W})-1')} AS chg_20,{r6('ln(greatest(amount,1))')} AS log_balance,
{r6(f'ln(greatest(avg(volume) OVER {wn(5)},1))')} AS log_buy_5,{r6(f'(amount/lag(amount,5) OVER ({W})-1)-(amount/lag(amount,20) OVER ({W})-1)')} AS chg_5_minus_20,{r6(f'volume/CAST(lag(volume,5) OVER ({W}) AS DOUBLE)-1')} AS buy_chg_5,{r6('open/volume')} AS repay_ratio FROM bars"""))
def factor_margin(t):
    m = t.bars_m.select("code", "date", F.col("amount").alias("balance"), F.col("volume").cast("double").alias("buy"), F.col("open").alias("repay"))
    return pick(A.margin_features(m), "chg_5", "chg_20", "log_balance", "log_buy_5", "chg_5_minus_20", "buy_chg_5", "repay_ratio")


@query("factor_fund_flow", on_bars(f"""SELECT code,date,{r6('n0+n1')} AS net_main,{r6('n0/amount')} AS pct_super_big,{r6('(n0+n1)/amount')} AS pct_main,{r6(full_sql('avg', 'p', 5))} AS pct_super_big_5,{r6(full_sql('avg', 'p', 10))} AS pct_super_big_10,
{r6(full_sql('avg', 'p', 20))} AS pct_super_big_20,{r6(f'(n0-lag(n0,5) OVER ({W}))/nullif(abs(lag(n0,5) OVER ({W})),0)')} AS net_super_big_chg_5,{r6(full_sql('avg', 'm', 5))} AS main_ratio_5
FROM (SELECT *,(close-open)*1.0 AS n0,(high-close)*1.0 AS n1,(close-open)/nullif(amount,0) AS p,(close-open+(high-close))/nullif(amount,0) AS m FROM bars)"""))
def factor_fund_flow(t):
    raw = t.bars_m.select("code", "date", (F.col("close") - F.col("open")).alias("r0_net"), (F.col("high") - F.col("close")).alias("r1_net"), F.col("amount").alias("total"))
    d = A.fund_flow_features(A.fund_flow_shares(raw))
    return pick(d, "net_main", "pct_super_big", "pct_main", "pct_super_big_5", "pct_super_big_10", "pct_super_big_20", "net_super_big_chg_5", "main_ratio_5")


def fwd_event_sums(t):
    out = J.interval_sums(t.bars_m.select("code", "date"), t.announcements, {"v": F.col("value")}, {"20": (1, 20), "60": (1, 60)})
    return out.select("code", "date", F.coalesce("v_20", F.lit(0.0)).alias("p20"), F.coalesce("v_60", F.lit(0.0)).alias("p60"))


@query("factor_unlock_pressure", with_(BARS_M_SQL, ANN_SQL, """p AS (SELECT g.code,g.date,coalesce(sum(CASE WHEN e.date<=g.date+20 THEN value END),0) AS p20,coalesce(sum(value),0) AS p60
FROM bars g LEFT JOIN ann e ON e.code=g.code AND e.date>g.date AND e.date<=g.date+60 GROUP BY 1,2)""",
       f"z AS (SELECT code,date,-({z_sql('p20')}+{z_sql('p60')})/2 AS c FROM p)") + f"SELECT code,date,{r6(z_sql('c'))} AS combo_neg FROM z")
def factor_unlock_pressure(t):
    z = C.zscore(fwd_event_sums(t), ["p20", "p60"])
    z = z.withColumn("combo", A.unlock_pressure("z_p20", "z_p60"))
    return C.zscore(z, ["combo"]).select("code", "date", r("z_combo").alias("combo_neg"))


HOLD_SQL = """rep AS (SELECT code,date,arg_max(value,id) AS v FROM ann GROUP BY 1,2),
rep2 AS (SELECT code,date,v/1000 AS avg_holding,(v/lag(v) OVER (PARTITION BY code ORDER BY date)-1)*100 AS pct,row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM rep),
grid AS (SELECT code,date FROM (SELECT DISTINCT code FROM rep) CROSS JOIN (SELECT DISTINCT CAST(date_trunc('year',l_shipdate) AS DATE) AS date FROM lineitem)),
hit AS (SELECT g.code,g.date,h.i,CASE WHEN date_diff('day',h.date,g.date)<=365 THEN date_diff('day',h.date,g.date) END AS age,pct,avg_holding FROM grid g ASOF LEFT JOIN rep2 h ON g.code=h.code AND g.date>=h.date),
sums AS (SELECT h.code,h.date,sum(CASE WHEN x.date>h.date-183 THEN x.pct END) AS c6,sum(CASE WHEN x.date>h.date-366 THEN x.pct END) AS c12 FROM hit h JOIN rep2 x ON x.code=h.code AND x.i<=h.i AND x.i>h.i-6 WHERE age IS NOT NULL GROUP BY 1,2),
med AS (SELECT date,median(avg_holding) AS m FROM hit WHERE age IS NOT NULL GROUP BY 1)"""


@query("factor_holders", with_(ANN_SQL, HOLD_SQL) + f"""SELECT h.code,h.date,{r6('CASE WHEN age IS NOT NULL THEN pct END', 5)} AS change_3m,{r6('c6', 5)} AS change_6m,{r6('c12', 5)} AS change_12m,CAST(coalesce(age,-1) AS INTEGER) AS age_days,
{r6('CASE WHEN age IS NOT NULL THEN 1-avg_holding/nullif(m,0) END')} AS concentration FROM hit h LEFT JOIN sums s USING (code,date) LEFT JOIN med USING (date)""")
def factor_holders(t):
    from pyspark.sql import Window

    rep = t.announcements.groupBy("code", F.col("date").alias("announce_date")).agg(F.max_by("value", "id").alias("v"))
    w = Window.partitionBy("code").orderBy("announce_date")
    rep = rep.select("code", "announce_date", (F.col("v") / 1000.0).alias("avg_holding"), ((F.col("v") / F.lag("v").over(w) - 1.0) * 100.0).alias("change_pct"))
    years = t.lineitem.select(F.trunc(F.to_date("l_shipdate"), "year").alias("date"))
    d = A.holder_features(rep, t.announcements.select("code"), years)
    return d.select("code", "date", r("change_3m", 5).alias("change_3m"), r("change_6m", 5).alias("change_6m"), r("change_12m", 5).alias("change_12m"), "age_days", r("concentration").alias("concentration"))


def fundamentals(t):
    """Quarterly reports from monthly bars: year-to-date earnings and a book value."""
    from pyspark.sql import Window

    q = t.bars_m.groupBy("code", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)).alias("report_date")).agg(
        F.sum("amount").alias("_a"), F.avg("close").alias("bps"))
    w = Window.partitionBy("code", F.year("report_date")).orderBy("report_date")
    return q.select("code", "report_date", (F.sum("_a").over(w) / 1e5 - 20.0).alias("eps_ytd"), (F.col("bps") - 2000.0).alias("bps"))


FUND_SQL = """q AS (SELECT code,last_day(CAST(date_trunc('quarter',date) AS DATE)+INTERVAL 2 MONTH) AS report_date,sum(amount) AS a,avg(close)-2000 AS bps FROM bars GROUP BY 1,2),
fund AS (SELECT code,report_date,bps,sum(a) OVER (PARTITION BY code,year(report_date) ORDER BY report_date)/1e5-20 AS eps_ytd FROM q),
fq AS (SELECT *,CASE WHEN month(report_date)=3 THEN eps_ytd ELSE eps_ytd-lag(eps_ytd) OVER (PARTITION BY code,year(report_date) ORDER BY report_date) END AS eps_q FROM fund),
fk AS (SELECT code,report_date,CASE WHEN count(*) OVER w=4 THEN sum(eps_q) OVER w END AS t FROM fq WHERE eps_q IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY report_date ROWS 3 PRECEDING)),
fa AS (SELECT code,report_date,eps_ytd FROM fund WHERE month(report_date)=12),
ft AS (SELECT f.code,f.report_date,bps,eps_q,k.t AS ttm,a.eps_ytd AS annual FROM fq f ASOF LEFT JOIN fk k ON f.code=k.code AND f.report_date>=k.report_date ASOF LEFT JOIN fa a ON f.code=a.code AND f.report_date>=a.report_date)"""


@query("factor_value_ratios", with_(BARS_M_SQL, FUND_SQL) + f"""SELECT b.code,b.date,{r6('eps_q')} AS eps_q,{r6('CASE WHEN annual>0 THEN close/annual END', 4)} AS pe_static,{r6('CASE WHEN ttm>0 THEN close/ttm END', 4)} AS pe_ttm,{r6('CASE WHEN bps>0 THEN close/bps END', 4)} AS pb
FROM bars b ASOF LEFT JOIN ft f ON b.code=f.code AND b.date>=f.report_date+INTERVAL 60 DAY""")
def factor_value_ratios(t):
    f = A.quarterly_eps(fundamentals(t)).withColumn("vis", F.date_add("report_date", 60))
    hit = J.asof(t.bars_m.select("code", "date", "close"), f, ["eps_q", "annual_eps", "ttm_eps", "bps"], right_on="vis")
    v = A.valuation_ratios()
    return hit.select("code", "date", r("eps_q").alias("eps_q"), *[r(v[c], 4).alias(c) for c in ("pe_static", "pe_ttm", "pb")])


RATE_SQL = "rp AS (SELECT code,date,CASE priority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0 WHEN '5-LOW' THEN -1 END AS s,CASE status WHEN 'O' THEN 1 WHEN 'F' THEN 0 WHEN 'P' THEN -1 END AS l FROM ann)"


def _rev_sql() -> str:
    parts = []
    for s, a, lo, hi in (("30", "30_60", 60, 30), ("90", "90_180", 180, 90)):
        i = f"e.date>=g.date-{s}"
        b = f"e.date>=g.date-{lo} AND e.date<g.date-{hi}"
        parts.append(f"""count(CASE WHEN {i} THEN 1 END) AS n_reports_{s}d,{r6(f'avg(CASE WHEN {i} THEN s END)')} AS avg_rating_{s}d,{r6(f'avg(CASE WHEN {i} THEN s END)-avg(CASE WHEN {b} THEN s END)')} AS rating_chg_{s}d,
{r6(f'avg(CASE WHEN {i} AND s IS NOT NULL THEN CASE WHEN s>=1 THEN 1.0 ELSE 0 END END)')} AS up_pct_{s}d,count(CASE WHEN {i} AND s>=1 THEN 1 END)-count(CASE WHEN {i} AND s<=-1 THEN 1 END) AS net_up_{s}d,
count(CASE WHEN {i} AND s>l THEN 1 END) AS n_upgrade_{s}d,count(CASE WHEN {i} AND s<l THEN 1 END) AS n_downgrade_{s}d,count(CASE WHEN {i} AND s>l THEN 1 END)-count(CASE WHEN {i} AND s<l THEN 1 END) AS net_revision_{s}d,
{r6(f'avg(CASE WHEN {i} THEN s-l END)')} AS mean_delta_{s}d""")
    return "SELECT g.code,g.date," + ",".join(parts) + " FROM bars g LEFT JOIN rp e ON e.code=g.code AND e.date<g.date AND e.date>=g.date-180 GROUP BY 1,2"


@query("factor_rating_revisions", with_(BARS_M_SQL, ANN_SQL, RATE_SQL) + _rev_sql())
def factor_rating_revisions(t):
    from barloom.functions.scalars import rating_score

    last = F.when(F.col("status") == "O", 1).when(F.col("status") == "F", 0).when(F.col("status") == "P", -1)
    rep = t.announcements.select("code", "date", rating_score(F.col("priority"), PRIORITY_RATING).alias("score"), last.alias("last_score"))
    d = A.rating_revisions(rep, t.bars_m.select("code", "date"))
    fl = [c for c in d.columns if c.startswith(("avg_", "rating_", "up_", "mean_"))]
    return d.withColumns({c: r(c) for c in fl})


PRIORITY_RATING = {"1-URGENT": 2, "2-HIGH": 1, "3-MEDIUM": 0, "5-LOW": -1}


def kdj_hold_sql() -> str:
    return f"""rv AS MATERIALIZED (SELECT code,rn,CASE WHEN {full_sql('max', 'high', 9)}>{full_sql('min', 'low', 9)} THEN (close-{full_sql('min', 'low', 9)})/({full_sql('max', 'high', 9)}-{full_sql('min', 'low', 9)})*100 END AS rsv FROM nb),
hk AS (SELECT code,rn,rsv AS k,rsv AS d FROM rv WHERE rn=1 UNION ALL SELECT s.code,s.rn,
CASE WHEN p.k IS NULL THEN s.rsv WHEN s.rsv IS NULL THEN p.k ELSE p.k+(s.rsv-p.k)/9 END,
CASE WHEN p.d IS NULL THEN s.rsv WHEN s.rsv IS NULL THEN p.d+(p.k-p.d)/9 ELSE p.d+(p.k+(s.rsv-p.k)/9-p.d)/9 END FROM hk p JOIN rv s ON s.code=p.code AND s.rn=p.rn+1)"""


def strict_sql(a: str, b: str) -> str:
    la, lb = f"lag({a}) OVER ({W})", f"lag({b}) OVER ({W})"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {la} IS NULL OR {lb} IS NULL THEN NULL WHEN {a}>={b} AND {la}<{lb} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


@query("factor_macd_crosses", with_(BARS_M_SQL, NUMBERED_SQL, MACD_SQL, kdj_hold_sql(), f"""c AS (SELECT code,date,hist,{strict_sql('dif', 'dea')} AS mc,{strict_sql('k', 'd')} AS kc,{strict_sql('m5', 'm10')} AS ac FROM
(SELECT *,{full_sql('avg', 'close', 5)} AS m5,{full_sql('avg', 'close', 10)} AS m10 FROM nb JOIN macd USING (code,rn) JOIN hk USING (code,rn)))""", recursive=True) +
       f"SELECT code,date,{r6('hist')} AS macd_hist,mc AS macd_cross,CASE WHEN mc IS NULL OR kc IS NULL OR ac IS NULL THEN NULL WHEN mc=1 AND kc=1 AND ac=1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS triple_cross FROM c")
def factor_macd_crosses(t):
    return A.macd_crosses(t.bars_m).select("code", "date", r("macd_hist").alias("macd_hist"), "macd_cross", "triple_cross")


TRX = f"(CASE WHEN {LAG} IS NULL THEN high-low ELSE greatest(high-low,abs(high-{LAG}),abs(low-{LAG})) END)"


@query("factor_model_frame", with_(BARS_M_SQL, NUMBERED_SQL, MACD_SQL, kdj_sql(), rsi_sql("rs", "nb"), recursive=True) + f"""SELECT code,date,{r6('close/l1-1')} AS ret_1,{r6(f'close/lag(close,5) OVER ({W})-1')} AS ret_5,{r6(f'close/lag(close,20) OVER ({W})-1')} AS ret_20,{r6('rsi')} AS rsi_14,
{r6('(close/' + full_sql('avg', 'close', 6) + '-1)*100')} AS bias_6,{r6('hist')} AS macd_hist,{r6('k')} AS kdj_k,{r6('d')} AS kdj_d,{r6('j')} AS kdj_j,{r6(full_sql('avg', 'tr', 14))} AS atr_14,
{r6(full_sql('avg', 'close', 5) + '/' + full_sql('avg', 'close', 20) + '-1')} AS sma_ratio,{r6('(volume-' + full_sql('avg', 'volume', 20) + ')/nullif(' + full_sql('stddev_samp', 'volume', 20) + ',0)')} AS vol_z
FROM (SELECT *,{LAG} AS l1,{TRX} AS tr FROM rs) JOIN macd USING (code,rn) JOIN kdj USING (code,rn)""")
def factor_model_frame(t):
    return pick(A.model_features(t.bars_m), *A.FEATURES_12)


def with_shares(t, ratio: float = 100.0):
    """Outstanding shares stand-in so that turnover is volume / shares."""
    return t.bars_m.withColumn("shares", F.lit(float(ratio)) * 10.0)


EWA_SQL = """ew AS (SELECT code,rn,close AS n12,CAST(1 AS DOUBLE) AS d12,close AS n26,CAST(1 AS DOUBLE) AS d26 FROM nb WHERE rn=1 UNION ALL
SELECT s.code,s.rn,p.n12*(11/13.0)+s.close,p.d12*(11/13.0)+1,p.n26*(25/27.0)+s.close,p.d26*(25/27.0)+1 FROM ew p JOIN nb s ON s.code=p.code AND s.rn=p.rn+1),
em AS MATERIALIZED (SELECT code,rn,n12/d12-n26/d26 AS m FROM ew),
es AS (SELECT code,rn,m AS n,CAST(1 AS DOUBLE) AS d FROM em WHERE rn=1 UNION ALL SELECT s.code,s.rn,p.n*0.8+s.m,p.d*0.8+1 FROM es p JOIN em s ON s.code=p.code AND s.rn=p.rn+1)"""

MOM_SQL = f"""CASE WHEN close>open AND (close/{LAG}-1)*100 BETWEEN 0.01 AND 900 AND volume/{full_sql('avg', 'volume', 5, wp(5))}>1.1 AND close>{full_sql('avg', 'close', 20, wp(20))}
AND (close-low)/nullif(high-low,0) BETWEEN 0.2 AND 0.95 AND volume/1000.0>0.005 THEN volume/{full_sql('avg', 'volume', 5, wp(5))}*((close/{LAG}-1)*100)*((close-low)/nullif(high-low,0)) END"""


@query("factor_picker_frame", with_(BARS_M_SQL, NUMBERED_SQL, EWA_SQL, f"""pf AS (SELECT code,date,close/{LAG}-1 AS ret_1d,close/lag(close,3) OVER ({W})-1 AS ret_3d,close/lag(close,5) OVER ({W})-1 AS ret_5d,close/lag(close,10) OVER ({W})-1 AS ret_10d,
close/lag(close,20) OVER ({W})-1 AS ret_20d,(close-open)/open AS intraday,close/{full_sql('avg', 'close', 5)}-1 AS ma5_dist,close/{full_sql('avg', 'close', 20)}-1 AS ma20_dist,close/{full_sql('avg', 'close', 30)}-1 AS ma60_dist,
{full_sql('avg', 'close', 5)}/{full_sql('avg', 'close', 10)}-1 AS ma5_ma10,{full_sql('stddev_samp', 'q', 10)}*sqrt(10) AS vol10,{full_sql('stddev_samp', 'q', 20)}*sqrt(20) AS vol20,volume/{full_sql('avg', 'volume', 20)} AS vol_ratio,
100-100/(1+{full_sql('avg', 'up', 14)}/nullif({full_sql('avg', 'dn', 14)},0)) AS rsi,(close-({full_sql('avg', 'close', 20)}-2*{full_sql('stddev_samp', 'close', 20)}))/nullif(4*{full_sql('stddev_samp', 'close', 20)},0) AS bb_pos,
m-n/d AS macd,volume/1000.0 AS turnover,1000*close/1e8 AS mkt_cap,CASE WHEN lead(close,5) OVER ({W}) IS NOT NULL THEN CASE WHEN lead(close,5) OVER ({W})/close-1>0 THEN 1 ELSE 0 END END AS target
FROM (SELECT *,close/{LAG}-1 AS q,CASE WHEN {LAG} IS NOT NULL THEN greatest(close-{LAG},0) END AS up,CASE WHEN {LAG} IS NOT NULL THEN greatest({LAG}-close,0) END AS dn FROM nb) JOIN em USING (code,rn) JOIN es USING (code,rn))""", recursive=True) +
       "SELECT code,date," + ",".join(f"{r6(c)} AS {c}" for c in ["ret_1d", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "intraday", "ma5_dist", "ma20_dist", "ma60_dist", "ma5_ma10", "vol10", "vol20", "vol_ratio", "rsi", "bb_pos", "macd", "turnover", "mkt_cap"]) +
       ",CAST(target AS INTEGER) AS target FROM pf WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["ret_20d", "ma60_dist", "vol10", "vol20", "vol_ratio", "rsi", "bb_pos", "macd", "target"]))
def factor_picker_frame(t):
    d = A.picker_features(with_shares(t), 5, ma_long=30)
    return d.select("code", "date", *[r(c).alias(c) for c in A.FEATURES_18], "target")


@query("factor_momentum_score", on_bars(f"SELECT code,date,{r6(MOM_SQL, 4)} AS momentum FROM bars"))
def factor_momentum_score(t):
    b = with_shares(t).withColumn("momentum", A.momentum_score(surge=1.1, lo=0.2, chg=(0.01, 900.0)))
    return pick(b, "momentum", digits=4)


@query("factor_reversal_score", on_bars(f"""SELECT code,date,{r6(f'''CASE WHEN close<open AND (close/{LAG}-1)*100 BETWEEN -95 AND -2 AND volume/{full_sql('avg', 'volume', 5, wp(5))}>1.1 AND close>{full_sql('avg', 'close', 20, wp(20))}*0.1
AND (close-low)/nullif(high-low,0) BETWEEN 0.05 AND 0.5 AND volume/1000.0>0.005 THEN volume/{full_sql('avg', 'volume', 5, wp(5))}*abs((close/{LAG}-1)*100)*(1-(close-low)/nullif(high-low,0)) END''', 4)} AS reversal FROM bars"""))
def factor_reversal_score(t):
    b = with_shares(t).withColumn("reversal", A.reversal_score(surge=1.1, chg=(-95.0, -2.0), ma=20, floor=0.1))
    return pick(b, "reversal", digits=4)


@query("factor_pick_metrics", on_bars(f"""SELECT code,date,{r6('ma5')} AS ma5,{r6('ma20')} AS ma20,{r6('close')} AS last_close,{r6('ret')} AS ret_1,{r6('vr')} AS vol_ratio FROM
(SELECT *,avg(close) OVER {wn(5)} AS ma5,avg(close) OVER {wn(20)} AS ma20,close/{LAG}-1 AS ret,avg(volume) OVER {wn(5)}/avg(volume) OVER ({W} ROWS BETWEEN 29 PRECEDING AND 10 PRECEDING) AS vr,
row_number() OVER ({W}) AS n,max(date) OVER (PARTITION BY code) AS md FROM bars) WHERE date=md AND n>=30"""))
def factor_pick_metrics(t):
    d = A.pick_metrics(t.bars_m)
    return pick(d, "ma5", "ma20", "last_close", "ret_1", "vol_ratio")


ROT_SQL = f"""bd AS (SELECT code,b.date,industry AS board,close/lag(close) OVER (PARTITION BY code ORDER BY b.date)-1 AS ret_1d FROM bars b JOIN suppliers USING (code)),
dayb AS (SELECT date,board,avg(ret_1d) AS q FROM bd GROUP BY 1,2),
rot AS (SELECT date,board,CASE WHEN count(q) OVER w>=5 THEN avg(q) OVER w END AS board_score FROM dayb WINDOW w AS (PARTITION BY board ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


def boards(t):
    b = t.bars_m.join(t.suppliers.select("code", F.col("industry").alias("board")), "code")
    return b.withColumn("ret_1d", change("close"))


@query("factor_board_rotation", with_(BARS_M_SQL, SUPPLIERS_SQL, ROT_SQL) + f"SELECT date,board,{r6('board_score')} AS board_score FROM rot")
def factor_board_rotation(t):
    return A.board_rotation(boards(t)).select("date", "board", r("board_score").alias("board_score"))


@query("factor_top_boards", with_(BARS_M_SQL, SUPPLIERS_SQL, ROT_SQL, "best AS (SELECT date,board FROM (SELECT *,row_number() OVER (PARTITION BY date ORDER BY board_score DESC,board) AS k FROM rot WHERE board_score IS NOT NULL) WHERE k<=3)") +
       f"SELECT code,date,board,{r6('ret_1d')} AS ret_1d FROM bd WHERE (date,board) IN (SELECT date,board FROM best) OR date NOT IN (SELECT date FROM best)")
def factor_top_boards(t):
    b = boards(t)
    return A.in_top_boards(b, A.board_rotation(b)).select("code", "date", "board", r("ret_1d").alias("ret_1d"))


@query("scalar_signed_log", on_bars(f"SELECT code,date,{r6('sign(x)*ln(1+abs(x)/1e6)')} AS signed_log FROM (SELECT code,date,(close-open)*volume AS x FROM bars)"))
def scalar_signed_log(t):
    return pick(t.bars_m.withColumn("signed_log", A.signed_log((F.col("close") - F.col("open")) * F.col("volume"))), "signed_log")
