"""Signals, decisions, scans and vote filters over monthly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import crosssec as C
from barloom.operators import decision as D
from barloom.operators import factors as A
from barloom.operators import signals as S
from barloom.plans.indicator_plans import ADX_SQL, AROON_SQL, ARBR_SQL, STOCH_SQL, TR_SQL, rsrs_sql, ssa_sql
from barloom.plans.registry import (
    BARS_M_SQL, BARS_S_SQL, MACD_SQL, NUMBERED_SQL, SUPPLIERS_SQL, W, daily, ewm_sql, full_sql, kdj_sql, query, r, r6, rsi_sql, with_, wn,
)


def edge(s: str) -> str:
    return f"(coalesce({s},false) AND NOT coalesce(lag({s}) OVER ({W}),false))"


def fall(s: str) -> str:
    return f"(NOT coalesce({s},false) AND coalesce(lag({s}) OVER ({W}),false))"


def sig_sql(src: str, enter: str, leave: str | None, *ctes: str, recursive: bool = False) -> str:
    ex = fall("e") if leave is None else edge("x")
    return with_(BARS_M_SQL, *ctes, recursive=recursive) + f"SELECT code,date,{edge('e')} AS entry,{ex} AS exit FROM (SELECT code,date,{enter} AS e,{leave or 'false'} AS x FROM {src})"


def out(df):
    return df.select("code", "date", "entry", "exit")


@query("signal_sma_cross", sig_sql("bars", f"{full_sql('avg', 'close', 10)}>{full_sql('avg', 'close', 30)}", None))
def signal_sma_cross(t):
    return out(S.sma_cross(t.bars_m))


@query("signal_macd_cross", sig_sql("nb JOIN macd USING (code,rn)", "dif>dea", None, NUMBERED_SQL, MACD_SQL, recursive=True))
def signal_macd_cross(t):
    return out(S.macd_cross(t.bars_m))


@query("signal_rsi_threshold", sig_sql("rs", "rsi<30", "rsi>70", rsi_sql()))
def signal_rsi_threshold(t):
    return out(S.rsi_threshold(t.bars_m))


@query("signal_kdj_cross", with_(BARS_M_SQL, NUMBERED_SQL, kdj_sql(), recursive=True) +
       f"SELECT code,date,{edge('e')} AND coalesce(k<80,false) AS entry,{fall('e')} AND coalesce(k>20,false) AS exit FROM (SELECT code,date,k,k>d AS e FROM nb JOIN kdj USING (code,rn))")
def signal_kdj_cross(t):
    return out(S.kdj_cross(t.bars_m))


BB = f"(SELECT *,{full_sql('avg', 'close', 20)} AS m,{full_sql('stddev_samp', 'close', 20)} AS sd FROM bars)"


@query("signal_boll_reversion", sig_sql(BB, "close<m-2*sd", "close>m"))
def signal_boll_reversion(t):
    return out(S.boll_reversion(t.bars_m))


@query("signal_boll_breakout", sig_sql(BB, "close>m+2*sd", "close<m"))
def signal_boll_breakout(t):
    return out(S.boll_breakout(t.bars_m))


@query("signal_cci", with_(BARS_M_SQL) + f"""SELECT code,date,coalesce(c>-100 AND lag(c) OVER ({W})<=-100,false) AS entry,coalesce(c<100 AND lag(c) OVER ({W})>=100,false) AS exit FROM
(SELECT code,date,(tp-m)/nullif(0.015*list_sum(list_transform(l,lambda x: abs(x-m)))/14,0) AS c FROM (SELECT code,date,tp,{full_sql('avg', 'tp', 14)} AS m,list(tp) OVER {wn(14)} AS l FROM (SELECT *,(high+low+close)/3 AS tp FROM bars)))""")
def signal_cci(t):
    return out(S.cci(t.bars_m))


@query("signal_adx_trend", sig_sql("adx JOIN e USING (code,rn)", "plus_di>minus_di AND adx>20 AND close>em", "plus_di<minus_di", NUMBERED_SQL, ewm_sql("e", "nb", {"em": ("close", 2 / 56)}), ADX_SQL.replace("FROM bars", "FROM nb"), recursive=True))
def signal_adx_trend(t):
    return out(S.adx_trend(t.bars_m))


@query("signal_aroon", sig_sql("aroon", "aroon_up>aroon_down AND aroon_up+aroon_down>=50", None, AROON_SQL))
def signal_aroon(t):
    return out(S.aroon(t.bars_m))


@query("signal_arbr", sig_sql("arbr", "ar<50 AND br<50", "ar>150 AND br>150", ARBR_SQL))
def signal_arbr(t):
    return out(S.arbr(t.bars_m))


@query("signal_stoch_rsi", sig_sql("stoch", "stoch_rsi<20", "stoch_rsi>80", rsi_sql(), STOCH_SQL))
def signal_stoch_rsi(t):
    return out(S.stoch_rsi(t.bars_m))


def _z(c: str, n: int) -> str:
    return f"(({c}-{full_sql('avg', c, n)})/nullif({full_sql('stddev_samp', c, n)},0))"


@query("signal_factor_momentum", sig_sql("q", "s>CASE WHEN c>=12 THEN hi END", "s<CASE WHEN c>=12 THEN lo END",
       f"f1 AS (SELECT *,close/lag(close) OVER ({W})-1 AS rr,close/lag(close,6) OVER ({W})-1 AS mom FROM bars)",
       f"f2 AS (SELECT *,1/nullif({full_sql('stddev_samp', 'rr', 6)},0) AS inv,{_z('volume', 6)} AS vz FROM f1)",
       f"f3 AS (SELECT *,({_z('mom', 12)}+{_z('inv', 12)}+{_z('vz', 12)})/3 AS s FROM f2)",
       f"q AS (SELECT *,count(s) OVER {wn(12)} AS c,quantile_cont(s,0.8) OVER {wn(12)} AS hi,quantile_cont(s,0.2) OVER {wn(12)} AS lo FROM f3)"))
def signal_factor_momentum(t):
    return out(S.factor_momentum(t.bars_m, 6, 6, 12))


@query("signal_factor_momentum_daily", daily(sig_sql("q", "s>CASE WHEN c>=60 THEN hi END", "s<CASE WHEN c>=60 THEN lo END",
       f"f1 AS (SELECT *,close/lag(close) OVER ({W})-1 AS rr,close/lag(close,20) OVER ({W})-1 AS mom FROM bars)",
       f"f2 AS (SELECT *,1/nullif({full_sql('stddev_samp', 'rr', 20)},0) AS inv,{_z('volume', 20)} AS vz FROM f1)",
       f"f3 AS (SELECT *,({_z('mom', 60)}+{_z('inv', 60)}+{_z('vz', 60)})/3 AS s FROM f2)",
       f"q AS (SELECT *,count(s) OVER {wn(60)} AS c,quantile_cont(s,0.8) OVER {wn(60)} AS hi,quantile_cont(s,0.2) OVER {wn(60)} AS lo FROM f3)")))
def signal_factor_momentum_daily(t):
    """Default lengths on daily bars."""
    return out(S.factor_momentum(t.bars_s))


@query("signal_registered", daily(sig_sql("bars", f"{full_sql('avg', 'close', 10)}>{full_sql('avg', 'close', 30)}", None)))
def signal_registered(t):
    """A signal looked up by its name and applied with ``transform``."""
    return out(t.bars_s.transform(S.REGISTRY["sma_cross"]))


@query("signal_rsrs_timing", sig_sql("rsrs", "rsrs>0.7", "rsrs<-0.7", rsrs_sql(18, 30)))
def signal_rsrs_timing(t):
    return out(S.rsrs_timing(t.bars_m, 18, 30))


@query("signal_ssa_short", sig_sql("ss", "close>ssa", None, ssa_sql(), recursive=True))
def signal_ssa_short(t):
    return out(S.ssa_trend(t.bars_m, 6))


@query("signal_ssa_trend")
def signal_ssa_trend(t):
    return out(S.ssa_trend(t.bars_m))


def ext_sql(c: str, op: str) -> str:
    """Rows p that beat all neighbours within 5 rows as seen from bar i, last two per (code, i)."""
    return f"""SELECT i.code,i.rn AS i,p.rn AS p,p.{c} AS v,row_number() OVER (PARTITION BY i.code,i.rn ORDER BY p.rn DESC) AS k FROM rx i JOIN rx p ON p.code=i.code AND p.rn<i.rn AND p.rn>1
WHERE NOT EXISTS (SELECT 1 FROM rx q WHERE q.code=p.code AND q.rn<>p.rn AND q.rn BETWEEN p.rn-5 AND least(p.rn+5,i.rn) AND NOT coalesce(p.{c}{op}q.{c},false))"""


@query("signal_rsi_divergence", with_(BARS_M_SQL, rsi_sql(), f"rx AS MATERIALIZED (SELECT code,date,close,rsi,row_number() OVER ({W}) AS rn FROM rs)", *[f"{n} AS (SELECT code,i,max(CASE WHEN k=1 THEN v END) AS a,max(CASE WHEN k=2 THEN v END) AS b FROM ({ext_sql(c, op)}) WHERE k<=2 GROUP BY 1,2)" for n, c, op in (("pl", "close", "<"), ("ph", "close", ">"), ("rl", "rsi", "<"), ("rh", "rsi", ">"))]) +
       """SELECT rx.code,date,coalesce(rn>24 AND pl.a<pl.b AND rl.a>rl.b AND rsi<50,false) AS entry,coalesce(rn>24 AND ph.a>ph.b AND rh.a<rh.b AND rsi>50,false) AS exit FROM rx LEFT JOIN pl ON pl.code=rx.code AND pl.i=rn LEFT JOIN ph ON ph.code=rx.code AND ph.i=rn
LEFT JOIN rl ON rl.code=rx.code AND rl.i=rn LEFT JOIN rh ON rh.code=rx.code AND rh.i=rn""")
def signal_rsi_divergence(t):
    return out(S.rsi_divergence(t.bars_m))


def _vote_ctes(latest: bool) -> list[str]:
    la = lambda c: f"lag({c}) OVER ({W})"
    base = f"""fi AS MATERIALIZED (SELECT nb.*,dif,dea,hist,k,d,j,rsi,{full_sql('avg', 'close', 20)} AS mid,{full_sql('stddev_samp', 'close', 20)} AS sd,close/{full_sql('avg', 'close', 5)} AS b5,close/{full_sql('avg', 'close', 10)} AS b10,close/{full_sql('avg', 'close', 20)} AS b20,
{full_sql('avg', 'tr', 14)} AS atr FROM (SELECT *,{TR_SQL} AS tr FROM rs) nb JOIN macd USING (code,rn) JOIN kdj USING (code,rn))"""
    if latest:
        macd = f"CASE WHEN (dif>dea AND {la('dif')}<={la('dea')}) OR (dif>dea AND hist>{la('hist')}) THEN 1 WHEN (dif<dea AND {la('dif')}>={la('dea')}) OR (dif<dea AND hist<{la('hist')}) THEN -1 ELSE 0 END"
        kdj = f"CASE WHEN k>d AND {la('k')}<={la('d')} AND k<80 THEN 1 WHEN k<d AND {la('k')}>={la('d')} AND k>20 THEN -1 WHEN k<20 AND j<0 THEN 1 WHEN k>80 AND j>100 THEN -1 ELSE 0 END"
    else:
        ab, pb = "coalesce(dif>dea,false)", f"coalesce(lag(dif>dea) OVER ({W}),false)"
        ka, pk = "coalesce(k>d,false)", f"coalesce(lag(k>d) OVER ({W}),false)"
        macd = f"CASE WHEN (NOT {ab} AND {pb}) OR (NOT {ab} AND hist<{la('hist')}) THEN -1 WHEN ({ab} AND NOT {pb}) OR ({ab} AND hist>{la('hist')}) THEN 1 ELSE 0 END"
        kdj = f"CASE WHEN (NOT {ka} AND {pk} AND k>20) OR (k>80 AND j>100) THEN -1 WHEN ({ka} AND NOT {pk} AND k<80) OR (k<20 AND j<0) THEN 1 ELSE 0 END"
    v = f"""vt AS (SELECT *,CASE WHEN b5>b10 AND b10>b20 THEN 1 WHEN b5<b10 AND b10<b20 THEN -1 ELSE 0 END AS v_bias,{macd} AS v_macd,{kdj} AS v_kdj,CASE WHEN rsi<30 THEN 1 WHEN rsi>70 THEN -1 ELSE 0 END AS v_rsi,
CASE WHEN close<mid-2*sd THEN 1 WHEN close>mid+2*sd THEN -1 ELSE 0 END AS v_boll FROM fi),
vs AS MATERIALIZED (SELECT *,((v_bias=1)::INT*0.1+(v_kdj=1)::INT*0.2+(v_rsi=1)::INT*0.15+(v_boll=1)::INT*0.25+(v_macd=1)::INT*0.2)::DOUBLE/0.9 AS bs,((v_bias=-1)::INT*0.1+(v_kdj=-1)::INT*0.2+(v_rsi=-1)::INT*0.15+(v_boll=-1)::INT*0.25+(v_macd=-1)::INT*0.2)::DOUBLE/0.9 AS ss FROM vt)"""
    return [NUMBERED_SQL, MACD_SQL, kdj_sql(), rsi_sql("rs", "nb"), base, v]


@query("signal_multi_fusion", sig_sql("vs", "bs+1e-9>=0.5 AND bs>ss", "ss+1e-9>=0.5 AND ss>bs", *_vote_ctes(False), recursive=True))
def signal_multi_fusion(t):
    return out(S.multi_fusion(t.bars_m))


LAST_SQL = f"""la AS (SELECT *,row_number() OVER ({W}) AS nn,lag(close) OVER ({W}) AS pc,{full_sql('avg', 'close', 5)} AS ma5,{full_sql('avg', 'close', 60)} AS ma60,max(date) OVER (PARTITION BY code) AS md FROM vs),
de AS MATERIALIZED (SELECT *,CASE WHEN bs+1e-9>=0.5 AND bs>ss THEN 'BUY' WHEN ss+1e-9>=0.5 AND ss>bs THEN 'SELL' ELSE 'HOLD' END AS signal,coalesce(close>ma60,false) AS upt FROM la WHERE date=md)"""
DEC_COLS = """code,date,round(close,2) AS price,round((close/pc-1)*100,2) AS change_pct,signal,round(bs,3) AS buy_score,round(ss,3) AS sell_score,v_bias,v_macd,v_kdj,v_rsi,v_boll,CASE WHEN upt THEN '上升' ELSE '下降' END AS trend_ma60,
round(rsi,2) AS rsi,round(dif,3)+0.0 AS dif,round(CASE signal WHEN 'BUY' THEN close-1.8*atr WHEN 'SELL' THEN close+1.8*atr END,2) AS stop_loss,round(CASE signal WHEN 'BUY' THEN close+2*atr WHEN 'SELL' THEN close-2*atr END,2) AS target_1,
round(CASE signal WHEN 'BUY' THEN close+3.5*atr WHEN 'SELL' THEN close-3.5*atr END,2) AS target_2,round(CASE signal WHEN 'BUY' THEN least(close,ma5)*0.995 WHEN 'SELL' THEN close*0.995 END,2) AS entry_low,
CAST(CASE WHEN signal='BUY' THEN (CASE WHEN bs>=0.65 THEN 15 ELSE 10 END)+(CASE WHEN upt THEN 5 ELSE 0 END) ELSE 0 END AS INTEGER) AS suggested_position_pct"""


def flat(d):
    return d.select(
        "code", "date", "price", "change_pct", "signal", "buy_score", "sell_score", *[F.col(f"votes.{v}").alias(f"v_{v.lower()}") for v in S.VOTE_WEIGHTS],
        "trend_ma60", "indicators.rsi", "indicators.dif", "stop_loss", "target_1", "target_2", F.get("entry_range", F.lit(0)).alias("entry_low"), "suggested_position_pct")


@query("decision_analyze", with_(BARS_M_SQL, *_vote_ctes(True), LAST_SQL, recursive=True) + f"SELECT {DEC_COLS} FROM de")
def decision_analyze(t):
    return flat(D.analyze(t.bars_m))


# the scan keeps the last 60 bars; its smoothing starts at the first kept bar
SCAN_BARS = BARS_M_SQL.replace("bars AS (", "bars0 AS (") + f",bars1 AS (SELECT *,row_number() OVER (PARTITION BY code ORDER BY date DESC) AS kk,count(*) OVER (PARTITION BY code) AS cc FROM bars0),bars AS (SELECT code,date,open,high,low,close,volume,amount FROM bars1 WHERE kk<=60 AND least(cc,60)>=50)"


def scan_sql(select: str, *more: str) -> str:
    return with_(SCAN_BARS, SUPPLIERS_SQL, *_vote_ctes(True), LAST_SQL, *more, recursive=True) + select


def scan(t):
    extra = t.suppliers.select("code", "name").unionByName(t.suppliers.limit(1).select(F.lit("999999").alias("code"), F.lit("absent").alias("name")))
    return D.market_scan(t.bars_m, extra, window=60, need=50)


@query("decision_market_scan", scan_sql("SELECT u.code,u.name,signal,round(close,2) AS price,round(bs,3) AS buy_score,round(ss,3) AS sell_score,CASE WHEN cc IS NULL THEN 'no data' WHEN cc<50 THEN 'only '||cc||' bars' END AS error FROM (SELECT code,name FROM suppliers UNION ALL SELECT '999999','absent') u LEFT JOIN de USING (code) LEFT JOIN (SELECT code,count(*) AS cc FROM bars0 GROUP BY 1) z ON z.code=u.code"))
def decision_market_scan(t):
    return scan(t).select("code", "name", "signal", "price", "buy_score", "sell_score", "error")


@query("decision_market_scan_daily", daily(scan_sql("SELECT u.code,signal,round(close,2) AS price,round(bs,3) AS buy_score,round(ss,3) AS sell_score,CASE WHEN cc IS NULL THEN 'no data' WHEN cc<90 THEN 'only '||cc||' bars' END AS error FROM (SELECT DISTINCT code FROM bars0 UNION ALL SELECT '999999') u LEFT JOIN de USING (code) LEFT JOIN (SELECT code,least(count(*),180) AS cc FROM bars0 GROUP BY 1) z ON z.code=u.code").replace(BARS_M_SQL.replace("bars AS (", "bars0 AS (").strip(), BARS_S_SQL.replace("bars AS (", "bars0 AS (").strip()).replace("kk<=60 AND least(cc,60)>=50", "kk<=180 AND least(cc,180)>=90")))
def decision_market_scan_daily(t):
    """The scan at its default window on daily bars."""
    codes = t.bars_s.select("code").distinct().unionByName(t.suppliers.limit(1).select(F.lit("999999").alias("code")))
    return D.market_scan(t.bars_s, codes.withColumn("name", F.col("code"))).select("code", "signal", "price", "buy_score", "sell_score", "error")


@query("decision_breadth", scan_sql(f"SELECT industry,count(*) AS n,{r6('''avg(CASE WHEN signal='BUY' THEN 100.0 ELSE 0 END)''')} AS buy_pct,{r6('''avg(CASE WHEN signal='SELL' THEN 100.0 ELSE 0 END)''')} AS sell_pct,{r6('''avg(CASE WHEN signal='HOLD' THEN 100.0 ELSE 0 END)''')} AS hold_pct,{r6('avg(CASE WHEN upt THEN 100.0 ELSE 0 END)')} AS uptrend_pct,{r6('sum(round(bs,3)*w)/sum(w)')} AS w_buy FROM (SELECT de.*,industry,acctbal+2000 AS w FROM de JOIN suppliers USING (code)) GROUP BY 1"))
def decision_breadth(t):
    members = t.suppliers.select("code", "industry", (F.col("acctbal") + 2000.0).alias("weight"))
    b = D.breadth(scan(t), members, "industry")
    return b.select("industry", "n", *[r(c).alias(c) for c in ("buy_pct", "sell_pct", "hold_pct", "uptrend_pct", "w_buy")])


@query("decision_ranking", scan_sql("SELECT code,signal,round(bs,3) AS buy_score,round(ss,3) AS sell_score FROM (SELECT * FROM (SELECT * FROM de WHERE signal='BUY' ORDER BY round(bs,3) DESC,upt DESC,round(rsi,2),code LIMIT 10) UNION ALL SELECT * FROM (SELECT * FROM de WHERE signal='SELL' ORDER BY round(ss,3) DESC,upt,round(rsi,2) DESC,code LIMIT 10))"))
def decision_ranking(t):
    s = scan(t).where("error is null")
    both = D.ranking(s, "BUY", 10).unionByName(D.ranking(s, "SELL", 10))
    return both.select("code", "signal", "buy_score", "sell_score")


DEB_SQL = f"""pm AS (SELECT *,avg(close) OVER {wn(5)} AS ma5,avg(close) OVER {wn(20)} AS ma20,close/lag(close) OVER ({W})-1 AS ret,avg(volume) OVER {wn(5)}/avg(volume) OVER ({W} ROWS BETWEEN 29 PRECEDING AND 10 PRECEDING) AS vr,row_number() OVER ({W}) AS nn,max(date) OVER (PARTITION BY code) AS md FROM bars),
pz AS (SELECT code,ma5,ma20,close,ret,vr,(vr-avg(vr) OVER ())/stddev_samp(vr) OVER () AS zp,(ret-avg(ret) OVER ())/stddev_samp(ret) OVER () AS za FROM pm WHERE date=md AND nn>=30),
sc AS (SELECT code,0.4+CASE WHEN zp>2 THEN 0.2 ELSE 0 END+CASE WHEN ma5>ma20 THEN 0.15 ELSE 0 END+CASE WHEN vr>1.3 THEN 0.1 ELSE 0 END+CASE WHEN close<ma20*1.02 THEN 0.1 ELSE 0 END AS bull,
CASE WHEN za<-1.5 THEN 0.15 ELSE 0 END+CASE WHEN ret/10<-0.015 THEN 0.15 ELSE 0 END+CASE WHEN ma5<ma20 THEN 0.15 ELSE 0 END+CASE WHEN ret<-0.03 THEN 0.1 ELSE 0 END+CASE WHEN close<ma5*0.9*1.05 THEN 0.2 ELSE 0 END+CASE WHEN vr<0.7 THEN 0.1 ELSE 0 END AS risk FROM pz),
vo AS (SELECT code,round(least(bull,1)::DOUBLE,2) AS b,CASE WHEN risk>0 THEN round(least(0.3+risk,1)::DOUBLE,2) ELSE 0.2 END AS s FROM sc)"""


def debated(t):
    m = A.pick_metrics(t.bars_m)
    z = C.zscore(m, ["vol_ratio", "ret_1"], None, fill=False)
    x = z.select("code", F.col("z_vol_ratio").alias("z_pred"), F.col("z_ret_1").alias("z_amp"), (F.col("ret_1") / 10.0).alias("amp_imb"), "ma5", "ma20", "last_close", "ret_1", "vol_ratio",
                 F.col("ma20").alias("rec_price"), (F.col("ma5") * 0.9).alias("stop_loss"))
    return D.debate(x)


@query("decision_debate", with_(BARS_M_SQL, DEB_SQL) + "SELECT code,b AS bull_score,CAST(s AS DOUBLE) AS bear_score,CASE WHEN s>0.55 THEN 'SELL' ELSE 'HOLD' END AS bear_vote,CASE WHEN b>s+0.15 THEN 'BUY' WHEN s>b+0.15 THEN 'SELL' ELSE 'HOLD' END AS vote FROM vo")
def decision_debate(t):
    return debated(t).select("code", "bull_score", "bear_score", "bear_vote", "vote")


VOTE_SQL = "vl AS (SELECT lpad(CAST(user_id AS VARCHAR),6,'0') AS sym,CASE event_type WHEN 'click' THEN 'bull' WHEN 'view' THEN 'bear' ELSE 'neutral' END AS agent,CASE WHEN value>70 THEN 'BUY' WHEN value>30 THEN 'HOLD' ELSE 'SELL' END AS vote,ts FROM events),lv AS (SELECT sym,agent,arg_max(vote,(ts,vote)) AS vote FROM vl WHERE CAST(ts AS DATE)=(SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY 1,2)"


def vote_log(t):
    e = t.table("events")
    v = F.col("value")
    return e.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("sym"),
        F.when(F.col("event_type") == "click", "bull").when(F.col("event_type") == "view", "bear").otherwise("neutral").alias("agent"),
        F.when(v > 70, "BUY").when(v > 30, "HOLD").otherwise("SELL").alias("vote"), "ts")


@query("decision_latest_votes", with_(VOTE_SQL) + "SELECT * FROM lv")
def decision_latest_votes(t):
    return D.latest_votes(vote_log(t))


@query("decision_veto", with_(VOTE_SQL) + "SELECT p.sym,n.vote AS primary_vote,coalesce(n.vote='SELL',false) AS vetoed FROM (SELECT DISTINCT sym FROM vl) p LEFT JOIN (SELECT sym,vote FROM lv WHERE agent='neutral') n USING (sym)")
def decision_veto(t):
    log = vote_log(t)
    return D.veto(log.select("sym").distinct(), D.latest_votes(log)).select("sym", "primary_vote", "vetoed")
