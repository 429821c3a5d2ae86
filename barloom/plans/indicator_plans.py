"""Bars, indicators and formula functions over monthly supplier bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import formula as X
from barloom.functions.frames import falling_edge, mean_n, rising_edge, series
from barloom.operators import indicators as I
from barloom.operators import recur as R
from barloom.operators.bars import equal_weight_index
from barloom.plans.registry import (
    BARS_D_SQL, MACD_SQL, NUMBERED_SQL, BARS_M_SQL, Tables, W, ewm_sql, full_sql, daily, kdj_sql, on_bars, query, r,
    r6, rsi_sql, with_, wn,
)


def pick(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select("code", "date", *[r(c, digits).alias(c) for c in cols])


@query("bars_monthly", with_(BARS_M_SQL) + f"""
SELECT code,date,{r6('open')} AS open,{r6('high')} AS high,{r6('low')} AS low,{r6('close')} AS close,volume,{r6('amount', 4)} AS amount FROM bars""")
def bars_monthly(t: Tables) -> DataFrame:
    return t.bars_m.select("code", "date", *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume", r("amount", 4).alias("amount"))


@query("bars_daily", with_(BARS_D_SQL) + """
SELECT code,date,open,high,low,close,volume FROM bars""")
def bars_daily(t: Tables) -> DataFrame:
    return t.bars_d.select("code", "date", "open", "high", "low", "close", "volume")


@query("win_sma", on_bars(f"SELECT code,date,{r6(full_sql('avg', 'close', 10))} AS sma10 FROM bars"))
def win_sma(t):
    return pick(t.bars_m.withColumn("sma10", mean_n("close", 10)), "sma10")


@query("win_ema", with_(BARS_M_SQL, NUMBERED_SQL, ewm_sql("e", "nb", {"ema12": ("close", 2 / 13)}), recursive=True) +
       f"SELECT code,date,{r6('ema12')} AS ema12 FROM nb JOIN e USING (code,rn)")
def win_ema(t):
    return pick(I.ema(t.bars_m, "ema12", "close", 12), "ema12")


@query("win_macd", with_(BARS_M_SQL, NUMBERED_SQL, MACD_SQL, recursive=True) +
       f"SELECT code,date,{r6('dif')} AS dif,{r6('dea')} AS dea,{r6('hist')} AS hist FROM nb JOIN macd USING (code,rn)")
def win_macd(t):
    return pick(I.macd(t.bars_m), "dif", "dea", "hist")


@query("win_rsi", on_bars(f"SELECT code,date,{r6('rsi')} AS rsi FROM rs", rsi_sql()))
def win_rsi(t):
    return pick(I.rsi(t.bars_m), "rsi")


@query("win_kdj", with_(BARS_M_SQL, NUMBERED_SQL, kdj_sql(), recursive=True) +
       f"SELECT code,date,{r6('k')} AS k,{r6('d')} AS d,{r6('j')} AS j FROM nb JOIN kdj USING (code,rn)")
def win_kdj(t):
    return pick(I.kdj(t.bars_m), "k", "d", "j")


@query("win_boll", on_bars(f"""SELECT code,date,{r6('m+2*s')} AS boll_upper,{r6('m')} AS boll_mid,{r6('m-2*s')} AS boll_lower FROM
(SELECT *,{full_sql('avg', 'close', 20)} AS m,{full_sql('stddev_samp', 'close', 20)} AS s FROM bars)"""))
def win_boll(t):
    return pick(I.boll(t.bars_m), "boll_upper", "boll_mid", "boll_lower")


TR_SQL = f"(CASE WHEN lag(close) OVER ({W}) IS NULL THEN high-low ELSE greatest(high-low,abs(high-lag(close) OVER ({W})),abs(low-lag(close) OVER ({W}))) END)"


@query("win_atr", on_bars(f"SELECT code,date,{r6(full_sql('avg', 'tr', 14))} AS atr FROM (SELECT *,{TR_SQL} AS tr FROM bars)"))
def win_atr(t):
    return pick(I.atr(t.bars_m), "atr")


@query("win_bias", on_bars(f"SELECT code,date,{r6('(close-m)/m*100')} AS bias6 FROM (SELECT *,{full_sql('avg', 'close', 6)} AS m FROM bars)"))
def win_bias(t):
    return pick(t.bars_m.withColumn("bias6", I.bias("close", 6)), "bias6")


@query("win_cci", on_bars(f"""SELECT code,date,{r6('(tp-m)/nullif(0.015*list_sum(list_transform(l,lambda x: abs(x-m)))/14,0)')} AS cci FROM
(SELECT code,date,tp,{full_sql('avg', 'tp', 14)} AS m, list(tp) OVER {wn(14)} AS l FROM (SELECT *,(high+low+close)/3 AS tp FROM bars))"""))
def win_cci(t):
    return pick(I.cci(t.bars_m), "cci")


ADX_SQL = f"""dm AS (SELECT *,{TR_SQL} AS tr,high-lag(high) OVER ({W}) AS u,lag(low) OVER ({W})-low AS dn FROM bars),
dm2 AS (SELECT *,CASE WHEN u>dn AND u>0 THEN u ELSE 0 END AS p,CASE WHEN dn>u AND dn>0 THEN dn ELSE 0 END AS q FROM dm),
di AS (SELECT *,100*{full_sql('sum', 'p', 14)}/nullif({full_sql('avg', 'tr', 14)}*14,0) AS plus_di,100*{full_sql('sum', 'q', 14)}/nullif({full_sql('avg', 'tr', 14)}*14,0) AS minus_di FROM dm2),
dx AS (SELECT *,100*abs(plus_di-minus_di)/nullif(plus_di+minus_di,0) AS dx FROM di),
adx AS MATERIALIZED (SELECT *,{full_sql('avg', 'dx', 14)} AS adx FROM dx)"""


@query("win_adx", on_bars(f"SELECT code,date,{r6('plus_di')} AS plus_di,{r6('minus_di')} AS minus_di,{r6('adx')} AS adx FROM adx", ADX_SQL))
def win_adx(t):
    return pick(I.adx(t.bars_m), "plus_di", "minus_di", "adx")


AROON_SQL = f"""an AS (SELECT *,row_number() OVER ({W}) AS rn,list(high) OVER {wn(26)} AS hl,list(low) OVER {wn(26)} AS ll FROM bars),
aroon AS MATERIALIZED (SELECT *,CASE WHEN rn>25 THEN (list_position(hl,list_max(hl))-1)*100.0/25 END AS aroon_up,
CASE WHEN rn>25 THEN (list_position(ll,list_min(ll))-1)*100.0/25 END AS aroon_down FROM an)"""


@query("win_aroon", on_bars(f"SELECT code,date,{r6('aroon_up')} AS aroon_up,{r6('aroon_down')} AS aroon_down FROM aroon", AROON_SQL))
def win_aroon(t):
    return pick(I.aroon(t.bars_m), "aroon_up", "aroon_down")


ARBR_SQL = f"""ab AS (SELECT *,greatest(high-open,0) AS ho,greatest(open-low,0) AS ol,
CASE WHEN lag(close) OVER ({W}) IS NOT NULL THEN greatest(high-lag(close) OVER ({W}),0) END AS hc,
CASE WHEN lag(close) OVER ({W}) IS NOT NULL THEN greatest(lag(close) OVER ({W})-low,0) END AS cl FROM bars),
arbr AS MATERIALIZED (SELECT *,{full_sql('sum', 'ho', 26)}/nullif({full_sql('sum', 'ol', 26)},0)*100 AS ar,{full_sql('sum', 'hc', 26)}/nullif({full_sql('sum', 'cl', 26)},0)*100 AS br FROM ab)"""


@query("win_arbr", on_bars(f"SELECT code,date,{r6('ar')} AS ar,{r6('br')} AS br FROM arbr", ARBR_SQL))
def win_arbr(t):
    return pick(I.arbr(t.bars_m), "ar", "br")


STOCH_SQL = f"stoch AS MATERIALIZED (SELECT *,(rsi-{full_sql('min', 'rsi', 14)})/nullif({full_sql('max', 'rsi', 14)}-{full_sql('min', 'rsi', 14)},0)*100 AS stoch_rsi FROM rs)"


@query("win_stoch_rsi", on_bars(f"SELECT code,date,{r6('stoch_rsi')} AS stoch_rsi FROM stoch", rsi_sql(), STOCH_SQL))
def win_stoch_rsi(t):
    return pick(I.stoch_rsi(t.bars_m), "stoch_rsi")


def rsrs_sql(n: int = 18, m: int = 30) -> str:
    f = wn(n)
    ok = f"count(low) OVER {f}>={n} AND min(low) OVER {f}<max(low) OVER {f} AND min(high) OVER {f}<max(high) OVER {f}"
    return f"""sl AS (SELECT *,CASE WHEN {ok} THEN covar_samp(high,low) OVER {f}/var_samp(low) OVER {f} END AS slope,
CASE WHEN {ok} THEN power(corr(high,low) OVER {f},2) END AS r2 FROM bars),
rsrs AS MATERIALIZED (SELECT *,(slope-{full_sql('avg', 'slope', m)})/nullif({full_sql('stddev_samp', 'slope', m)},0)*r2 AS rsrs FROM sl)"""


@query("win_rsrs", on_bars(f"SELECT code,date,{r6('slope')} AS slope,{r6('rsrs')} AS rsrs FROM rsrs", rsrs_sql()))
def win_rsrs(t):
    return pick(I.rsrs(t.bars_m, 18, 30), "slope", "rsrs")


@query("win_rsrs_daily", daily(on_bars(f"SELECT code,date,{r6('slope')} AS slope,{r6('rsrs')} AS rsrs FROM rsrs", rsrs_sql(18, 600))))
def win_rsrs_daily(t):
    """Default lengths on daily bars."""
    return pick(I.rsrs(t.bars_s), "slope", "rsrs")


def ssa_sql() -> str:
    """The trend of windows of six bars: powers of their 3 x 3 Gram matrix, by squaring."""
    x = ",".join(f"lag(close,{6 - i}) OVER ({W}) AS x{i}" for i in range(6))
    cells = [(a, b) for a in range(3) for b in range(a, 3)]
    g = lambda a, b: f"g{min(a, b)}{max(a, b)}"
    gram = {c: "+".join(f"x{i + c[0]}*x{i + c[1]}" for i in range(4)) for c in cells}
    square = {(a, b): "+".join(f"p.{g(a, k)}*p.{g(k, b)}" for k in range(3)) for a, b in cells}
    scaled = lambda m: ",".join(f"({m[c]})/({'+'.join(m[k, k] for k in range(3))}) AS {g(*c)}" for c in cells)
    return ",".join([
        NUMBERED_SQL, f"sx AS MATERIALIZED (SELECT *,{x} FROM nb)",
        f"pw AS (SELECT code,rn,0 AS it,{scaled(gram)} FROM sx WHERE x0 IS NOT NULL UNION ALL SELECT p.code,p.rn,it+1,{scaled(square)} FROM pw p WHERE it<60)",
        "ss AS MATERIALIZED (SELECT sx.*,(x3*g02+x4*g12+x5*g22)/(g00+g11+g22) AS ssa FROM sx LEFT JOIN (SELECT * FROM pw WHERE it=60) USING (code,rn))"])


@query("win_ssa_short", with_(BARS_M_SQL, ssa_sql(), recursive=True) + f"SELECT code,date,{r6('ssa')} AS ssa FROM ss")
def win_ssa_short(t):
    return pick(I.ssa(t.bars_m, 6), "ssa")


@query("win_ssa")
def win_ssa(t):
    return pick(I.ssa(t.bars_m, 30), "ssa")


@query("formula_ma", on_bars(f"SELECT code,date,{r6('avg(close) OVER ' + wn(5))} AS ma5 FROM bars"))
def formula_ma(t):
    return pick(t.bars_m.withColumn("ma5", X.MA("close", 5)), "ma5")


@query("formula_recursive", with_(
    BARS_M_SQL, NUMBERED_SQL,
    "nx AS MATERIALIZED (SELECT *,(close-low)/nullif(high-low,0) AS a FROM nb)",
    ewm_sql("e", "nb", {"ema12": ("close", 2 / 13), "sma_5_2": ("close", 2 / 5)}),
    """dm AS (SELECT code,rn,close AS dma FROM nx WHERE rn=1 UNION ALL
SELECT s.code,s.rn,coalesce(s.a,0.5)*s.close+(1-coalesce(s.a,0.5))*p.dma FROM dm p JOIN nx s ON s.code=p.code AND s.rn=p.rn+1)""",
    recursive=True) + f"""SELECT code,date,{r6('ema12')} AS ema12,{r6('sma_5_2')} AS sma_5_2,{r6('dma')} AS dma
FROM nb JOIN e USING (code,rn) JOIN dm USING (code,rn)""")
def formula_recursive(t):
    """EMA, SMA(x,5,2) and DMA with a per-row weight, in one pass."""
    b = t.bars_m.withColumn("a", F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")))
    out = R.recur(b, [R.ema("ema12", "close", 12), R.Ewm("sma_5_2", "close", 2 / 5), R.Dynamic("dma", "close", "a")])
    return pick(out, "ema12", "sma_5_2", "dma")


@query("formula_wma", on_bars(f"""SELECT code,date,{r6('list_sum(list_transform(l,lambda x,i: x*i))/(len(l)*(len(l)+1)/2.0)')} AS wma6
FROM (SELECT code,date,list(close) OVER {wn(6)} AS l FROM bars)"""))
def formula_wma(t):
    return pick(t.bars_m.withColumn("wma6", X.WMA("close", 6)), "wma6")


@query("formula_ref", on_bars(f"SELECT code,date,{r6(f'lag(close,3) OVER ({W})')} AS ref3,{r6(f'lag(close,1) OVER ({W})')} AS ref0 FROM bars"))
def formula_ref(t):
    return pick(t.bars_m.withColumns({"ref3": X.REF("close", 3), "ref0": X.REF("close", 0)}), "ref3", "ref0")


@query("formula_extremes", on_bars(f"""SELECT code,date,{r6('max(high) OVER ' + wn(9))} AS hhv9,{r6('min(low) OVER ' + wn(9))} AS llv9,
CAST(sum(volume) OVER {wn(9)} AS BIGINT) AS sum9,{r6(f'max(high) OVER ({W} ROWS UNBOUNDED PRECEDING)')} AS hhv_all,
{r6(f'min(low) OVER ({W} ROWS UNBOUNDED PRECEDING)')} AS llv_all,CAST(sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sum_all FROM bars"""))
def formula_extremes(t):
    return t.bars_m.select(
        "code", "date", r(X.HHV("high", 9)).alias("hhv9"), r(X.LLV("low", 9)).alias("llv9"),
        X.SUM("volume", 9).cast("bigint").alias("sum9"), r(X.HHV("high", None)).alias("hhv_all"),
        r(X.LLV("low", None)).alias("llv_all"), X.SUM("volume", None).cast("bigint").alias("sum_all"),
    )


@query("formula_cross", on_bars(f"""SELECT code,date,CASE WHEN close>m AND lag(close) OVER ({W})<=lag(m) OVER ({W}) THEN 1.0 ELSE 0.0 END AS crossed,
CASE WHEN m IS NULL OR lag(m) OVER ({W}) IS NULL OR lag(close) OVER ({W}) IS NULL THEN NULL WHEN close>=m AND lag(close) OVER ({W})<lag(m) OVER ({W}) THEN 1.0 ELSE 0.0 END AS crossed_strict
FROM (SELECT *,{full_sql('avg', 'close', 5)} AS m FROM bars)""".replace("1.0 ELSE 0.0 END", "CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")))
def formula_cross(t):
    b = t.bars_m.withColumn("m", mean_n("close", 5))
    return b.select("code", "date", X.CROSS("close", "m").alias("crossed"), X.cross_strict("close", "m").alias("crossed_strict"))


@query("formula_counts", on_bars(f"""SELECT code,date,CAST(CASE WHEN sum(u) OVER {wn(3)}>=3 THEN 1 ELSE 0 END AS DOUBLE) AS every3,
CAST(CASE WHEN sum(u) OVER {wn(3)}>0 THEN 1 ELSE 0 END AS DOUBLE) AS exist3,CAST(sum(u) OVER {wn(10)} AS DOUBLE) AS count10
FROM (SELECT *,CASE WHEN close-open>0 THEN 1 ELSE 0 END AS u FROM bars)"""))
def formula_counts(t):
    b = t.bars_m.withColumn("x", F.col("close") - F.col("open"))
    return b.select("code", "date", X.EVERY("x", 3).alias("every3"), X.EXIST("x", 3).alias("exist3"), X.COUNT("x", 10).alias("count10"))


@query("formula_barslast", on_bars(f"""SELECT code,date,CAST(rn-max(CASE WHEN close>1.2*open THEN rn END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS bars_since
FROM (SELECT *,row_number() OVER ({W}) AS rn FROM bars)"""))
def formula_barslast(t):
    b = t.bars_m.withColumns({"rn": F.row_number().over(series()), "x": F.col("close") - 1.2 * F.col("open")})
    return b.select("code", "date", X.BARSLAST("x").alias("bars_since"))


@query("formula_std", on_bars(f"SELECT code,date,{r6('stddev_samp(close) OVER ' + wn(8))} AS std8 FROM bars"))
def formula_std(t):
    return pick(t.bars_m.withColumn("std8", X.STD("close", 8)), "std8")


@query("formula_scalars", on_bars(f"""SELECT code,date,{r6('greatest(open,close)')} AS mx,{r6('least(open,close)')} AS mn,{r6('abs(close-open)')} AS ab,
{r6('CASE WHEN close-open>0 THEN coalesce(p,0) ELSE coalesce(open,0) END')} AS picked,{r6('CASE WHEN close-open>0 THEN ln(close-open) END')} AS lg,
{r6('CASE WHEN close-open>=0 THEN sqrt(close-open) END')} AS sq,{r6('(close-low)/nullif(high-low,0)')} AS safe,
CAST(CASE WHEN close-open>0 AND close-p>0 THEN 1 ELSE 0 END AS DOUBLE) AS both_up,CAST(CASE WHEN close-open>0 OR coalesce(close-p>0,false) THEN 1 ELSE 0 END AS DOUBLE) AS any_up,
CAST(CASE WHEN close-p<=0 THEN 1 ELSE 0 END AS DOUBLE) AS not_up
FROM (SELECT *,lag(close) OVER ({W}) AS p FROM bars)"""))
def formula_scalars(t):
    """MAX, MIN, ABS, IF, LOG, SQRT, safe division and truth values."""
    b = t.bars_m.withColumns({"p": X.REF("close", 1), "up": F.col("close") - F.col("open")})
    b = b.withColumn("gain", F.col("close") - F.col("p"))
    return b.select(
        "code", "date", r(X.MAX("open", "close")).alias("mx"), r(X.MIN("open", "close")).alias("mn"),
        r(X.ABS("up")).alias("ab"), r(X.IF("up", "p", "open")).alias("picked"), r(X.LOG("up")).alias("lg"),
        r(X.SQRT("up")).alias("sq"), r(X.DIV(F.col("close") - F.col("low"), F.col("high") - F.col("low"))).alias("safe"),
        X.AND("up", "gain").alias("both_up"), X.OR("up", "gain").alias("any_up"), X.NOT("gain").alias("not_up"),
    )


@query("win_first_bar_of_last_month", on_bars(f"""SELECT code,date,{r6('open')} AS open FROM
(SELECT *,row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM (SELECT *,max(date_trunc('year',date)) OVER (PARTITION BY code) AS y FROM bars) WHERE date_trunc('year',date)=y) WHERE k=1"""))
def win_first_bar_of_last_month(t):
    """First bar of each symbol's own latest year: aggregate, no sort of the series."""
    per_year = t.bars_m.groupBy("code", F.trunc("date", "year").alias("y")).agg(
        F.min("date").alias("date"), F.min_by("open", "date").alias("open"))
    last = per_year.groupBy("code").agg(F.max_by(F.struct("date", "open"), "y").alias("f"))
    return last.select("code", "f.date", r("f.open").alias("open"))


@query("win_edges", on_bars(f"""SELECT code,date,s AND NOT coalesce(lag(s) OVER ({W}),false) AS entry,
(NOT s) AND coalesce(lag(s) OVER ({W}),false) AS exit FROM (SELECT code,date,coalesce(close>{full_sql('avg', 'close', 5)},false) AS s FROM bars)"""))
def win_edges(t):
    b = t.bars_m.withColumn("s", F.col("close") > mean_n("close", 5))
    return b.select("code", "date", rising_edge(F.col("s")).alias("entry"), falling_edge(F.col("s")).alias("exit"))


@query("win_forward_return", on_bars(f"SELECT code,date,{r6(f'lead(close,5) OVER ({W})/close-1')} AS fwd5 FROM bars"))
def win_forward_return(t):
    return pick(t.bars_m.withColumn("fwd5", I.forward_return(5)), "fwd5")


@query("win_calendar_forward_return", on_bars(f"""SELECT b.code,b.date,{r6('f.close/b.close-1')} AS fwd_3
FROM bars b JOIN cal c ON c.date=b.date LEFT JOIN cal n ON n.i=c.i+3 LEFT JOIN bars f ON f.code=b.code AND f.date=n.date""",
       "cal AS (SELECT date,row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars))"))
def win_calendar_forward_return(t):
    return pick(I.calendar_forward_return(t.bars_m, 3), "fwd_3")


@query("win_drawdown", on_bars(f"SELECT code,date,{r6(f'close/max(close) OVER ({W} ROWS UNBOUNDED PRECEDING)-1')} AS dd FROM bars"))
def win_drawdown(t):
    return pick(t.bars_m.withColumn("dd", I.running_drawdown("close")), "dd")


@query("win_rolling_quantile", on_bars(f"SELECT code,date,{r6(f'CASE WHEN count(close) OVER {wn(20)}>=20 THEN quantile_cont(close,0.8) OVER {wn(20)} END')} AS q80 FROM bars"))
def win_rolling_quantile(t):
    return pick(t.bars_m.withColumn("q80", I.rolling_quantile("close", 20, 0.8)), "q80")


@query("win_delayed_label", on_bars(f"SELECT code,date,{r6(f'lead(close,6) OVER ({W})/lead(close,1) OVER ({W})-1')} AS label FROM bars"))
def win_delayed_label(t):
    return pick(t.bars_m.withColumn("label", I.delayed_label()), "label")


@query("agg_equal_weight_index", on_bars(f"""SELECT date,{r6('avg(open)')} AS open,{r6('avg(high)')} AS high,{r6('avg(low)')} AS low,{r6('avg(close)')} AS close,
CAST(sum(volume) AS BIGINT) AS volume,count(*) AS n_codes FROM bars GROUP BY 1"""))
def agg_equal_weight_index(t):
    i = equal_weight_index(t.bars_m)
    return i.select("date", *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume", "n_codes")


