"""Cross-sectional statistics, information coefficients, blends and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.frames import change, div, lead
from barloom.operators import crosssec as C
from barloom.operators import factors as A
from barloom.operators import gating as G
from barloom.operators import indicators as I
from barloom.operators.ranking import top_k
from barloom.plans.join_plans import amp_sql, z_sql
from barloom.plans.registry import BARS_D_SQL, W, on_bars, query, r, r6, with_
from barloom.sources.sinks import publish

PANEL_SQL = amp_sql(5) + f""",ff AS MATERIALIZED (SELECT a.code,a.date,a.close,a.amp_imb AS amp,a.team_coin AS tc,volume/CAST(lag(volume,5) OVER (PARTITION BY a.code ORDER BY a.date) AS DOUBLE)-1 AS vc,
a.close/lag(a.close,5) OVER (PARTITION BY a.code ORDER BY a.date)-1 AS mom,lead(a.close,1) OVER (PARTITION BY a.code ORDER BY a.date)/a.close-1 AS fwd FROM amp a)"""


def panel(t):
    """Four factors and the next-bar return, one window partitioning."""
    b = A.price_action(t.bars_m, 5)
    return b.select(
        "code", "date", "close", F.col("amp_imb_5").alias("amp"), F.col("team_coin_5").alias("tc"),
        change(F.col("volume").cast("double"), 5).alias("vc"), change("close", 5).alias("mom"), (div(lead("close"), "close") - 1.0).alias("fwd"))


def rank_sql(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x})+(count(*) OVER (PARTITION BY {by},{x})-1)/2.0)"


def ic_sql(name: str, src: str, x: str, y: str, by: str = "date", n: int = 5, extra: str = "") -> str:
    return f"""{name}_r AS (SELECT {by},{x} AS x0,{rank_sql(x, by)} AS rx,{rank_sql(y, by)} AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{name} AS MATERIALIZED (SELECT {by},CASE WHEN count(*)>={n} AND max(rx)>min(rx) AND max(ry)>min(ry) {extra} THEN corr(rx,ry) END AS ic,count(*) AS n_obs FROM {name}_r GROUP BY {by})"""


@query("ic_zscore", on_bars(f"SELECT code,date,{r6(z_sql('amp'))} AS z_amp,{r6(z_sql('mom'))} AS z_mom FROM ff", PANEL_SQL))
def ic_zscore(t):
    return C.zscore(panel(t), ["amp", "mom"]).select("code", "date", r("z_amp").alias("z_amp"), r("z_mom").alias("z_mom"))


@query("ic_zscore_population", on_bars(f"SELECT code,date,{r6(z_sql('amp', 'date', 'stddev_pop'))} AS z_amp FROM ff", PANEL_SQL))
def ic_zscore_population(t):
    return C.zscore(panel(t), ["amp"], ddof=0).select("code", "date", r("z_amp").alias("z_amp"))


def rz_sql(c: str, s: int) -> str:
    k = f"r_{c}"
    return f"({s}*CASE WHEN {c} IS NULL THEN NULL WHEN coalesce(stddev_pop({k}) OVER (PARTITION BY date),0)=0 THEN 0 ELSE ({k}-avg({k}) OVER (PARTITION BY date))/stddev_pop({k}) OVER (PARTITION BY date) END)"


def rnull_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST)+(count(*) OVER (PARTITION BY date,{c})-1)/2.0 END AS r_{c}"


@query("ic_rank_z_combination", on_bars(f"SELECT code,date,{r6('(' + rz_sql('amp', -1) + '+' + rz_sql('mom', 1) + ')/2')} AS composite FROM (SELECT *,{rnull_sql('amp')},{rnull_sql('mom')} FROM ff)", PANEL_SQL))
def ic_rank_z_combination(t):
    return C.rank_z_combine(panel(t), {"amp": -1, "mom": 1}).select("code", "date", r("composite").alias("composite"))


@query("ic_spearman", on_bars(f"SELECT date,{r6('ic')} AS ic,n_obs FROM ic", PANEL_SQL, ic_sql("ic", "ff", "amp", "fwd", n=30, extra="AND count(DISTINCT x0)>=5")))
def ic_spearman(t):
    return C.rank_ic(panel(t), "amp", "fwd", min_obs=30, min_distinct=5).select("date", r("ic").alias("ic"), "n_obs")


@query("ic_spearman_ties", with_(BARS_D_SQL, f"x AS (SELECT code,date,CAST(volume AS DOUBLE) AS v,lead(close,1) OVER ({W})/nullif(close,0)-1 AS fwd FROM bars)", ic_sql("ic", "x", "v", "fwd", n=6)) + f"SELECT date,{r6('ic')} AS ic,n_obs FROM ic")
def ic_spearman_ties(t):
    """Daily panel whose factor is heavily tied (event counts)."""
    b = t.bars_d.select("code", "date", F.col("volume").cast("double").alias("v"), I.forward_return(1).alias("fwd"))
    return C.rank_ic(b, "v", "fwd", min_obs=6).select("date", r("ic").alias("ic"), "n_obs")


SUMMARY = f"count(ic) AS n_periods,{r6('avg(ic)')} AS ic_mean,{r6('stddev_samp(ic)')} AS ic_std,{r6('avg(CASE WHEN ic>0 THEN 1.0 ELSE 0 END)')} AS ic_positive,{r6('avg(n_obs)')} AS obs_per_period,{r6('avg(ic)/nullif(stddev_samp(ic),0)*sqrt(12)')} AS icir"
STAT_COLS = ["ic_mean", "ic_std", "ic_positive", "obs_per_period", "icir"]


@query("ic_summary", on_bars(f"SELECT {SUMMARY} FROM ic WHERE ic IS NOT NULL", PANEL_SQL, ic_sql("ic", "ff", "amp", "fwd")))
def ic_summary(t):
    s = C.ic_stats(C.rank_ic(panel(t), "amp", "fwd", min_obs=5))
    return s.select("n_periods", *[r(c).alias(c) for c in STAT_COLS])


LONG_SQL = "lg AS (SELECT date,amp AS target,UNNEST(['tc','vc','mom']) AS factor,UNNEST([tc,vc,mom]) AS value FROM ff)"
ORTH_SQL = f"SELECT factor,{r6('avg(ic)')} AS rho_mean,{r6('avg(abs(ic))')} AS rho_mean_abs,{r6('max(abs(ic))')} AS rho_max_abs,count(*) AS n_periods FROM oc WHERE ic IS NOT NULL GROUP BY 1"


@query("ic_orthogonality", on_bars(ORTH_SQL, PANEL_SQL, LONG_SQL, ic_sql("oc", "lg", "target", "value", "date,factor")))
def ic_orthogonality(t):
    o = C.orthogonality(panel(t), "amp", ["tc", "vc", "mom"])
    return o.select("factor", r("rho_mean").alias("rho_mean"), r("rho_mean_abs").alias("rho_mean_abs"), r("rho_max_abs").alias("rho_max_abs"), "n_periods")


@query("ic_redundancy", on_bars(f"SELECT {r6('max(m)')} AS worst,count(*) AS n_compared,max(m)<0.7 AS passes FROM (SELECT factor,avg(abs(ic)) AS m FROM oc WHERE ic IS NOT NULL GROUP BY 1)", PANEL_SQL, LONG_SQL, ic_sql("oc", "lg", "target", "value", "date,factor")))
def ic_redundancy(t):
    return C.redundancy(panel(t), "amp", ["tc", "vc", "mom"]).select(r("worst").alias("worst"), "n_compared", "passes")


QB_SQL = """qp AS (SELECT *,row_number() OVER (PARTITION BY date ORDER BY amp,code) AS p,count(*) OVER (PARTITION BY date) AS n FROM ff WHERE amp IS NOT NULL AND fwd IS NOT NULL),
qb AS MATERIALIZED (SELECT date,CAST(greatest(1,coalesce(ceil((p-1)*5.0/nullif(n-1,0)),1)) AS INTEGER) AS bucket,avg(fwd) AS mean_ret,count(*) AS n FROM qp GROUP BY 1,2)"""


@query("ic_quintile_returns", on_bars(f"SELECT date,bucket,{r6('mean_ret')} AS mean_ret,n FROM qb", PANEL_SQL, QB_SQL))
def ic_quintile_returns(t):
    return C.quantile_returns(panel(t), "amp", "fwd").select("date", "bucket", r("mean_ret").alias("mean_ret"), "n")


@query("ic_quintile_spread", on_bars(f"SELECT date,{r6('(max(CASE WHEN bucket=5 THEN mean_ret END)-max(CASE WHEN bucket=1 THEN mean_ret END))*1e4', 3)} AS spread_bps FROM qb GROUP BY 1", PANEL_SQL, QB_SQL))
def ic_quintile_spread(t):
    return C.spread_bps(C.quantile_returns(panel(t), "amp", "fwd")).select("date", r("spread_bps", 3).alias("spread_bps"))


@query("ic_long_short", on_bars(f"""SELECT date,{r6('avg(CASE WHEN p>n-q THEN fwd END)-avg(CASE WHEN p<=q THEN fwd END)')} AS ls_ret,count(*) AS n_names FROM
(SELECT *,greatest(1,floor(n*0.2)) AS q FROM (SELECT *,row_number() OVER (PARTITION BY date ORDER BY amp,code) AS p,count(*) OVER (PARTITION BY date) AS n FROM ff WHERE amp IS NOT NULL AND fwd IS NOT NULL)) WHERE n>=20 GROUP BY 1""", PANEL_SQL))
def ic_long_short(t):
    return C.long_short(panel(t), "amp", "fwd").select("date", r("ls_ret").alias("ls_ret"), "n_names")


def nz(c: str) -> str:
    return z_sql(f"-{c}")


COMBOS = {"A": ["vc"], "B": ["vc", "mom"], "C": ["vc", "amp"], "D": ["vc", "tc"], "E": ["vc", "mom", "amp", "tc"]}


@query("ic_signal_combos", on_bars("SELECT code,date," + ",".join(f"{r6('(' + '+'.join('z_' + c for c in cs) + f')/{len(cs)}')} AS combo_{k.lower()}" for k, cs in COMBOS.items()) +
       " FROM (SELECT code,date," + ",".join(f"{nz(c)} AS z_{c}" for c in ("vc", "mom", "amp", "tc")) + " FROM ff)", PANEL_SQL))
def ic_signal_combos(t):
    """Five averages of z-scored negated factors."""
    p = panel(t).withColumns({f"n_{c}": -F.col(c) for c in ("vc", "mom", "amp", "tc")})
    z = C.zscore(p, ["n_vc", "n_mom", "n_amp", "n_tc"])
    outs = [r(sum((F.col(f"z_n_{c}") for c in cs[1:]), F.col(f"z_n_{cs[0]}")) / float(len(cs))).alias(f"combo_{k.lower()}") for k, cs in COMBOS.items()]
    return z.select("code", "date", *outs)


@query("ic_blend", on_bars(f"SELECT code,date,{r6(z_sql('mom') + '-0.3*' + z_sql('amp') + '+0.1*' + z_sql('vc'))} AS blended FROM ff", PANEL_SQL))
def ic_blend(t):
    return C.blend(panel(t), "mom", {"amp": -0.3, "vc": 0.1}).select("code", "date", r("blended").alias("blended"))


@query("ic_contributions", on_bars(f"""SELECT date,code,UNNEST(['mom','amp','vc']) AS component,UNNEST([{r6(z_sql('mom'))},{r6('-0.3*' + z_sql('amp'))},{r6('0.1*' + z_sql('vc'))}]) AS contribution FROM ff""", PANEL_SQL))
def ic_contributions(t):
    return C.contributions(panel(t), "mom", {"amp": -0.3, "vc": 0.1}).select("date", "code", "component", r("contribution").alias("contribution"))


SCREEN_SQL = "sc AS (SELECT date,fwd,UNNEST(['amp','tc','vc','mom']) AS factor,UNNEST([amp,tc,vc,mom]) AS value FROM ff)"


@query("ic_mass_screen", on_bars(f"SELECT factor,{SUMMARY} FROM fi WHERE ic IS NOT NULL GROUP BY factor", PANEL_SQL, SCREEN_SQL, ic_sql("fi", "sc", "value", "fwd", "date,factor")))
def ic_mass_screen(t):
    """Many factors in long form against one return panel, in one job."""
    long = C.unpivot(panel(t), ["code", "date", "fwd"], ["amp", "tc", "vc", "mom"])
    s = C.ic_stats(C.rank_ic(long, "value", "fwd", ["date", "factor"]), ["factor"])
    return s.select("factor", "n_periods", *[r(c).alias(c) for c in STAT_COLS])


def half_screens(t):
    """Screens before and after mid-1998; the correlations (dates x factors) are written once and read twice."""
    long = C.unpivot(panel(t), ["code", "date", "fwd"], ["amp", "tc", "vc", "mom"])
    ics = publish(C.rank_ic(long, "value", "fwd", ["date", "factor"]), "ics")
    early = C.ic_stats(ics.where("date < '1998-06-01'"), ["factor"])
    return early, C.ic_stats(ics.where("date >= '1998-06-01'"), ["factor"])


HALF = "avg(CASE WHEN {c} THEN ic END)/stddev_samp(CASE WHEN {c} THEN ic END)*sqrt(12)"
E_, L_ = HALF.format(c="date<'1998-06-01'"), HALF.format(c="date>='1998-06-01'")


@query("ic_screen_comparison", on_bars(f"SELECT factor,{r6('b')} AS before,{r6('a')} AS after,CASE WHEN sign(b)*sign(a)<0 THEN 'flipped' ELSE 'kept' END AS status,{r6('a-b')} AS move FROM (SELECT factor,{E_} AS b,{L_} AS a FROM fi GROUP BY 1)", PANEL_SQL, SCREEN_SQL, ic_sql("fi", "sc", "value", "fwd", "date,factor")))
def ic_screen_comparison(t):
    c = G.compare_screens(*half_screens(t))
    return c.select("factor", r("before").alias("before"), r("after").alias("after"), "status", r("move").alias("move"))


@query("ic_factor_month_matrix", on_bars(f"SELECT factor,CAST(date_trunc('month',date) AS DATE) AS month,{r6('avg(ic)')} AS ic,count(ic) AS n FROM fi GROUP BY 1,2", PANEL_SQL, SCREEN_SQL, ic_sql("fi", "sc", "value", "fwd", "date,factor")))
def ic_factor_month_matrix(t):
    """Factor x month matrix of mean IC in long form, so no month can be left out."""
    long = C.unpivot(panel(t), ["code", "date", "fwd"], ["amp", "tc", "vc", "mom"])
    ics = C.rank_ic(long, "value", "fwd", ["date", "factor"]).groupBy("factor", F.trunc("date", "month").alias("month"))
    return ics.agg(F.avg("ic").alias("ic"), F.count("ic").alias("n")).select("factor", "month", r("ic").alias("ic"), "n")


@query("ic_monthly_breakdown", with_(BARS_D_SQL, f"x AS (SELECT code,date,close AS v,lead(close,1) OVER ({W})/nullif(close,0)-1 AS fwd FROM bars)", ic_sql("ic", "x", "v", "fwd", n=6)) +
       f"SELECT CAST(date_trunc('month',date) AS DATE) AS month,count(*) AS n,{r6('avg(ic)')} AS ic_mean,{r6('stddev_samp(ic)')} AS ic_std,{r6('avg(CASE WHEN ic>0 THEN 1.0 ELSE 0 END)')} AS ic_positive,{r6('avg(ic)/stddev_samp(ic)*sqrt(21)')} AS icir FROM ic WHERE ic IS NOT NULL GROUP BY 1")
def ic_monthly_breakdown(t):
    b = t.bars_d.select("date", F.col("close").alias("v"), I.forward_return(1).alias("fwd"))
    m = C.monthly_breakdown(C.rank_ic(b, "v", "fwd", min_obs=6))
    return m.select("month", "n", *[r(c).alias(c) for c in ("ic_mean", "ic_std", "ic_positive", "icir")])


def candidates(t):
    """One candidate per factor from the screen, with gate metrics."""
    early, late = half_screens(t)
    c = late.select(F.col("factor").alias("name"), F.col("n_periods").alias("n_months"), "icir", F.col("ic_positive").alias("is_calmar"))
    c = c.join(early.select(F.col("factor").alias("name"), F.col("icir").alias("icir_before")), "name")
    return G.derived_metrics(c.withColumns({"lambda_locked": F.lit(0.3), "lambda_max": F.when(F.col("icir") > 0, 0.3).otherwise(0.5)}))


def mode_table(t):
    """Failure modes as rows, in the shape of the rule file."""
    rules = "array(named_struct('key',k1,'op',o1,'threshold',t1),named_struct('key',k2,'op',o2,'threshold',t2))"
    rows = [("short_and_weak", "all", "reject", "n_months", "<", 60.0, "icir_abs", "<", 0.5), ("any_edge", "any", "warn", "lambda_at_max", "==", 1.0, "is_calmar", "<=", 0.4), ("unknown_metric", "all", "reject", "no_such", ">", 0.0, "icir_abs", ">=", 0.0)]
    df = t.spark.createDataFrame(rows, "id string, logic string, severity string, k1 string, o1 string, t1 double, k2 string, o2 string, t2 double")
    return df.select("id", "logic", "severity", F.expr(rules).alias("rules"))


@query("ic_candidate_gate", on_bars(f"""SELECT name,array_to_string(list_filter([CASE WHEN lam THEN 'any_edge' END,CASE WHEN sw THEN 'short_and_weak' END],lambda x: x IS NOT NULL),',') AS fired,NOT sw AS passes FROM
(SELECT factor AS name,n<60 AND abs(a)<0.5 AS sw,a>0 OR p<=0.4 AS lam FROM (SELECT factor,count(ic) FILTER (WHERE date>='1998-06-01') AS n,{L_} AS a,avg(CASE WHEN date>='1998-06-01' THEN CASE WHEN ic>0 THEN 1.0 ELSE 0 END END) AS p FROM fi WHERE ic IS NOT NULL GROUP BY 1))""", PANEL_SQL, SCREEN_SQL, ic_sql("fi", "sc", "value", "fwd", "date,factor")))
def ic_candidate_gate(t):
    g = G.gate(candidates(t), mode_table(t), ["n_months", "icir_abs", "lambda_at_max", "is_calmar"])
    return g.select("name", F.array_join("fired", ",").alias("fired"), "passes")


@query("ic_walk_forward_split", on_bars("""SELECT t.date AS test_month,m.date AS month,CASE WHEN m.i=t.i THEN 'test' WHEN m.i=t.i-1 THEN 'valid' ELSE 'train' END AS split FROM c t JOIN c m ON m.i BETWEEN t.i-13 AND t.i WHERE t.i>13""",
       "c AS (SELECT date,row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars))"))
def ic_walk_forward_split(t):
    return C.walk_forward_split(t.bars_m.select(F.col("date").alias("month")).distinct(), 12)


@query("ic_topk_and_ic", on_bars(f"""SELECT k.date,{r6('ret')} AS topk_ret,{r6('ic')} AS ic FROM (SELECT date,avg(fwd) AS ret FROM (SELECT *,row_number() OVER (PARTITION BY date ORDER BY mom DESC,code) AS k FROM ff WHERE mom IS NOT NULL AND fwd IS NOT NULL) WHERE k<=10 GROUP BY 1) k JOIN ic USING (date)""", PANEL_SQL, ic_sql("ic", "ff", "mom", "fwd")))
def ic_topk_and_ic(t):
    p = panel(t).where("mom is not null and fwd is not null")
    top = top_k(p, ["date"], [F.desc("mom"), F.asc("code")], 10).groupBy("date").agg(F.avg("fwd").alias("ret"))
    return top.join(C.rank_ic(p, "mom", "fwd"), "date").select("date", r("ret").alias("topk_ret"), r("ic").alias("ic"))


@query("ic_label_factors", on_bars("SELECT DISTINCT factor,CASE factor WHEN 'amp' THEN 'stable' WHEN 'vc' THEN 'volume_leak' WHEN 'mom' THEN 'spurious' ELSE 'unlabelled' END AS label FROM fi", PANEL_SQL, SCREEN_SQL, ic_sql("fi", "sc", "value", "fwd", "date,factor")))
def ic_label_factors(t):
    labels = t.spark.createDataFrame([("amp", "stable"), ("amp", "derived"), ("vc", "volume_leak"), ("mom", "spurious"), ("mom", "derived")], "factor string, label string")
    s = C.unpivot(panel(t), ["code", "date", "fwd"], ["amp", "tc", "vc", "mom"])
    screened = C.rank_ic(s, "value", "fwd", ["date", "factor"]).select("factor").distinct()
    return G.label_factors(screened, labels, ["stable", "spurious", "volume_leak", "derived"])


@query("ic_model_blend", on_bars(f"SELECT code,date,{r6('(mom+vc)/2')} AS blend2,{r6('avg_score')} AS avg_score FROM ff JOIN (SELECT code,date,avg(s) AS avg_score FROM (SELECT code,date,UNNEST([mom,vc,amp]) AS s FROM ff) GROUP BY 1,2) USING (code,date) WHERE mom IS NOT NULL AND vc IS NOT NULL", PANEL_SQL))
def ic_model_blend(t):
    """Two models on common keys (0.5/0.5) and the mean over several runs of one model."""
    p = panel(t)
    two = p.where("mom is not null and vc is not null").select("code", "date", ((F.col("mom") + F.col("vc")) / 2.0).alias("blend2"))
    runs = C.unpivot(p, ["code", "date"], ["mom", "vc", "amp"], "run", "s")
    mean = runs.groupBy("code", "date").agg(F.avg("s").alias("avg_score"))
    return two.join(mean, ["code", "date"]).select("code", "date", r("blend2").alias("blend2"), r("avg_score").alias("avg_score"))


