"""Projections, filters, top-K, set operations and table aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.functions.frames import change, trail
from barloom.operators import tables as B
from barloom.operators.ranking import top_k, with_global
from barloom.operators.trades import numbered
from barloom.plans.indicator_plans import pick
from barloom.plans.registry import (
    ANN_SQL, BARS_D_SQL, BARS_M_SQL, SUPPLIERS_SQL, TRADES_SQL, W, on_bars, query, r, r6, with_, wn,
)

LAG = f"lag(close) OVER ({W})"
CODE_SQL = "lpad(CAST((o_custkey*7919)%1000000 AS VARCHAR),6,'0')"


def codes(t):
    return t.table("orders").select("o_orderkey", F.lpad(((F.col("o_custkey") * 7919) % 1000000).cast("string"), 6, "0").alias("code"))


@query("proj_codes", f"""SELECT o_orderkey,code,CASE WHEN code LIKE '6%' THEN 'SH' ELSE 'SZ' END||code AS p1,
CASE WHEN left(code,1) IN ('6','9') THEN 'SH' ELSE 'SZ' END||code AS p2,CASE WHEN left(code,1) IN ('6','9') THEN 'sh' WHEN left(code,1) IN ('8','4') THEN 'bj' ELSE 'sz' END||code AS p3,
code||'.'||CASE WHEN left(code,1) IN ('6','9') THEN 'SH' WHEN left(code,1) IN ('8','4') THEN 'BJ' ELSE 'SZ' END AS p4,code AS stripped FROM (SELECT o_orderkey,{CODE_SQL} AS code FROM orders)""")
def proj_codes(t):
    """Padding, the four exchange prefix/suffix forms, and stripping back."""
    c = F.col("code")
    d = codes(t).withColumns({
        "p1": S.add_prefix(c), "p2": S.add_prefix(c, sh="^[69]"), "p3": S.add_prefix(c, sh="^[69]", bj="^[84]", lower=True), "p4": S.add_suffix(c)})
    return d.withColumn("stripped", S.strip_prefix(F.col("p3")))


BARE = "CASE WHEN regexp_matches(code,'^00[0-3]') THEN '深主板' WHEN regexp_matches(code,'^30[01]') THEN '创业板' WHEN code LIKE '60%' THEN '沪主板' WHEN code LIKE '688%' THEN '科创板' WHEN regexp_matches(code,'^[84]') THEN '北交所' ELSE '其他' END"


@query("proj_board", f"""SELECT o_orderkey,code,{BARE} AS board,CASE WHEN s LIKE 'sh60%' THEN '沪主板' WHEN s LIKE 'sh68%' THEN '科创板' WHEN s LIKE 'sz00%' THEN '深主板' WHEN s LIKE 'sz30%' THEN '创业板' WHEN s LIKE 'bj%' THEN '北交所' ELSE '其他' END AS board2
FROM (SELECT *,CASE WHEN left(code,1) IN ('6','9') THEN 'sh' WHEN left(code,1) IN ('8','4') THEN 'bj' ELSE 'sz' END||code AS s FROM (SELECT o_orderkey,{CODE_SQL} AS code FROM orders))""")
def proj_board(t):
    c = F.col("code")
    d = codes(t).withColumn("s", S.add_prefix(c, sh="^[69]", bj="^[84]", lower=True))
    return d.select("o_orderkey", "code", S.board_of(c).alias("board"), S.board_of_prefixed(F.col("s")).alias("board2"))


@query("proj_normalise", """SELECT code,date,value FROM (SELECT lpad(CAST(user_id AS VARCHAR),6,'0') AS code,CASE WHEN event_type='error' THEN NULL ELSE CAST(ts AS DATE) END AS date,
CASE WHEN event_type='view' THEN NULL ELSE value END AS value FROM events) WHERE date IS NOT NULL""")
def proj_normalise(t):
    """Text columns from a feed: bad numbers and dates become null, rows without a date go."""
    raw = t.table("events").select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("sym"),
        F.when(F.col("event_type") == "error", "--").otherwise(F.to_date("ts").cast("string")).alias("day"),
        F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    return B.normalise(raw, {"sym": "code", "day": "date"}, ["value"], ["date"], {"turnover": "double"}).select("code", "date", "value")


@query("proj_unlock_type", """SELECT o_orderkey,CASE k WHEN 0 THEN 'ipo' WHEN 1 THEN 'spo' WHEN 2 THEN 'incentive' WHEN 3 THEN 'other' WHEN 4 THEN 'ipo' ELSE 'spo' END AS kind FROM (SELECT o_orderkey,o_orderkey%6 AS k FROM orders)""")
def proj_unlock_type(t):
    names = F.array(*[F.lit(x) for x in ("首发原股东限售股份", "定向增发机构配售股份", "股权激励限售股份", "追加承诺限售股份上市流通", "首发一般股份", "定增限售")])
    d = t.table("orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("zh"))
    return d.select("o_orderkey", S.unlock_type(F.col("zh")).alias("kind"))


RATE_LIST = ["买入", "增持", "持有", "减持", "卖出", "其它"]


@query("proj_rating", """SELECT o_orderkey,s AS rating_score,s-l AS rating_delta,CASE WHEN s>l THEN 1 ELSE 0 END AS is_upgrade,CASE WHEN s<l THEN 1 ELSE 0 END AS is_downgrade,CASE WHEN s=l THEN 1 ELSE 0 END AS is_reaffirm FROM
(SELECT o_orderkey,CASE CAST(o_orderkey%6 AS INTEGER) WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN -1 WHEN 4 THEN -2 END AS s,CASE CAST(o_custkey%6 AS INTEGER) WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN -1 WHEN 4 THEN -2 END AS l FROM orders)""")
def proj_rating(t):
    names = F.array(*[F.lit(x) for x in RATE_LIST])
    at = lambda c: F.element_at(names, (F.col(c) % 6 + 1).cast("int"))
    d = t.table("orders").select("o_orderkey", S.rating_score(at("o_orderkey")).alias("rating_score"), S.rating_score(at("o_custkey")).alias("l"))
    return d.select("o_orderkey", "rating_score", *[c.alias(n) for n, c in S.rating_change(F.col("rating_score"), F.col("l")).items()])


@query("proj_validate_trades", with_(TRADES_SQL) + """SELECT sym,date,seq,l_orderkey,l_linenumber,l_partkey,CASE WHEN price>90000 THEN 'bad_price' END AS e1,CASE WHEN shares>48 THEN 'bad_shares' END AS e2 FROM trades WHERE price>90000 OR shares>48""")
def proj_validate_trades(t):
    """Rejected rows with their place in the log and their reasons (limits shifted so that real rows violate them)."""
    x = numbered(t.trades).withColumns({"price": F.lit(90000.0) - F.col("price") + 1e-9, "shares": F.lit(49) - F.col("shares")})
    _, bad = B.split_valid(x, B.trade_rules())
    has = lambda e: F.when(F.array_contains("errors", e), F.lit(e))
    return bad.select("sym", "date", F.col("n").alias("seq"), "seq.*", has("bad_price").alias("e1"), has("bad_shares").alias("e2"))


@query("proj_bar_contract", on_bars("SELECT CAST(count(*) FILTER (WHERE n>1) AS BIGINT) AS duplicate_keys,count(*) FILTER (WHERE n>1)=0 AS ok FROM (SELECT code,date,count(*) AS n FROM bars GROUP BY 1,2)"))
def proj_bar_contract(t):
    return B.check_bars(t.bars_m).select("duplicate_keys", "ok")


@query("proj_drop_columns", "SELECT c_custkey,c_nationkey,c_mktsegment FROM customer")
def proj_drop_columns(t):
    """Personal columns dropped; they are never read from the file."""
    return t.table("customer").drop("c_name", "c_acctbal")


@query("filter_min_rows", with_(BARS_D_SQL) + "SELECT code,date,close FROM bars WHERE code IN (SELECT code FROM bars GROUP BY 1 HAVING count(*)>=28)")
def filter_min_rows(t):
    return B.long_enough(t.bars_d, 28).select("code", "date", "close")


@query("filter_universe", f"SELECT code,name FROM (SELECT {CODE_SQL.replace('o_custkey', 'c_custkey')} AS code,CASE WHEN c_custkey%11=0 THEN 'ST'||c_name WHEN c_custkey%13=0 THEN c_name||'退' ELSE c_name END AS name FROM customer) WHERE NOT (name LIKE '%ST%' OR name LIKE '%退%') AND left(code,1) NOT IN ('8','4') AND left(code,2)<>'30'")
def filter_universe(t):
    c = t.table("customer").select(
        F.lpad(((F.col("c_custkey") * 7919) % 1000000).cast("string"), 6, "0").alias("code"),
        F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("ST"), "c_name")).when(F.col("c_custkey") % 13 == 0, F.concat("c_name", F.lit("退"))).otherwise(F.col("c_name")).alias("name"))
    return B.universe(c, drop_chinext=True)


@query("filter_special_treatment", "SELECT c_custkey,s FROM (SELECT c_custkey,CASE c_custkey%5 WHEN 0 THEN 's t '||c_custkey WHEN 1 THEN 'P T' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'Good' END AS s FROM customer) WHERE s='Good'")
def filter_special_treatment(t):
    k = F.col("c_custkey") % 5
    d = t.table("customer").select("c_custkey", F.when(k == 0, F.concat(F.lit("s t "), F.col("c_custkey").cast("string"))).when(k == 1, "P T").when(k == 2, "").when(k == 4, "Good").alias("s"))
    return d.where(~S.is_special_treatment(F.col("s")))


@query("filter_price_limit", on_bars(f"SELECT code,date,{r6('chg')} AS chg FROM (SELECT code,date,close/{LAG}-1 AS chg FROM bars) WHERE chg>-(CASE WHEN code LIKE '00000%' THEN 0.195 ELSE 0.095 END) AND chg<(CASE WHEN code LIKE '00000%' THEN 0.195 ELSE 0.095 END)"))
def filter_price_limit(t):
    """Moves strictly inside the symbol's limit."""
    b = t.bars_m.withColumn("chg", change("close"))
    lim = S.limit_threshold(F.col("code"), wide_prefix="^00000")
    return b.where((F.col("chg") > -lim) & (F.col("chg") < lim)).select("code", "date", r("chg").alias("chg"))


@query("filter_latest_date", on_bars(f"SELECT code,date,{r6('close')} AS close FROM bars WHERE date=(SELECT max(date) FROM bars)"))
def filter_latest_date(t):
    """The newest month is found on the raw column, and the raw rows are cut at its first day before any bar is built."""
    newest = t.lineitem.agg(F.trunc(F.max("l_shipdate"), "month").cast(t.lineitem.schema["l_shipdate"].dataType).alias("d")).scalar()
    return t.bars_from(t.lineitem.where(F.col("l_shipdate") >= newest)).select("code", "date", r("close").alias("close"))


@query("filter_full_coverage_date", with_(BARS_D_SQL, "c AS (SELECT date,count(DISTINCT code) AS n FROM bars GROUP BY 1)", "l AS (SELECT * FROM c ORDER BY date DESC LIMIT 10)") +
       "SELECT (SELECT max(date) FROM l WHERE n>=floor((SELECT max(n) FROM l)*0.8)) AS by_share,(SELECT max(date) FROM c WHERE n>=100) AS by_count")
def filter_full_coverage_date(t):
    a = B.full_coverage_date(t.bars_d).withColumnRenamed("date", "by_share")
    return with_global(a, B.full_coverage_date(t.bars_d, min_codes=100).withColumnRenamed("date", "by_count"))


@query("filter_staleness", with_(BARS_D_SQL) + """SELECT code,CASE WHEN age>2 THEN 'stale-'||age ELSE 'ok' END AS status FROM (SELECT code,date_diff('day',max(date),DATE '2024-01-31') AS age FROM bars GROUP BY 1)""")
def filter_staleness(t):
    last = t.bars_d.groupBy("code").agg(F.max("date").alias("d"))
    return last.select("code", B.staleness(F.col("d"), F.lit("2024-01-31").cast("date"), 2).alias("status"))


@query("filter_quality_screen", on_bars(f"""SELECT code,date,{r6('cap')} AS mkt_cap FROM (SELECT *,close*1000/1e8 AS cap,volume/1000.0 AS turnover,max(abs((close/{LAG}-1)*100)) OVER {wn(6)} AS mx FROM
(SELECT * FROM bars)) WHERE cap>=0.02 AND turnover>=0.1 AND NOT regexp_matches(code,'900|200') AND mx>60""".replace(f"max(abs((close/{LAG}-1)*100)) OVER {wn(6)}", f"max(mv) OVER {wn(6)}").replace("(SELECT * FROM bars)", f"(SELECT *,abs((close/{LAG}-1)*100) AS mv FROM bars)")))
def filter_quality_screen(t):
    b = t.bars_m.withColumn("mv", F.abs(change("close") * 100.0))
    b = b.withColumns({"mkt_cap": F.col("close") * 1000 / 1e8, "turnover": F.col("volume") / 1000.0, "max_abs_chg": F.max("mv").over(trail(6))})
    return B.quality_screen(b, min_cap=0.02, min_turnover=0.1, max_move=60).select("code", "date", r("mkt_cap").alias("mkt_cap"))


@query("filter_affordable", on_bars(f"SELECT code,date,{r6('close')} AS close FROM bars WHERE close<=1500"))
def filter_affordable(t):
    return t.bars_m.where("close <= 1500").select("code", "date", r("close").alias("close"))


@query("filter_corrupt_symbols", on_bars("SELECT DISTINCT code FROM bars WHERE close<0 OR (year(date)=1998 AND close<100)"))
def filter_corrupt_symbols(t):
    return B.corrupt_symbols(t.bars_m, floor=100, year=1998)


# --- top-K -----------------------------------------------------------------
@query("top_per_date", on_bars("SELECT date,code,k AS rank FROM (SELECT date,code,row_number() OVER (PARTITION BY date ORDER BY volume DESC,code) AS k FROM bars) WHERE k<=5"))
def top_per_date(t):
    return top_k(t.bars_m, ["date"], [F.desc("volume"), F.asc("code")], 5).select("date", "code", "rank")


@query("top_multi_key", on_bars(f"SELECT code,date,volume,{r6('close')} AS close FROM bars ORDER BY volume DESC,(CASE WHEN close>open THEN 0 ELSE 1 END),close,code,date LIMIT 25"))
def top_multi_key(t):
    """Score desc, up-trend first, oscillator asc."""
    b = t.bars_m.orderBy(F.desc("volume"), F.when(F.col("close") > F.col("open"), 0).otherwise(1), "close", "code", "date").limit(25)
    return b.select("code", "date", "volume", r("close").alias("close"))


@query("top_global", on_bars(f"SELECT code,date,{r6('amount', 4)} AS amount FROM bars ORDER BY amount DESC,code,date LIMIT 20"))
def top_global(t):
    return t.bars_m.orderBy(F.desc("amount"), "code", "date").limit(20).select("code", "date", r("amount", 4).alias("amount"))


@query("top_pool_filtered", on_bars(f"""SELECT date,code,k2 AS rank FROM (SELECT *,row_number() OVER (PARTITION BY date ORDER BY k) AS k2 FROM (SELECT *,row_number() OVER (PARTITION BY date ORDER BY volume DESC,code) AS k FROM
(SELECT *,close/{LAG}-1 AS chg FROM bars)) WHERE k<=20 AND chg>-0.5 AND chg<0.5) WHERE k2<=5"""))
def top_pool_filtered(t):
    """Pool of K x 4, drop limit moves, first K survivors."""
    b = t.bars_m.withColumn("chg", change("close"))
    pool = top_k(b, ["date"], [F.desc("volume"), F.asc("code")], 20, "k").where("chg > -0.5 and chg < 0.5")
    return top_k(pool, ["date"], [F.asc("k")], 5).select("date", "code", "rank")


@query("top_last_rows", on_bars(f"SELECT code,date,{r6('close')} AS close FROM (SELECT *,row_number() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM bars) WHERE k<=6"))
def top_last_rows(t):
    return pick(top_k(t.bars_m, ["code"], [F.desc("date")], 6), "close")


@query("top_by_abs", on_bars(f"SELECT code,date,{r6('chg')} AS chg FROM (SELECT *,close/{LAG}-1 AS chg FROM bars) WHERE chg IS NOT NULL ORDER BY abs(chg) DESC,code,date LIMIT 15"))
def top_by_abs(t):
    b = t.bars_m.withColumn("chg", change("close")).where("chg is not null")
    return pick(b.orderBy(F.desc(F.abs("chg")), "code", "date").limit(15), "chg")


@query("top_weighted_popularity", "SELECT p_partkey,score FROM (SELECT l_partkey AS p_partkey,CAST(3*count(*)+2*count(*) FILTER (WHERE l_returnflag='R')+sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY 1) ORDER BY score DESC,p_partkey LIMIT 50")
def top_weighted_popularity(t):
    g = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        (3 * F.count(F.lit(1)) + 2 * F.count(F.when(F.col("l_returnflag") == "R", 1)) + F.sum("l_quantity")).cast("bigint").alias("score"))
    return g.orderBy(F.desc("score"), "p_partkey").limit(50)


# --- set operations --------------------------------------------------------
@query("set_union_all", "SELECT k,src FROM (SELECT o_custkey AS k,'orders' AS src FROM orders UNION ALL SELECT c_custkey,'customer' FROM customer)")
def set_union_all(t):
    a = t.table("orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("src"))
    return a.unionByName(t.table("customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("src")))


@query("set_distinct_keep", with_(ANN_SQL) + f"SELECT code,date,arg_max(id,id) AS last_id,arg_min(id,id) AS first_id,{r6('arg_max(value,id)', 4)} AS value FROM ann GROUP BY 1,2")
def set_distinct_keep(t):
    a = t.announcements.select("code", "date", "id", "value")
    g = a.groupBy("code", "date").agg(F.max("id").alias("last_id"), F.min("id").alias("first_id"), F.max_by("value", "id").alias("value"))
    return g.select("code", "date", "last_id", "first_id", r("value", 4).alias("value"))


@query("set_compare", with_(ANN_SQL, SUPPLIERS_SQL) + "SELECT code,CASE WHEN a AND b THEN 'shared' WHEN a THEN 'only_a' ELSE 'only_b' END AS side FROM (SELECT DISTINCT code,true AS a FROM ann) FULL JOIN (SELECT DISTINCT code,true AS b FROM suppliers) USING (code)")
def set_compare(t):
    return B.compare_sets(t.announcements, t.suppliers)


TOPD = "top AS (SELECT date,code FROM (SELECT date,code,row_number() OVER (PARTITION BY date ORDER BY volume DESC,code) AS k FROM bars) WHERE k<=20),dd AS (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 2)"


def two_days(t):
    """Top-20 sets of the last two dates; only their rows are ranked."""
    dates = t.lineitem.select(F.trunc(F.to_date("l_shipdate"), "month").alias("date")).distinct().orderBy(F.desc("date")).limit(2)
    ends = dates.agg(F.max("date").alias("d1"), F.min("date").alias("d0"))
    near = with_global(t.bars_m, ends).where("date = d1 or date = d0")
    top = top_k(near, ["date"], [F.desc("volume"), F.asc("code")], 20)
    return top.where("date = d1").select("code"), top.where("date = d0").select("code")


@query("set_signal_diff", on_bars("""SELECT code,CASE WHEN a AND b THEN 'HOLD' WHEN a THEN 'BUY' ELSE 'SELL' END AS action FROM (SELECT code,true AS a FROM top WHERE date=(SELECT max(date) FROM dd)) FULL JOIN (SELECT code,true AS b FROM top WHERE date=(SELECT min(date) FROM dd)) USING (code)""", TOPD))
def set_signal_diff(t):
    return B.signal_diff(*two_days(t))


@query("set_previous_day", on_bars("SELECT code FROM top WHERE date=(SELECT min(date) FROM dd)", TOPD))
def set_previous_day(t):
    """Yesterday's set rebuilt from today's set and the signals."""
    now, before = two_days(t)
    sig = B.signal_diff(now, before)
    return B.previous_set(now, sig.where("action = 'BUY'"), sig.where("action = 'SELL'"))


@query("set_universe_union", with_(ANN_SQL, SUPPLIERS_SQL) + "SELECT code FROM suppliers UNION SELECT code FROM ann WHERE priority='1-URGENT' UNION SELECT code FROM ann WHERE status='P'")
def set_universe_union(t):
    a = t.announcements
    return t.suppliers.select("code").union(a.where("priority = '1-URGENT'").select("code")).union(a.where("status = 'P'").select("code")).distinct()


# --- scalars ---------------------------------------------------------------
@query("scalar_dates", "SELECT o_orderkey,CAST(date_trunc('month',o_orderdate) AS DATE) AS m,last_day(o_orderdate) AS month_end,CAST(o_orderdate - INTERVAL 90 DAY AS DATE) AS d90,CAST((SELECT count(*) FROM generate_series(CAST(date_trunc('month',o_orderdate) AS TIMESTAMP),CAST(last_day(o_orderdate) AS TIMESTAMP),INTERVAL 1 DAY) g(x) WHERE dayofweek(x) BETWEEN 1 AND 5) AS INTEGER) AS weekdays FROM orders")
def scalar_dates(t):
    d = F.to_date("o_orderdate")
    return t.table("orders").select(
        "o_orderkey", S.month_key(d).alias("m"), F.last_day(d).alias("month_end"), F.date_sub(d, 90).alias("d90"),
        F.size(S.business_days(F.trunc(d, "month"), F.last_day(d))).alias("weekdays"))


@query("scalar_bar_start", f"SELECT event_id,ts - INTERVAL 5 MINUTE AS bar_start,{r6('value/100-1')} AS ret FROM events")
def scalar_bar_start(t):
    return t.table("events").select("event_id", S.bar_start(F.col("ts")).alias("bar_start"), r(F.col("value") / 100.0 - 1.0).alias("ret"))


@query("scalar_split_first", "SELECT p_partkey,split_part(replace(p_type,' ','|'),'|',1) AS head FROM part")
def scalar_split_first(t):
    return t.table("part").select("p_partkey", S.first_of_list(F.replace("p_type", F.lit(" "), F.lit("|"))).alias("head"))


@query("scalar_valuation_tag", on_bars("SELECT code,date,CASE WHEN pe>35 THEN '高估' WHEN pe>25 THEN '略高' WHEN pe>15 THEN '合理' WHEN pe>0 THEN '低估' ELSE '?' END AS tag FROM (SELECT code,date,close/nullif(volume,0)/5-2 AS pe FROM bars)"))
def scalar_valuation_tag(t):
    return t.bars_m.select("code", "date", S.valuation_tag(F.try_divide("close", "volume") / 5.0 - 2.0).alias("tag"))


# --- aggregations ----------------------------------------------------------
@query("agg_month_anchors", with_(BARS_D_SQL, "a AS (SELECT date_trunc('month',date) AS m,min(date) AS first_day,max(date) AS last_day FROM bars GROUP BY 1)") + "SELECT code,b.date,close,b.date=first_day AS is_first FROM bars b JOIN a ON b.date IN (first_day,last_day)")
def agg_month_anchors(t):
    """Rows on the first or last trading day of their month."""
    b = t.bars_d
    a = b.groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    anchors = a.select(F.explode(F.array_distinct(F.array("first_day", "last_day"))).alias("date"), "first_day")
    return b.join(F.broadcast(anchors), "date").select("code", "date", "close", (F.col("date") == F.col("first_day")).alias("is_first"))


@query("agg_last_row_per_month", with_(BARS_D_SQL) + "SELECT code,CAST(date_trunc('month',date) AS DATE) AS month,max(date) AS date,arg_max(close,date) AS close FROM bars GROUP BY 1,2")
def agg_last_row_per_month(t):
    return t.bars_d.groupBy("code", F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


@query("agg_pivot", with_(BARS_M_SQL, SUPPLIERS_SQL) + "SELECT date," + ",".join(f"{r6(f'avg(CASE WHEN n_regionkey={k} THEN close END)')} AS \"r{k}\"" for k in range(5)) + " FROM bars JOIN suppliers USING (code) JOIN nation ON n_name=industry GROUP BY 1")
def agg_pivot(t):
    """Long to wide over a fixed list of columns (the values are given, so no extra job)."""
    reg = t.table("nation").select(F.col("n_name").alias("industry"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("region"))
    b = t.bars_m.join(t.suppliers.select("code", "industry"), "code").join(reg, "industry")
    wide = b.groupBy("date").pivot("region", [f"r{k}" for k in range(5)]).agg(F.avg("close"))
    return wide.select("date", *[r(f"r{k}").alias(f"r{k}") for k in range(5)])


@query("agg_table_health", with_(BARS_D_SQL) + f"SELECT count(*) AS n_rows,count(DISTINCT code) AS n_codes,min(date) AS first_date,max(date) AS last_date,CAST(date_diff('day',max(date),DATE '2024-02-01') AS INTEGER) AS days_stale,{r6('count(DISTINCT code)*100.0/200', 4)} AS coverage_pct,CASE WHEN date_diff('day',max(date),DATE '2024-02-01')>5 THEN 'stale' WHEN count(DISTINCT code)<160 THEN 'partial' ELSE 'ok' END AS status FROM bars")
def agg_table_health(t):
    g = t.bars_d.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("code").alias("n_codes"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    g = g.withColumns({"days_stale": F.datediff(F.lit("2024-02-01").cast("date"), "last_date"), "coverage_pct": r(F.col("n_codes") * 100.0 / 200.0, 4)})
    return g.withColumn("status", F.when(F.col("days_stale") > 5, "stale").when(F.col("n_codes") < 160, "partial").otherwise("ok"))


@query("agg_list_coverage", with_(BARS_D_SQL) + f"SELECT list,count(*) AS total,count(b.code) AS covered,{r6('count(b.code)*100.0/count(*)', 4)} AS pct FROM (SELECT DISTINCT c_mktsegment AS list,lpad(CAST(c_custkey AS VARCHAR),6,'0') AS code FROM customer) u LEFT JOIN (SELECT DISTINCT code FROM bars) b USING (code) GROUP BY 1")
def agg_list_coverage(t):
    u = t.table("customer").select(F.col("c_mktsegment").alias("list"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code")).distinct()
    have = t.bars_d.select("code").distinct().withColumn("hit", F.lit(1))
    g = u.join(have, "code", "left").groupBy("list").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("covered"))
    return g.withColumn("pct", r(F.col("covered") * 100.0 / F.col("total"), 4))


@query("agg_daily_coverage", with_(BARS_D_SQL) + f"SELECT {r6('median(n)')} AS median,min(n) AS min,max(n) AS max FROM (SELECT date,count(DISTINCT code) AS n FROM bars GROUP BY 1)")
def agg_daily_coverage(t):
    g = t.bars_d.groupBy("date").agg(F.countDistinct("code").alias("n"))
    return g.agg(r(F.median("n")).alias("median"), F.min("n").alias("min"), F.max("n").alias("max"))


@query("agg_yearly_coverage", with_(BARS_M_SQL, SUPPLIERS_SQL) + f"SELECT CAST(year(date) AS INTEGER) AS y,industry,count(DISTINCT code) AS n_codes,{r6('stddev_samp(close/open-1)')} AS dispersion FROM bars JOIN suppliers USING (code) GROUP BY 1,2")
def agg_yearly_coverage(t):
    b = t.bars_m.join(t.suppliers.select("code", "industry"), "code")
    return b.groupBy(F.year("date").alias("y"), "industry").agg(F.countDistinct("code").alias("n_codes"), r(F.stddev_samp(F.col("close") / F.col("open") - 1.0)).alias("dispersion"))


@query("agg_sector_weights", with_(BARS_M_SQL, SUPPLIERS_SQL, "g AS (SELECT industry,sum(amount) AS v FROM bars JOIN suppliers USING (code) GROUP BY 1)") + f"SELECT industry,{r6('v', 3)} AS value,{r6('v/(SELECT sum(v) FROM g)')} AS weight,{r6('(SELECT sum(v*v) FROM g)/((SELECT sum(v) FROM g)*(SELECT sum(v) FROM g))')} AS hhi FROM g")
def agg_sector_weights(t):
    h = B.shares_and_hhi(t.bars_m.join(t.suppliers.select("code", "industry"), "code"), "industry", "amount")
    return h.select("industry", r("value", 3).alias("value"), r("weight").alias("weight"), r("hhi").alias("hhi"))


@query("agg_concentration", with_(SUPPLIERS_SQL) + f"SELECT {r6('100.0/sum(n)')} AS max_single_pct,{r6('max(n)*100.0/sum(n)')} AS max_industry_pct,arg_max(industry,(n,industry)) AS max_industry,max(n)*100.0/sum(n)>30 OR 100.0/sum(n)>30 AS alert FROM (SELECT industry,count(*) AS n FROM suppliers GROUP BY 1)")
def agg_concentration(t):
    g = t.suppliers.groupBy("industry").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    x = g.agg((100.0 / total).alias("a"), (F.max("n") * 100.0 / total).alias("b"), F.max_by("industry", F.struct("n", "industry")).alias("max_industry"))
    return x.select(r("a").alias("max_single_pct"), r("b").alias("max_industry_pct"), "max_industry", ((F.col("a") > 30) | (F.col("b") > 30)).alias("alert"))


@query("agg_histogram", on_bars(f"SELECT CAST(b AS INTEGER) AS bin,count(*) AS n,{r6('min(lo+b*w)')} AS lo FROM (SELECT least(floor((close-lo)/w),39) AS b,lo,w FROM bars,(SELECT min(close) AS lo,(max(close)-min(close))/40 AS w FROM bars)) GROUP BY 1"))
def agg_histogram(t):
    h = B.histogram(t.bars_m, "close", 40)
    return h.select("bin", "n", r("lo").alias("lo"))


@query("agg_topk_cutoff", on_bars(f"SELECT date,{r6('min(amount)', 3)} AS cutoff,count(*) AS n FROM (SELECT *,row_number() OVER (PARTITION BY date ORDER BY amount DESC,code) AS k FROM bars) WHERE k<=8 GROUP BY 1"))
def agg_topk_cutoff(t):
    """Score of the last row that makes the top K."""
    top = top_k(t.bars_m, ["date"], [F.desc("amount"), F.asc("code")], 8)
    return top.groupBy("date").agg(r(F.min("amount"), 3).alias("cutoff"), F.count(F.lit(1)).alias("n"))


@query("agg_trade_summary", with_(TRADES_SQL) + "SELECT sym,count(*) FILTER (WHERE action='BUY') AS n_buy,count(*) FILTER (WHERE action='SELL') AS n_sell,arg_max(action,seq) AS last_action,max(date) AS last_date,arg_min(action,seq) AS first_action FROM trades GROUP BY 1")
def agg_trade_summary(t):
    return t.trades.groupBy("sym").agg(
        F.count_if(F.col("action") == "BUY").alias("n_buy"), F.count_if(F.col("action") == "SELL").alias("n_sell"),
        F.max_by("action", F.struct("date", "seq")).alias("last_action"), F.max("date").alias("last_date"), F.min_by("action", F.struct("date", "seq")).alias("first_action"))


@query("agg_two_table_counts", "SELECT 'orders' AS tbl,count(*) AS n FROM orders UNION ALL SELECT 'lineitem',count(*) FROM lineitem")
def agg_two_table_counts(t):
    one = lambda n: t.table(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n")
    return one("orders").unionByName(one("lineitem"))


@query("agg_intraday_drawdown", f"SELECT lpad(CAST(user_id AS VARCHAR),6,'0') AS code,CAST(ts AS DATE) AS date,max(CASE WHEN hour(ts)<12 THEN value END) AS am_high,arg_max(CASE WHEN hour(ts)>=12 THEN value END,CASE WHEN hour(ts)>=12 THEN (ts,event_id) END) AS pm_close,{r6('arg_max(CASE WHEN hour(ts)>=12 THEN value END,CASE WHEN hour(ts)>=12 THEN (ts,event_id) END)/max(CASE WHEN hour(ts)<12 THEN value END)-1')} AS drop FROM events GROUP BY 1,2 HAVING max(CASE WHEN hour(ts)<12 THEN value END)>0 AND count(CASE WHEN hour(ts)>=12 THEN 1 END)>0")
def agg_intraday_drawdown(t):
    """Morning high against afternoon close, one aggregation."""
    am, pm = F.hour("ts") < 12, F.hour("ts") >= 12
    g = t.table("events").groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.max(F.when(am, F.col("value"))).alias("am_high"),
        F.max_by(F.when(pm, F.col("value")), F.when(pm, F.struct("ts", "event_id"))).alias("pm_close"))
    g = g.where("am_high > 0 and pm_close is not null")
    return g.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), "date", "am_high", "pm_close", r(F.col("pm_close") / F.col("am_high") - 1.0).alias("drop"))


@query("agg_candidate_share", on_bars(f"SELECT count(*) AS n,{r6('avg(CASE WHEN o>i THEN 1.0 ELSE 0 END)')} AS share FROM (SELECT code,avg(CASE WHEN date<'1998-06-01' THEN ret END) AS i,avg(CASE WHEN date>='1998-06-01' THEN ret END) AS o FROM (SELECT *,close/{LAG}-1 AS ret FROM bars) GROUP BY 1) WHERE i IS NOT NULL AND o IS NOT NULL"))
def agg_candidate_share(t):
    """Share of candidates whose later metric beats the earlier one."""
    early = F.col("date") < "1998-06-01"
    g = t.bars_m.withColumn("ret", change("close")).groupBy("code").agg(F.avg(F.when(early, F.col("ret"))).alias("i"), F.avg(F.when(~early, F.col("ret"))).alias("o"))
    g = g.where("i is not null and o is not null")
    return g.agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.when(F.col("o") > F.col("i"), 1.0).otherwise(0.0))).alias("share"))


