"""Scans, sinks and table maintenance on tables derived from the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import tables as B
from barloom.operators import upsert as U
from barloom.plans.indicator_plans import pick
from barloom.plans.registry import ANN_SQL, BARS_D_SQL, BARS_M_SQL, SUPPLIERS_SQL, Tables, on_bars, query, r, r6, with_
from barloom.sources import catalog, readers, sinks


@query("scan_projected", f"SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey,{r6('l_extendedprice', 3)} AS price FROM lineitem WHERE l_shipdate>='1998-01-01' AND l_shipdate<'1999-01-01'")
def scan_projected(t):
    """Column projection and date predicate reach the file reader."""
    df = readers.parquet(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
                         (F.col("l_shipdate") >= "1998-01-01") & (F.col("l_shipdate") < "1999-01-01"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("l_extendedprice", 3).alias("price"))


def bars_csv(t: Tables) -> str:
    """Daily bars as a long CSV with prefixed symbols."""
    path = sinks.new_path(t.spark, "bars-csv")
    b = t.bars_d.withColumn("code", S.add_prefix(F.col("code")))
    b.select("code", "date", "open", "high", "low", "close", "volume").write.option("header", True).csv(path)
    return path


@query("scan_market_csv", with_(BARS_D_SQL) + "SELECT code,date,open,high,low,close,volume FROM bars WHERE code IN (SELECT code FROM bars GROUP BY 1 HAVING count(*)>=26)")
def scan_market_csv(t):
    return readers.market_csv(t.spark, bars_csv(t), min_bars=26)


@query("scan_inferred_csv", with_(BARS_D_SQL) + "SELECT code,date,close FROM bars WHERE code IN (SELECT code FROM bars GROUP BY 1 HAVING count(*)>=28)")
def scan_inferred_csv(t):
    return readers.market_csv(t.spark, bars_csv(t), min_bars=28, infer=True).select("code", "date", "close")


def hive_bars(t: Tables) -> str:
    path = sinks.new_path(t.spark, "bars-hive")
    sinks.write_grouped(t.bars_d, path)
    return path


@query("scan_hive_partitions", with_(BARS_D_SQL) + "SELECT code,count(*) AS n,max(close) AS top FROM bars GROUP BY 1")
def scan_hive_partitions(t):
    df = t.spark.read.schema("date date, open double, high double, low double, close double, volume bigint, code string, key_group int").parquet(hive_bars(t))
    return df.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("top"))


@query("scan_single_symbol", with_(BARS_D_SQL) + "SELECT code,date,close FROM bars WHERE code='000007'")
def scan_single_symbol(t):
    df = t.spark.read.schema("date date, open double, high double, low double, close double, volume bigint, code string, key_group int").parquet(hive_bars(t))
    return readers.symbol(df, "000007").select("code", "date", "close")


@query("scan_symbols", with_(BARS_D_SQL) + "SELECT DISTINCT code FROM bars")
def scan_symbols(t):
    return readers.symbols(t.bars_d)


@query("scan_trade_log", "SELECT CAST(event_id AS VARCHAR) AS id,lpad(CAST(user_id AS VARCHAR),6,'0') AS sym,value AS price FROM events WHERE event_type<>'error'")
def scan_trade_log(t):
    """JSON Lines with malformed lines between the good ones."""
    e = t.table("events")
    good = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.to_date("ts").cast("string").alias("date"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("sym"),
        F.lit("BUY").alias("action"), F.col("value").alias("price"), F.lit(100).alias("shares"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("recorded_at")))
    path = sinks.new_path(t.spark, "trade-log")
    e.select(F.when(F.col("event_type") == "error", "{broken").otherwise(good).alias("value")).write.text(path)
    return readers.trade_log(t.spark, path).select("id", "sym", "price")


@query("scan_many_tables", "SELECT o_orderkey AS k,o_totalprice AS v,CAST(NULL AS DOUBLE) AS bal FROM orders UNION ALL SELECT c_custkey,NULL,c_acctbal FROM customer")
def scan_many_tables(t):
    """Tables with different columns as one; a table that is absent is skipped."""
    a, b, absent = (sinks.new_path(t.spark, "part") for _ in range(3))
    t.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")).write.parquet(a)
    t.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")).write.parquet(b)
    return readers.many(t.spark, [a, absent, b], "k bigint, v double, bal double").select("k", "v", "bal")


@query("scan_newest_report", with_(ANN_SQL) + f"SELECT code,CAST(date_trunc('quarter',date) AS DATE) AS data_date,arg_max(date,(date,id)) AS announce_date,{r6('arg_max(value,(date,id))', 4)} AS value FROM ann GROUP BY 1,2")
def scan_newest_report(t):
    rep = t.announcements.select("code", F.trunc("date", "quarter").alias("data_date"), F.col("date").alias("announce_date"), "value", "id", F.struct("date", "id").alias("o"))
    return readers.newest_report(rep, order="o").select("code", "data_date", "announce_date", r("value", 4).alias("value"))


@query("scan_instruments", "SELECT lpad(CAST((c_custkey*7919)%1000000 AS VARCHAR),6,'0') AS code,DATE '2020-01-01' AS start FROM customer WHERE NOT regexp_matches(lpad(CAST((c_custkey*7919)%1000000 AS VARCHAR),6,'0'),'^(688|[48])')")
def scan_instruments(t):
    c = F.lpad(((F.col("c_custkey") * 7919) % 1000000).cast("string"), 6, "0")
    path = sinks.new_path(t.spark, "instruments")
    t.table("customer").select(F.concat_ws("\t", S.add_prefix(c), F.lit("2020-01-01"), F.lit("n/a")).alias("value")).write.text(path)
    return readers.instruments(t.spark, path).select("code", "start")


@query("scan_nested_json", "SELECT o_orderpriority AS id,count(*) AS n,CAST(max(o_totalprice) AS DOUBLE) AS top FROM orders GROUP BY 1")
def scan_nested_json(t):
    """One document with a nested list, exploded into rows."""
    path = sinks.new_path(t.spark, "doc")
    g = t.table("orders").groupBy(F.col("o_orderpriority").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    g.agg(F.collect_list(F.struct("id", "n", "top")).alias("items")).write.json(path)
    return readers.nested_json(t.spark, path, "items array<struct<id:string,n:bigint,top:double>>", "items")


@query("scan_view_catalog", 'SELECT * FROM (SELECT \'v_orders\' AS "view",count(*) AS n_rows,6 AS n_cols FROM orders UNION ALL SELECT \'v_events\',count(*),6 FROM events)')
def scan_view_catalog(t):
    specs = {"v_orders": ("parquet", f"{t.folder}/orders.parquet"), "v_events": ("parquet", f"{t.folder}/events.parquet"), "v_absent": ("parquet", f"{t.folder}/absent.parquet")}
    return catalog.list_views(t.spark, catalog.setup_views(t.spark, specs))


# --- merges ----------------------------------------------------------------
def halves(t: Tables):
    """Stored bars until 1999 and an increment from late 1998 on with shifted closes."""
    b = t.bars_m.select("code", "date", "close")
    return b.where("date < '1999-01-01'"), b.where("date >= '1998-07-01'").withColumn("close", F.col("close") + 1.0)


HALF_SQL = "o AS (SELECT code,date,close FROM bars WHERE date<'1999-01-01'),n AS (SELECT code,date,close+1 AS close FROM bars WHERE date>='1998-07-01')"


@query("merge_upsert", on_bars(f"SELECT code,date,{r6('close')} AS close FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE (code,date) NOT IN (SELECT code,date FROM n))", HALF_SQL))
def merge_upsert(t):
    return pick(U.upsert(*halves(t), ["code", "date"], order=["close"]), "close")


REVISED_SQL = "rv AS (SELECT code,date,close+rev AS close,rev FROM bars CROSS JOIN (SELECT UNNEST([1,2,3]) AS rev) WHERE date>='1998-07-01')"


@query("merge_upsert_revisions", on_bars(f"SELECT code,date,{r6('close')} AS close,rev FROM (SELECT code,date,max(close) AS close,3 AS rev FROM rv WHERE rev=3 GROUP BY 1,2 UNION ALL SELECT code,date,close,0 FROM o WHERE (code,date) NOT IN (SELECT code,date FROM rv))", HALF_SQL, REVISED_SQL))
def merge_upsert_revisions(t):
    """Several new rows of a key: the latest revision is kept."""
    old, _ = halves(t)
    new = t.bars_m.where("date >= '1998-07-01'").select("code", "date", "close", F.explode(F.array(F.lit(1), F.lit(3), F.lit(2))).alias("rev"))
    new = new.withColumn("close", F.col("close") + F.col("rev"))
    return U.upsert(old.withColumn("rev", F.lit(0)), new, ["code", "date"], order=["rev"]).select("code", "date", r("close").alias("close"), "rev")


@query("merge_append_new", on_bars(f"SELECT code,date,{r6('close')} AS close FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE (code,date) NOT IN (SELECT code,date FROM o))", HALF_SQL))
def merge_append_new(t):
    old, new = halves(t)
    return pick(old.unionByName(U.append_new(old, new, ["code", "date"], order=["close"])), "close")


@query("merge_protected", on_bars(f"SELECT code,date,{r6('close')} AS close FROM (SELECT * FROM m UNION ALL SELECT * FROM o WHERE (code,date) NOT IN (SELECT code,date FROM m))", HALF_SQL, "m AS (SELECT * FROM n WHERE code NOT LIKE '00000%' AND close<50000)"))
def merge_protected(t):
    """Protected symbols keep their rows; incomplete new rows are ignored."""
    old, new = halves(t)
    new = new.withColumn("close", F.when(F.col("close") < 50000, F.col("close")))
    prot = t.bars_m.where(F.col("code").startswith("00000")).select("code").distinct()
    return pick(U.upsert_protected(old, new, ["code", "date"], prot, order=["close"]), "close")


@query("merge_keep_largest", on_bars(f"SELECT code,date,{r6('max(close)')} AS close FROM (SELECT * FROM o UNION ALL SELECT code,date,close-2 FROM n) GROUP BY 1,2", HALF_SQL))
def merge_keep_largest(t):
    old, new = halves(t)
    return pick(U.keep_largest([old, new.withColumn("close", F.col("close") - 2.0)], ["code", "date"]), "close")


@query("merge_stitch", on_bars(f"""SELECT code,date,{r6('close')} AS close FROM (SELECT code,date,close*2 AS close FROM bars WHERE date<'1998-01-01' AND month(date)<=6 UNION ALL SELECT code,date,close FROM bars WHERE date<'1998-01-01' AND month(date)>6 UNION ALL SELECT code,date,close FROM bars WHERE date>='1998-01-01')"""))
def merge_stitch(t):
    main = t.bars_m.select("code", "date", "close")
    back = main.where(F.month("date") <= 6).withColumn("close", F.col("close") * 2.0)
    return pick(U.stitch(main, back, F.lit("1998-01-01").cast("date")), "close")


@query("merge_needs_refresh", with_(BARS_M_SQL, SUPPLIERS_SQL) + "SELECT u.code,max(date) AS last_date FROM (SELECT code FROM suppliers UNION SELECT 'X'||code FROM suppliers WHERE acctbal<0) u LEFT JOIN bars b ON b.code=u.code GROUP BY 1 HAVING max(date) IS NULL OR date_diff('day',max(date),DATE '2001-11-05')>30")
def merge_needs_refresh(t):
    u = t.suppliers.select("code").union(t.suppliers.where("acctbal < 0").select(F.concat(F.lit("X"), "code")))
    return U.needs_refresh(u, t.bars_m, F.lit("2001-11-05").cast("date"), 30)


# --- sinks -----------------------------------------------------------------
@query("sink_replace_slices", on_bars(f"SELECT code,year(date) AS year,date,{r6('CASE WHEN year(date)=1998 THEN close+5 ELSE close END')} AS close FROM bars"))
def sink_replace_slices(t):
    """A year's slice written twice over an existing table leaves the other years alone."""
    path = sinks.new_path(t.spark, "slices")
    b = t.bars_m.select("code", "date", "close", F.year("date").alias("year"))
    sinks.replace_slices(b, path, "year")
    again = t.bars_m.where("year(date) = 1998").select("code", "date", (F.col("close") + 5.0).alias("close"), F.year("date").alias("year"))
    for _ in range(2):
        sinks.replace_slices(again, path, "year")
    return t.spark.read.parquet(path).select("code", F.col("year").cast("bigint").alias("year"), "date", r("close").alias("close"))


@query("sink_partitioned", with_(BARS_D_SQL) + "SELECT code,date,close FROM bars")
def sink_partitioned(t):
    path = sinks.new_path(t.spark, "by-day")
    sinks.write_partitioned(t.bars_d, path, ["date"], rows=100, sort=["code"])
    return t.spark.read.parquet(path).select("code", "date", "close")


@query("sink_by_year", on_bars(f"SELECT code,date,{r6('close')} AS close FROM bars WHERE date=(SELECT max(date) FROM bars)"))
def sink_by_year(t):
    """Latest-day query on the year-aligned layout."""
    path = sinks.new_path(t.spark, "by-year")
    sinks.write_by_year(t.bars_m, path)
    return pick(B.on_latest_date(t.spark.read.parquet(path)), "close")


@query("sink_verify_rewrite", with_(BARS_D_SQL) + "SELECT count(*) AS n_source,count(*) AS n_copy,CAST(0 AS BIGINT) AS n_missing,CAST(0 AS BIGINT) AS n_extra,true AS ok FROM bars")
def sink_verify_rewrite(t):
    copy = sinks.publish(t.bars_d, "copy")
    return sinks.verify_rewrite(t.bars_d, copy, ["code", "date"])


@query("sink_append_audit", with_(BARS_D_SQL) + "SELECT code,max(close)>100 AS tripped,count(*)*2 AS n FROM bars GROUP BY 1")
def sink_append_audit(t):
    """The same audit rows appended twice."""
    path = sinks.new_path(t.spark, "audit")
    rows = t.bars_d.groupBy("code").agg((F.max("close") > 100).alias("tripped"), F.count(F.lit(1)).alias("n"))
    for _ in range(2):
        sinks.append_audit(rows, path)
    a = t.spark.read.parquet(path)
    return a.where("logged_at is not null").groupBy("code", "tripped").agg(F.sum("n").alias("n"))


@query("sink_append_trades", "SELECT count(*) AS n,count(*) AS n_ids,count(*) AS n_stamped FROM lineitem WHERE l_quantity<=40")
def sink_append_trades(t):
    """Only valid rows are appended, each with its own id and a recording time."""
    path = sinks.new_path(t.spark, "trades")
    rows = t.trades.drop("seq").withColumn("shares", F.when(F.col("shares") <= 40, F.col("shares")).otherwise(0))
    sinks.append_trades(rows, path)
    back = t.spark.read.schema(readers.TRADE_SCHEMA).json(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.count("recorded_at").alias("n_stamped"))


@query("sink_export_csv", with_(BARS_D_SQL) + "SELECT CASE WHEN left(code,1) IN ('6','9') THEN 'SH' WHEN left(code,1) IN ('8','4') THEN 'BJ' ELSE 'SZ' END||code AS symbol,count(*) AS n,CAST(sum(1.0) AS DOUBLE) AS factors FROM bars GROUP BY code HAVING count(*)>=27")
def sink_export_csv(t):
    path = sinks.new_path(t.spark, "export")
    sinks.export_csv(t.bars_d, path, min_rows=27)
    back = readers.csv_per_key(t.spark, path, "code string, date date, open double, high double, low double, close double, volume bigint, factor double, symbol string")
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("factor").alias("factors"))


