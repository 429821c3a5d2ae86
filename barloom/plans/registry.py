"""Registry of named queries: a DataFrame builder and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import sequence_key, to_bars

#: Suppliers in a pool.
POOL = 4
Builder = Callable[["Tables"], DataFrame]
_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


class Tables:
    """Lazy handles on the tables of one scale-factor folder and their panels."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def trades(self) -> DataFrame:
        """Trade log: returned lines sell, all others buy; ``seq`` orders a symbol's trades of one day."""
        d = F.to_date("l_shipdate")
        return self.lineitem.select(
            F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("sym"),
            d.alias("date"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("action"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").cast("bigint").alias("shares"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
        )

    @cached_property
    def bars_m(self) -> DataFrame:
        """Monthly bars per supplier."""
        return self.bars_from(self.lineitem)

    @cached_property
    def bars_s(self) -> DataFrame:
        """Daily bars per pool of four neighbouring suppliers: long enough for the longest windows, and more pools with more suppliers."""
        return self.bars_from(self.lineitem, "day", F.floor(F.col("l_suppkey") / POOL))

    def bars_from(self, lineitem: DataFrame, unit: str = "month", code: Column | None = None) -> DataFrame:
        d = F.to_date("l_shipdate")
        return to_bars(
            lineitem,
            code=F.col("l_suppkey") if code is None else code,
            period=F.trunc(d, unit) if unit != "day" else d,
            price=F.col("l_extendedprice") / F.col("l_quantity"),
            seq=trade_seq(d),
            volume=F.col("l_quantity"),
            amount=F.col("l_extendedprice"),
        )

    @cached_property
    def bars_d(self) -> DataFrame:
        """Daily bars per user from the event stream (volume = number of events)."""
        e = self.table("events")
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        seq = sequence_key([(micros, 18)], [(F.col("event_id"), 18)])
        return to_bars(
            e, code=F.col("user_id"), period=F.to_date("ts"), price=F.col("value"), seq=seq,
        )

    @cached_property
    def announcements(self) -> DataFrame:
        """Sparse events: orders of a customer on their order date."""
        return self.table("orders").select(
            F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("code"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_totalprice").alias("value"),
            F.col("o_orderkey").alias("id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        """Dimension: supplier code with nation (industry) and name."""
        s, n = self.table("supplier"), self.table("nation")
        return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
            F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("industry"),
            F.col("s_acctbal").alias("acctbal"),
        )


def trade_seq(day):
    """Order of trades: day, order, line, part."""
    return sequence_key(
        [(F.unix_date(day), 5), (F.col("l_orderkey"), 13)], [(F.col("l_linenumber"), 3), (F.col("l_partkey"), 15)])


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(fn: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"duplicate query {name}")
        _BUILDERS[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def builders() -> dict[str, Builder]:
    return dict(_BUILDERS)


def sql_texts() -> dict[str, str]:
    return dict(_SQL)


# --- SQL fragments shared by the counterparts ------------------------------
TRADES_SQL = """
trades AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR),6,'0') AS sym, CAST(l_shipdate AS DATE) AS date,
         CASE WHEN l_returnflag='R' THEN 'SELL' ELSE 'BUY' END AS action,
         l_extendedprice/l_quantity AS price, CAST(l_quantity AS BIGINT) AS shares, l_orderkey, l_linenumber, l_partkey,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate,l_orderkey,l_linenumber,l_partkey) AS seq
  FROM lineitem)"""
BARS_M_SQL = """
bars AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR),6,'0') AS code, CAST(date_trunc('month',l_shipdate) AS DATE) AS date,
         arg_min(l_extendedprice/l_quantity, (l_shipdate,l_orderkey,l_linenumber,l_partkey)) AS open,
         max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
         arg_max(l_extendedprice/l_quantity, (l_shipdate,l_orderkey,l_linenumber,l_partkey)) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem GROUP BY 1,2)"""
BARS_S_SQL = BARS_M_SQL.replace("date_trunc('month',l_shipdate)", "l_shipdate").replace("CAST(l_suppkey AS", f"CAST(l_suppkey//{POOL} AS")
BARS_D_SQL = """
bars AS (
  SELECT lpad(CAST(user_id AS VARCHAR),6,'0') AS code, CAST(ts AS DATE) AS date,
         arg_min(value,(ts,event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value,(ts,event_id)) AS close, CAST(count(*) AS BIGINT) AS volume
  FROM events GROUP BY 1,2)"""
ANN_SQL = """
ann AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR),6,'0') AS code, CAST(o_orderdate AS DATE) AS date,
         o_totalprice AS value, o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority
  FROM orders)"""
SUPPLIERS_SQL = """
suppliers AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR),6,'0') AS code, s_name AS name, n_name AS industry, s_acctbal AS acctbal
  FROM supplier JOIN nation ON s_nationkey=n_nationkey)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(c.strip() for c in ctes) + "\n"


def on_bars(select: str, *ctes: str) -> str:
    """SELECT over monthly bars with the usual named windows available."""
    return with_(BARS_M_SQL, *ctes) + select


def daily(sql: str) -> str:
    """The same query over daily bars of supplier pools."""
    return sql.replace(BARS_M_SQL.strip(), BARS_S_SQL.strip())


W = "PARTITION BY code ORDER BY date"


def wn(n: int) -> str:
    """SQL frame: the trailing n rows."""
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def wp(n: int) -> str:
    """SQL frame: the n rows before the current one."""
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def full_sql(agg: str, c: str, n: int, frame: str | None = None) -> str:
    f = frame or wn(n)
    return f"(CASE WHEN count({c}) OVER {f} >= {n} THEN {agg}({c}) OVER {f} END)"


# Both sides report rounded doubles; the small offset keeps exact decimal ties
# (prices are quotients by powers of two) from being cut differently.
TIE = 1e-9


def r(c, digits: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(TIE), digits)


def r6(e: str, d: int = 6) -> str:
    return f"(round(({e})+CAST(1e-9 AS DOUBLE),{d})+0.0)"


def ewm_sql(name: str, src: str, outs: dict[str, tuple[str, float]]) -> str:
    """Recursive CTE: adjust=False smoothing of ``src`` (code, rn, columns)."""
    first = ", ".join(f"{x} AS {o}, CAST(1 AS DOUBLE) AS w_{o}" for o, (x, _) in outs.items())
    step = ", ".join(
        f"CASE WHEN p.{o} IS NULL THEN s.{x} WHEN s.{x} IS NULL THEN p.{o} "
        f"ELSE (p.w_{o}*(1-{a!r})*p.{o}+{a!r}*s.{x})/(p.w_{o}*(1-{a!r})+{a!r}) END, "
        f"CASE WHEN p.{o} IS NULL OR s.{x} IS NOT NULL THEN 1 ELSE p.w_{o}*(1-{a!r}) END"
        for o, (x, a) in outs.items()
    )
    return (
        f"{name} AS (SELECT code, rn, {first} FROM {src} WHERE rn=1 UNION ALL "
        f"SELECT s.code, s.rn, {step} FROM {name} p JOIN {src} s ON s.code=p.code AND s.rn=p.rn+1)"
    )


NUMBERED_SQL = f"nb AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS rn FROM bars)"
MACD_SQL = ",".join([
    ewm_sql("mf", "nb", {"ef": ("close", 2 / 13), "es": ("close", 2 / 27)}),
    "md AS MATERIALIZED (SELECT code, rn, ef-es AS dif FROM mf)",
    ewm_sql("me", "md", {"dea": ("dif", 2 / 10)}),
    "macd AS MATERIALIZED (SELECT md.code, md.rn, dif, dea, (dif-dea)*2 AS hist FROM md JOIN me USING (code,rn))",
])


def kdj_sql(alpha: float = 1 / 3) -> str:
    return ",".join([
        f"rv AS MATERIALIZED (SELECT code, rn, (close-{full_sql('min', 'low', 9)})/nullif({full_sql('max', 'high', 9)}-{full_sql('min', 'low', 9)},0)*100 AS rsv FROM nb)",
        ewm_sql("kk", "rv", {"k": ("rsv", alpha)}),
        ewm_sql("kd", "kk", {"d": ("k", alpha)}),
        "kdj AS MATERIALIZED (SELECT kk.code, kk.rn, k, d, 3*k-2*d AS j FROM kk JOIN kd USING (code,rn))",
    ])


def rsi_sql(name: str = "rs", src: str = "bars", n: int = 14) -> str:
    return (
        f"{name}_d AS (SELECT *, close-lag(close) OVER ({W}) AS dx FROM {src}),"
        f"{name}_u AS (SELECT *, {full_sql('avg', 'up', n)} AS au, {full_sql('avg', 'dn', n)} AS ad FROM "
        f"(SELECT *, CASE WHEN dx IS NOT NULL THEN greatest(dx,0) END AS up, CASE WHEN dx IS NOT NULL THEN -least(dx,0) END AS dn FROM {name}_d)),"
        f"{name} AS MATERIALIZED (SELECT *, CASE WHEN ad IS NULL THEN NULL WHEN ad=0 AND au=0 THEN 50 WHEN ad=0 THEN 100 ELSE 100-100/(1+au/ad) END AS rsi FROM {name}_u)"
    )
