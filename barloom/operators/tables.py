"""Table hygiene: normalising, validating, filtering and comparing key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ranking import with_global


def normalise(df: DataFrame, rename: dict[str, str], numeric: Sequence[str] = (), dates: Sequence[str] = (), schema: dict[str, str] | None = None) -> DataFrame:
    """Rename, coerce (bad values become null), add missing columns as null, drop rows without a date."""
    out = df.withColumnsRenamed(rename)
    out = out.withColumns({c: F.col(c).try_cast("double") for c in numeric if c in out.columns})
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numeric if c in out.columns})
    out = out.withColumns({c: F.col(c).try_cast("date") for c in dates if c in out.columns})
    for name, typ in (schema or {}).items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(typ))
    return out.dropna(subset=[c for c in dates if c in out.columns])


def split_valid(df: DataFrame, rules: dict[str, Column], out: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Rows passing every rule, and the rejected ones with their reasons.

    A rule is a condition for a *bad* row; null counts as not bad.
    """
    marked = with_errors(df, rules, out)
    return marked.where(F.size(out) == 0).drop(out), marked.where(F.size(out) > 0)


def with_errors(df: DataFrame, rules: dict[str, Column], out: str = "errors") -> DataFrame:
    return df.withColumn(out, F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])))


def trade_rules() -> dict[str, Column]:
    """Contract of a trade row."""
    required = {f"missing_{c}": F.col(c).isNull() for c in ("date", "sym", "action", "price", "shares")}
    return required | {
        "bad_action": ~F.col("action").isin("BUY", "SELL"),
        "bad_price": F.col("price") <= 0,
        "bad_shares": F.col("shares") <= 0,
        "bad_date": F.col("date").isNotNull() & (~F.col("date").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("date").cast("string").try_cast("date").isNull()),
        "bad_symbol": ~F.col("sym").rlike(r"^(SH|SZ|BJ)?\d{6}$"),
    }


def check_bars(df: DataFrame, columns: Sequence[str] = ("open", "high", "low", "close", "volume"), keys: Sequence[str] = ("code", "date")) -> DataFrame:
    """Contract report: one row with missing columns and the number of duplicate keys."""
    missing = [c for c in [*keys, *columns] if c not in df.columns]
    present = [k for k in keys if k in df.columns]
    dup = df.groupBy(*present).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).alias("duplicate_keys"))
    return dup.withColumn("missing_columns", F.array(*[F.lit(c) for c in missing]).cast("array<string>")).withColumn(
        "ok", (F.col("duplicate_keys") == 0) & F.lit(not missing))


def long_enough(df: DataFrame, n: int, key: str = "code") -> DataFrame:
    """Rows of keys with at least n rows; counts are combined before the shuffle."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(key)
    return df.join(sizes, key, "left_semi")


def universe(dim: DataFrame, *, drop_special: bool = True, drop_beijing: bool = True, drop_chinext: bool = False) -> DataFrame:
    """Listing table without special-treatment names and excluded boards."""
    out = dim
    if drop_special:
        out = out.where(~F.coalesce(F.col("name").rlike("ST|退"), F.lit(False)))
    if drop_beijing:
        out = out.where(~F.col("code").rlike("^[84]"))
    if drop_chinext:
        out = out.where(~F.col("code").startswith("30"))
    return out


def on_latest_date(df: DataFrame, on: str = "date") -> DataFrame:
    latest = df.agg(F.max(on).alias("_latest"))
    return with_global(df, latest).where(F.col(on) == F.col("_latest")).drop("_latest")


def full_coverage_date(df: DataFrame, *, min_codes: int | None = None, share: float = 0.8, last: int = 10) -> DataFrame:
    """One row: newest date whose number of codes reaches a count, or a share of the best of the last dates."""
    cover = df.groupBy("date").agg(F.countDistinct("code").alias("n"))
    if min_codes is not None:
        return cover.where(F.col("n") >= min_codes).agg(F.max("date").alias("date"))
    recent = cover.orderBy(F.desc("date")).limit(last)
    best = recent.agg(F.floor(F.max("n") * share).alias("_need"))
    return with_global(recent, best).where(F.col("n") >= F.col("_need")).agg(F.max("date").alias("date"))


def staleness(latest: Column, as_of: Column, max_days: int) -> Column:
    age = F.datediff(as_of, latest)
    return F.when(latest.isNull(), "missing").when(age > max_days, F.concat(F.lit("stale-"), age.cast("string"))).otherwise("ok")


def quality_screen(df: DataFrame, *, min_cap: float, min_turnover: float, max_move: float = 5.2) -> DataFrame:
    """Size, turnover, no B-share codes, and a largest recent move that only unrestricted names reach."""
    return df.where(
        (F.col("mkt_cap") >= min_cap) & (F.col("turnover") >= min_turnover)
        & ~F.col("code").rlike("900|200") & (F.col("max_abs_chg") > max_move))


def corrupt_symbols(bars: DataFrame, floor: float = 0.5, year: int = 2018) -> DataFrame:
    bad = (F.col("close") < 0) | ((F.year("date") == year) & (F.col("close") < floor))
    return bars.where(bad).select("code").distinct()


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest in ``order`` (pre-aggregated before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def compare_sets(a: DataFrame, b: DataFrame, key: str = "code", names: tuple[str, str] = ("only_a", "only_b")) -> DataFrame:
    """Every key with the side(s) it is on."""
    l = a.select(key).distinct().withColumn("_a", F.lit(True))
    r = b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "shared").when(F.col("_a"), names[0]).otherwise(names[1])
    return l.join(r, key, "full_outer").select(key, side.alias("side"))


def previous_set(today: DataFrame, buys: DataFrame, sells: DataFrame, key: str = "code") -> DataFrame:
    """Yesterday's holdings: (today without buys) with sells."""
    return today.select(key).join(buys.select(key), key, "left_anti").union(sells.select(key)).distinct()


def signal_diff(picks: DataFrame, held: DataFrame, key: str = "code") -> DataFrame:
    """BUY new picks, SELL dropped holdings, HOLD the rest."""
    c = compare_sets(picks, held, key, ("BUY", "SELL"))
    return c.select(key, F.when(F.col("side") == "shared", "HOLD").otherwise(F.col("side")).alias("action"))


def shares_and_hhi(holdings: DataFrame, group: str, value: str) -> DataFrame:
    """Weight per group and the concentration index of all groups.

    The group table is small by nature (sectors), so its total is a window over it.
    """
    g = holdings.groupBy(group).agg(F.sum(value).alias("value"))
    w = Window.partitionBy()
    g = g.withColumn("weight", F.try_divide("value", F.sum("value").over(w)))
    return g.withColumn("hhi", F.sum(F.col("weight") * F.col("weight")).over(w))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between the extremes: bin, lo, n."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = with_global(df.where(F.col(value).isNotNull()), span)
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    b = F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(bins - 1)).cast("int")
    return x.groupBy(F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("_lo") + F.coalesce(b, F.lit(0)) * width).alias("lo"))
