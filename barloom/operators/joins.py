"""Point-in-time, interval and calendar joins.

None of these emits pairs of rows: as-of joins carry the last row forward in
time order, interval joins are range frames over per-day sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    *,
    key: str = "code",
    on: str = "date",
    right_on: str | None = None,
    tie: Sequence[str] = (),
    strict: bool = False,
    tolerance_days: int | None = None,
    matched_on: str | None = None,
    block: str = "month",
) -> DataFrame:
    """Last right row per key with ``right_on <= on`` (``<`` if strict).

    Work is cut by (key, calendar block), so one key with very many rows is
    spread over its blocks.  The newest row of every block is carried into the
    later ones first (one row per key and block); inside a block the rows are
    merged by a window.  ``tie`` orders right rows of one date; the last wins.
    """
    r_on = right_on or on
    value = F.struct(F.col(r_on).alias("_at"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    order = F.struct(F.col(r_on), *tie) if tie else F.col(r_on)
    rights = right.where(F.col(r_on).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_k"), F.trunc(r_on, block).alias("_b"), F.col(r_on).alias("_t"), value.alias("_v"), order.alias("_o"))
    newest = rights.groupBy("_k", "_b").agg(F.max_by("_v", "_o").alias("_v"))
    wanted = left.select(F.col(key).alias("_k"), F.trunc(on, block).alias("_b")).distinct()
    # one row per key and block: bounded by the calendar
    carried = (
        newest.unionByName(wanted.withColumn("_v", F.lit(None).cast(newest.schema["_v"].dataType)))
        .groupBy("_k", "_b").agg(F.first("_v", ignorenulls=True).alias("_v"))
        .withColumn("_v", F.last("_v", ignorenulls=True).over(
            Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("_v").isNotNull())
    )
    lefts = left.select(
        F.col(key).alias("_k"), F.trunc(on, block).alias("_b"), F.col(on).alias("_t"),
        F.lit(1 if strict else 3).alias("_side"), F.struct(*left.columns).alias("_l"))
    side_r = rights.select("_k", "_b", "_t", F.lit(2).alias("_side"), "_v", "_o")
    side_c = carried.select("_k", "_b", F.col("_b").alias("_t"), F.lit(0).alias("_side"), "_v")
    merged = lefts.unionByName(side_r, allowMissingColumns=True).unionByName(side_c, allowMissingColumns=True)
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    hit = merged.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    ok: Column = F.col("_v").isNotNull()
    if tolerance_days is not None:
        ok = ok & (F.datediff(F.col("_t"), F.col("_v._at")) <= tolerance_days)
    extra = [F.when(ok, F.col(f"_v._r_{c}")).alias(c) for c in cols]
    if matched_on:
        extra.append(F.when(ok, F.col("_v._at")).alias(matched_on))
    return hit.select("_l.*", *extra)


def _day(c: str) -> Column:
    return F.unix_date(F.col(c))


def interval_sums(
    grid: DataFrame,
    events: DataFrame,
    measures: dict[str, Column],
    spans: dict[str, tuple[int, int]],
    *,
    key: str = "code",
    on: str = "date",
    event_on: str = "date",
) -> DataFrame:
    """Sums of event measures over calendar-day spans relative to each grid row.

    A span (lo, hi) covers event days in [on+lo, on+hi].  Events are summed to
    one row per (key, day) before the shuffle; all spans share one window
    partitioning.  Output columns are ``<measure>_<span>``, null without events.
    """
    daily = events.groupBy(key, F.col(event_on).alias("_d")).agg(*[F.sum(c).alias(f"_m_{n}") for n, c in measures.items()])
    side_e = daily.select(F.col(key).alias("_k"), _day("_d").alias("_t"), *[f"_m_{n}" for n in measures])
    side_g = grid.select(F.col(key).alias("_k"), _day(on).alias("_t"), F.struct(*grid.columns).alias("_g"))
    both = side_g.unionByName(side_e, allowMissingColumns=True)
    base = Window.partitionBy("_k").orderBy("_t")
    sums = {
        f"{n}_{s}": F.sum(f"_m_{n}").over(base.rangeBetween(lo, hi))
        for n in measures for s, (lo, hi) in spans.items()
    }
    return both.withColumns(sums).where(F.col("_g").isNotNull()).select("_g.*", *sums)


def nth_row_after(events: DataFrame, bars: DataFrame, n: Sequence[int], col: str = "close") -> DataFrame:
    """Value of ``col`` at the first bar on or after each event date and n bars later.

    Bars carry their own leads; each event takes the next bar of a merged,
    time-ordered series.  Columns ``bar_date``, ``at`` and ``t<n>``.
    """
    w = Window.partitionBy("code").orderBy("date")
    ahead = bars.select(
        "code", F.col("date").alias("bar_date"), F.col(col).alias("at"),
        *[F.lead(col, k).over(w).alias(f"t{k}") for k in n],
    )
    days = events.select("code", "date").distinct()  # a hot event day is one row
    side_b = ahead.select("code", F.col("bar_date").alias("_t"), F.lit(1).alias("_side"), F.struct(
        "bar_date", "at", *[f"t{k}" for k in n]).alias("_v"))
    side_e = days.select("code", F.col("date").alias("_t"), F.lit(0).alias("_side"))
    both = side_e.unionByName(side_b, allowMissingColumns=True)
    back = Window.partitionBy("code").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        both.withColumn("_v", F.last("_v", ignorenulls=True).over(back)).where(F.col("_side") == 0)
        .select("code", F.col("_t").alias("date"), "_v.bar_date", "_v.at", *[F.col(f"_v.t{k}").alias(f"t{k}") for k in n])
    )
    return events.join(found, ["code", "date"])


def lookup(df: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join of a dimension; Spark broadcasts it when its measured size allows."""
    return df.join(dim, on, how)


def with_buffer(bars: DataFrame, start, end, pre_days: int, post_days: int, *, on: str = "date") -> tuple[DataFrame, Column]:
    """Bars wide enough for trailing and forward windows, and the final filter.

    A window blocks pushdown of filters on its order column, so the scan is
    narrowed first and the exact range is applied after the windows.
    """
    s, e = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    wide = bars.where((F.col(on) >= F.date_sub(s, pre_days)) & (F.col(on) <= F.date_add(e, post_days)))
    return wide, (F.col(on) >= s) & (F.col(on) <= e)
