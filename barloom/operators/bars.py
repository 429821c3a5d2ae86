"""Trade-to-bar aggregation and derived panels.

The bar aggregation combines on the map side before anything is shuffled, so
a symbol that owns a third of all trades still ships at most one partial row
per (task, period).  After it, rows are unique on (code, date).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pack(parts: Sequence[tuple[Column, int]]) -> tuple[Column, int]:
    """Non-negative integers of at most 18 digits in total as one BIGINT; a wider value raises."""
    packed, width = F.lit(0).cast("bigint"), 0
    for c, digits in parts:
        fits = F.when((c >= 0) & (c < 10**digits), c.cast("bigint")).otherwise(F.raise_error(F.lit("sequence part too wide")).cast("bigint"))
        packed, width = packed * F.lit(10**digits) + fits, width + digits
    return packed, width


def sequence_key(high: Sequence[tuple[Column, int]], low: Sequence[tuple[Column, int]]) -> Column:
    """Total order of trades as one DECIMAL from two groups of (column, digits).

    A DECIMAL ordering keeps first/last inside a hash aggregate; a struct
    ordering would force a sort of the raw trades.
    """
    (hi, hi_w), (lo, lo_w) = _pack(high), _pack(low)
    if max(hi_w, lo_w) > 18:
        raise ValueError("a group is limited to 18 digits")
    return hi.cast(f"decimal({hi_w},0)") * F.lit(10**lo_w).cast(f"decimal({lo_w + 1},0)") + lo.cast(f"decimal({lo_w},0)")


def to_bars(
    trades: DataFrame,
    *,
    code: Column,
    period: Column,
    price: Column,
    seq: Column,
    volume: Column | None = None,
    amount: Column | None = None,
) -> DataFrame:
    """Trades to OHLCV bars keyed (code, date)."""
    aggs = [
        F.min_by("_p", "_k").alias("open"),
        F.max_by("_p", "_k").alias("close"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
    ]
    src = trades.select(
        code.alias("_c"), period.alias("date"), price.alias("_p"), seq.alias("_k"),
        *([volume.alias("_v")] if volume is not None else []),
        *([amount.alias("_a")] if amount is not None else []),
    )
    aggs.append((F.sum("_v") if volume is not None else F.count(F.lit(1))).cast("bigint").alias("volume"))
    if amount is not None:
        aggs.append(F.sum("_a").alias("amount"))
    grouped = src.groupBy("_c", "date").agg(*aggs)
    # the string code is built once per bar, not once per trade
    return grouped.withColumn("code", F.lpad(F.col("_c").cast("string"), 6, "0")).drop("_c").select(
        "code", "date", "open", "high", "low", "close", "volume",
        *(["amount"] if amount is not None else []),
    )


def equal_weight_index(bars: DataFrame) -> DataFrame:
    """Equal-weighted synthetic index per date (mean O/H/L/C, summed volume)."""
    return bars.groupBy("date").agg(
        *[F.avg(c).alias(c) for c in ("open", "high", "low", "close")],
        F.sum("volume").cast("bigint").alias("volume"),
        F.count(F.lit(1)).alias("n_codes"),
    )
