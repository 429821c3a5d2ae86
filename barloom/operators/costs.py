"""Transaction costs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fee schedule.
STAMP_CUT = "2023-08-28"
STAMP_BEFORE, STAMP_AFTER = 0.001, 0.0005
COMMISSION_RATE, COMMISSION_MIN = 0.00025, 5.0
TRANSFER_RATE = 0.00001
SLIPPAGE_BPS = 5.0


def _worse(price: Column, side: Column, delta: Column) -> Column:
    s = F.upper(side)
    return F.when(price <= 0, F.raise_error(F.lit("price must be positive"))).when(s == "BUY", price * (1.0 + delta)).when(
        s == "SELL", price * (1.0 - delta)).otherwise(F.raise_error(F.concat(F.lit("side must be BUY or SELL, got "), F.coalesce(side, F.lit("null")))))


def fixed_slippage(price: Column, side: Column, bps: float = SLIPPAGE_BPS) -> Column:
    """Fill worse by a fixed number of basis points."""
    return _worse(price, side, F.lit(bps / 10000.0))


def impact_slippage(price: Column, side: Column, order_volume: Column, bar_volume: Column, impact: float = 0.1) -> Column:
    """Fill worse in proportion to the share of the bar's volume; no volume, no impact."""
    usable = (bar_volume > 0) & (order_volume > 0)
    return _worse(price, side, F.when(usable, impact * F.try_divide(order_volume, bar_volume)).otherwise(0.0))


def commission(price: Column, shares: Column, rate: float = COMMISSION_RATE, minimum: float = COMMISSION_MIN) -> Column:
    notional = price * shares
    return F.when(notional > 0, F.greatest(notional * rate, F.lit(minimum))).otherwise(0.0)


def stamp_duty(price: Column, shares: Column, side: Column, day: Column | None = None, rate: float = STAMP_AFTER) -> Column:
    """Sales only; the dated schedule where a trade date is known."""
    r = F.lit(rate)
    if day is not None:
        r = F.when(day.isNull(), rate).when(day >= F.lit(STAMP_CUT).cast("date"), STAMP_AFTER).otherwise(STAMP_BEFORE)
    return F.when(F.upper(side) == "SELL", price * shares * r).otherwise(0.0)


def is_shanghai(symbol: Column) -> Column:
    """Codes starting with 6 or 9, bare, with SH before, or with .SH behind."""
    return F.coalesce(F.upper(F.trim(symbol)).rlike(r"^(SH[69]|[69][^.]*(\.SH)?$)"), F.lit(False))


def transfer_fee(price: Column, shares: Column, symbol: Column, rate: float = TRANSFER_RATE) -> Column:
    return F.when(is_shanghai(symbol), price * shares * rate).otherwise(0.0)


def with_costs(trades: DataFrame, *, filled: Column | None = None, symbol: str = "sym", day: str | None = "date") -> DataFrame:
    """Full breakdown per trade row: fill, fees, slippage and net cash."""
    price, shares, side = F.col("price"), F.col("shares"), F.col("action")
    df = trades.withColumn("filled_price", filled if filled is not None else fixed_slippage(price, side))
    fill = F.col("filled_price")
    df = df.withColumns({
        "commission": commission(fill, shares),
        "stamp_duty": stamp_duty(fill, shares, side, F.col(day) if day else None),
        "transfer_fee": transfer_fee(fill, shares, F.col(symbol)),
    })
    fees = F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee")
    buy = F.upper(side) == "BUY"
    return df.withColumns({
        "total_fees": fees, "slippage_cost": F.when(buy, fill - price).otherwise(price - fill) * shares,
        "net_amount": F.when(buy, -(fill * shares + fees)).otherwise(fill * shares - fees),
    })
