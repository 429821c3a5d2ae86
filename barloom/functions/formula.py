"""Charting-formula functions as Column expressions over one symbol's bars.

Periods are coerced to an integer of at least 1; the cumulative meaning of a
zero period is available as ``n=None``.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.frames import col, false_if_null, running, series, trail

Num = Column | str | float | int


def value(x: Num) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else col(x)


def period(n: float) -> int:
    return max(1, int(round(float(n))))


def _frame(n: float | None) -> WindowSpec:
    return running() if n is None else trail(period(n))


def MA(x: Num, n: float) -> Column:
    return F.avg(value(x)).over(_frame(n))


def WMA(x: Num, n: float) -> Column:
    """Weights 1..k over the rows present."""
    win = F.collect_list(value(x)).over(_frame(n))
    size = F.size(win)
    # position-weighted total without building an indexed copy of the window
    total = F.aggregate(
        win,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("i")),
        lambda a, v: F.struct((a["s"] + v * (a["i"] + 1.0)).alias("s"), (a["i"] + 1.0).alias("i")),
        lambda a: a["s"],
    )
    return F.when(size > 0, total / (size * (size + 1) / 2.0))


def REF(x: Num, n: float) -> Column:
    return F.lag(value(x), period(n)).over(series())


def HHV(x: Num, n: float | None) -> Column:
    return F.max(value(x)).over(_frame(n))


def LLV(x: Num, n: float | None) -> Column:
    return F.min(value(x)).over(_frame(n))


def SUM(x: Num, n: float | None) -> Column:
    return F.sum(value(x)).over(_frame(n))


def STD(x: Num, n: float) -> Column:
    f = _frame(n)
    return F.when(F.count(value(x)).over(f) >= 2, F.stddev_samp(value(x)).over(f))


def MAX(a: Num, b: Num) -> Column:
    return F.greatest(value(a), value(b))


def MIN(a: Num, b: Num) -> Column:
    return F.least(value(a), value(b))


def ABS(x: Num) -> Column:
    return F.abs(value(x))


def truth(x: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (null is not true)."""
    return F.when(false_if_null(x), 1.0).otherwise(0.0)


def _hit(x: Num) -> Column:
    return F.when(value(x) > 0, 1).otherwise(0)


def CROSS(a: Num, b: Num) -> Column:
    """a rises above b: a > b now and a <= b on the previous row."""
    a, b = value(a), value(b)
    w = series()
    return truth((a > b) & (F.lag(a, 1).over(w) <= F.lag(b, 1).over(w)))


def cross_strict(a: Num, b: Num) -> Column:
    """a >= b now and a < b before; null when any input is missing."""
    a, b = value(a), value(b)
    w = series()
    pa, pb = F.lag(a, 1).over(w), F.lag(b, 1).over(w)
    known = a.isNotNull() & b.isNotNull() & pa.isNotNull() & pb.isNotNull()
    return F.when(known, F.when((a >= b) & (pa < pb), 1.0).otherwise(0.0))


def EVERY(x: Num, n: float) -> Column:
    k = period(n)
    return truth(F.sum(_hit(x)).over(trail(k)) >= k)


def EXIST(x: Num, n: float) -> Column:
    return truth(F.sum(_hit(x)).over(_frame(n)) > 0)


def COUNT(x: Num, n: float) -> Column:
    return F.sum(_hit(x)).over(_frame(n)).cast("double")


def BARSLAST(x: Num, row: Column | str = "rn") -> Column:
    """Rows since the condition last held; null before the first time.

    ``row`` is the row number within the symbol.
    """
    last = F.last(F.when(value(x) > 0, col(row)), ignorenulls=True).over(running())
    return (col(row) - last).cast("double")


def IF(cond: Num, a: Num, b: Num) -> Column:
    """cond > 0 picks a else b; a missing branch value becomes 0."""
    return F.when(value(cond) > 0, F.coalesce(value(a), F.lit(0.0))).otherwise(F.coalesce(value(b), F.lit(0.0)))


def LOG(x: Num) -> Column:
    return F.when(value(x) > 0, F.log(value(x)))


def SQRT(x: Num) -> Column:
    return F.when(value(x) >= 0, F.sqrt(value(x)))


def DIV(a: Num, b: Num) -> Column:
    return F.try_divide(value(a), value(b))


def AND(a: Num, b: Num) -> Column:
    return truth((value(a) > 0) & (value(b) > 0))


def OR(a: Num, b: Num) -> Column:
    return truth(false_if_null(value(a) > 0) | false_if_null(value(b) > 0))


def NOT(a: Num) -> Column:
    """1 where the value is known and not positive."""
    return truth(value(a) <= 0)


def NE(a: Num, b: Num) -> Column:
    """Inequality; a missing side counts as different."""
    return truth(F.coalesce(value(a) != value(b), F.lit(True)))
