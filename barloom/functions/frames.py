"""Window frames, null rules and small column helpers shared by every operator.

All per-symbol windows use one ``partitionBy(code).orderBy(date)`` so Spark
plans a single exchange and a single sort for any number of them.  They run on
*bars*: rows unique on (code, date), so a group never exceeds the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

CODE, DATE = "code", "date"


def series(*extra: str, code: str = CODE, date: str = DATE) -> WindowSpec:
    """One symbol in time order."""
    return Window.partitionBy(*extra, code).orderBy(date)


def trail(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """Current row and the n-1 rows before it."""
    return (w or series()).rowsBetween(-(n - 1), 0)


def prior(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The n rows before the current one."""
    return (w or series()).rowsBetween(-n, -1)


def running(w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(Window.unboundedPreceding, 0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full(agg: Column, over: Column | str, n: int, frame: WindowSpec) -> Column:
    """``agg`` over ``frame``, null until the frame holds n non-null values."""
    return F.when(F.count(col(over)).over(frame) >= n, agg.over(frame))


def mean_n(c: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return full(F.avg(col(c)), c, n, trail(n, w))


def sum_n(c: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return full(F.sum(col(c)), c, n, trail(n, w))


def std_n(c: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return full(F.stddev_samp(col(c)), c, n, trail(n, w))


def max_n(c: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return full(F.max(col(c)), c, n, trail(n, w))


def min_n(c: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return full(F.min(col(c)), c, n, trail(n, w))


def lag(c: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(c), n).over(w or series())


def lead(c: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(col(c), n).over(w or series())


def div(a: Column | str, b: Column | str) -> Column:
    """Division with 0 -> null (ANSI mode would raise)."""
    return F.try_divide(col(a), col(b))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division in floating point: x/0 is an infinity, 0/0 is NaN."""
    a, b = col(a).cast("double"), col(b).cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).when(a < 0, -inf)).otherwise(F.try_divide(a, b))


def change(c: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    """Relative change over n rows."""
    return div(col(c), lag(c, n, w)) - 1.0


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def rising_edge(state: Column, w: WindowSpec | None = None) -> Column:
    """State true now and not on the previous row; null counts as false."""
    s = false_if_null(state)
    return s & ~false_if_null(F.lag(s, 1).over(w or series()))


def falling_edge(state: Column, w: WindowSpec | None = None) -> Column:
    """State not true now but true on the previous row."""
    s = false_if_null(state)
    return ~s & false_if_null(F.lag(s, 1).over(w or series()))


def clean(c: Column | str) -> Column:
    """NaN and infinities become null, so that null is the only missing value."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def gated(n: int, over: Column | str, value: Column, w: WindowSpec | None = None) -> Column:
    """``value`` once n non-null observations of ``over`` are in the frame."""
    return F.when(F.count(col(over)).over(trail(n, w)) >= n, value)
