"""Panels of keys by calendar dates, kept as runs.

Between two changes a key's values stay what they are, so a panel is a table of
runs: (key, first place, last place, values), places counting the dates of the
calendar.  Windows and shuffles see changes only, however long the calendar;
``expand`` makes one row per key and date where these are wanted, a map of runs
and a lookup of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import tasks_for

#: Events that a task sums.
EVENTS = 200_000
FIRST, LAST = "first", "last"


def places(calendar: DataFrame, *, on: str = "date") -> DataFrame:
    """(on, place, _n): the distinct dates in order, numbered from 0; one row per date, so the window is bounded."""
    days = calendar.select(on).where(F.col(on).isNotNull()).distinct()
    return days.select(on, (F.row_number().over(Window.orderBy(on)) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))


def place_from(df: DataFrame, cal: DataFrame, day: str, *, on: str = "date") -> DataFrame:
    """Rows with ``place`` and ``_n``: the first calendar date on or after ``day``; rows after the last date are left out.

    The place is found once for each distinct day; dates are DATEs, so both
    sides of the window have at most one row per day.
    """
    days = df.select(F.col(day).alias("_d")).where(F.col(day).isNotNull()).distinct()
    both = days.select("_d", F.lit(None).cast("int").alias("place"), F.lit(None).cast("bigint").alias("_n"), F.lit(0).alias("_side")).unionByName(
        cal.select(F.col(on).alias("_d"), "place", "_n", F.lit(1).alias("_side")))
    ahead = Window.orderBy("_d", "_side").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in ("place", "_n")}).where("_side = 0 and place is not null").drop("_side")
    return df.join(F.broadcast(found), df[day] == found["_d"]).drop("_d")


def runs(keys: DataFrame, cal: DataFrame, changes: DataFrame, cols: Sequence[str], *, key: str = "code") -> DataFrame:
    """(key, cols, first, last): values from each change to the next; null before a key's first change.

    ``changes`` has (key, place, cols), one row per key and place.
    """
    n = cal.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    start = keys.select(key).distinct().join(changes.where("place = 0").select(key), key, "left_anti").select(key, F.lit(0).alias("place"))
    known = changes.select(key, "place", *cols).join(keys.select(key).distinct(), key, "left_semi")
    w = Window.partitionBy(key).orderBy("place")
    out = known.unionByName(start, allowMissingColumns=True).where(F.lit(n) > 0)
    return out.select(key, *cols, F.col("place").alias(FIRST), (F.coalesce(F.lead("place").over(w), F.lit(n)) - 1).cast("int").alias(LAST))


def expand(panel: DataFrame, cal: DataFrame, *, on: str = "date") -> DataFrame:
    """One row per key and date, with ``place``; the calendar has one row per date and is broadcast."""
    rows = panel.withColumn("place", F.explode(F.sequence(FIRST, LAST))).drop(FIRST, LAST)
    return rows.join(F.broadcast(cal.select("place", on)), "place")


def carried(keys: DataFrame, calendar: DataFrame, values: DataFrame, cols: Sequence[str], *, key: str = "code", day: str = "date", at: str | None = None) -> DataFrame:
    """Every key on every calendar date with the values last known then (``values``: one row per key and day)."""
    cal = places(calendar)
    marked = place_from(values.withColumn(at or "_at", F.col(day)), cal, day)
    extra = [*cols, at or "_at"]
    order = F.struct(at or "_at", *cols)
    newest = marked.groupBy(key, "place").agg(F.max(at or "_at").alias(at or "_at"))  # several days before one calendar date: the last
    kept = marked.join(newest, [key, "place", at or "_at"]).groupBy(key, "place").agg(F.max(order).alias("_v")).select(key, "place", "_v.*")
    out = expand(runs(keys, cal, kept, extra, key=key), cal).drop("place")
    return out if at else out.drop("_at")


def zero_filled(keys: DataFrame, calendar: DataFrame, events: DataFrame, cols: Sequence[str], *, key: str = "code", day: str = "date") -> DataFrame:
    """Every key on every calendar date with its event of that very date, or zeros (``events``: one row per key and day)."""
    cal = places(calendar)
    on_day = events.join(F.broadcast(cal), events[day] == cal["date"]).select(events[key], "place", "_n", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])
    after = on_day.where("place + 1 < _n").select(key, (F.col("place") + 1).alias("place"))
    after = after.join(on_day.select(key, "place"), [key, "place"], "left_anti")
    changes = on_day.drop("_n").unionByName(after, allowMissingColumns=True)
    return expand(runs(keys, cal, changes, cols, key=key), cal).drop("place").fillna(0, subset=list(cols))


def trailing(keys: DataFrame, calendar: DataFrame, events: DataFrame, sums: dict[str, tuple[str, int]], *, key: str = "code", day: str = "date") -> tuple[DataFrame, DataFrame]:
    """Runs of trailing sums, and the calendar: ``sums`` maps names to (measure, number of calendar dates).

    A sum over n dates changes where an event enters and n places later, where
    it leaves; at these places it is a range frame over the key's events, zero
    before the first.  Read ``events`` (one row per key and day) from a written
    table: they are counted, and dealt by key once, about ``EVENTS`` to a task,
    for the sums, the frames and the runs.
    """
    cal = places(calendar)
    measures = sorted({m for m, _ in sums.values()})
    steps = sorted({n for _, n in sums.values()})
    size = cal.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    on_day = events.where(F.col(key).isNotNull()).join(F.broadcast(cal), events[day] == cal["date"]).select(events[key], "place", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])
    zero = {m: F.lit(0).cast(t).alias(m) for m, t in on_day.dtypes if m in measures}
    begins = keys.select(key).distinct().select(key, F.lit(0).alias("place"), *zero.values(), F.lit(1).alias("_asked"))
    dealt = on_day.withColumn("_asked", F.lit(0)).unionByName(begins).repartition(tasks_for(events.sparkSession, events.count(), EVENTS), key)
    enters = F.struct("place", "_asked", *measures)
    leaves = [F.struct((F.col("place") + k).alias("place"), F.lit(0).alias("_asked"), *zero.values()) for k in steps]
    points = dealt.select(key, F.explode(F.array(enters, *leaves)).alias("_p")).select(key, "_p.*").where(F.col("place") < size)
    points = points.groupBy(key, "place").agg(F.max("_asked").alias("_asked"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])
    w = Window.partitionBy(key).orderBy("place")
    first = F.first("_asked").over(w.rowsBetween(Window.unboundedPreceding, 0))  # an asked key begins at place 0
    points = points.withColumn("_asked", first)
    return points.select(
        key, "_asked", *[F.sum(m).over(w.rangeBetween(-(n - 1), 0)).alias(name) for name, (m, n) in sums.items()],
        F.col("place").alias(FIRST), (F.coalesce(F.lead("place").over(w), F.lit(size)) - 1).cast("int").alias(LAST)).where("_asked = 1").drop("_asked"), cal


def within(place: Column | str, n: int) -> Column:
    """Rows of a trailing frame of n dates: fewer at the start of the calendar."""
    return F.least((F.col(place) if isinstance(place, str) else place) + 1, F.lit(n))
