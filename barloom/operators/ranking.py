"""Exact ranks, positions and quantiles of groups too large for one task.

``rank() over (partition by date order by x)`` hands a whole cross-section to
one task.  Here every group is cut into value ranges:

1. approximate percentiles per group give border values.  They decide only the
   balance, never the result;
2. a row falls either strictly between two borders (even range) or exactly on
   one (odd range).  A value shared by many rows is a border, so it has a range
   of its own, and an open range holds about 1/RANGES of its group;
3. range sizes, summed upwards, give the number of rows below a range; a window
   ranks rows inside open ranges only.  Rows of an odd range are all equal: their
   rank needs no window, so they are spread over tasks by a slice key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 32
SLICES = 32
#: Groups of up to so many rows are one range: one task orders that many without trouble.
WHOLE = 200_000


def bounded_by_calendar(stats: DataFrame, keys: Sequence[str]) -> bool:
    """True if the keys are one DATE column: at most one row per calendar day."""
    types = {f.name: f.dataType for f in stats.schema.fields}
    return len(keys) == 1 and isinstance(types[keys[0]], T.DateType)


def calendar_join(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of per-group statistics onto rows.

    Statistics keyed by one DATE column have at most one row per calendar day
    (tens of thousands per century) and are broadcast.  For any other key Spark
    chooses: it broadcasts by measured size, or merges and splits skewed keys.
    """
    if bounded_by_calendar(stats, keys):
        stats = F.broadcast(stats)
    return df.join(stats, list(keys), "left")


def with_global(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table through a scalar subquery."""
    cols = stats.columns
    one = stats.select(F.struct(*cols).alias("_g")).scalar()
    return df.withColumn("_g", one).select(*df.columns, *[F.col("_g")[c].alias(c) for c in cols])


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return calendar_join(df, stats, by) if by else with_global(df, stats)


def _borders(value: str, ranges: int = RANGES) -> Column:
    return F.array_distinct(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000))


def _range_of(value: Column, borders: Column) -> Column:
    """2 x (borders below the value) + 1 if the value is a border."""
    return (2 * F.size(F.filter(borders, lambda b: b < value)) + F.array_contains(borders, value).cast("int")).cast("int")


def place(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``_range_<v>`` for every value column; all borders come from one aggregation.

    The groups are counted first: where none has more than ``WHOLE`` rows, no
    borders are needed, and every group is one range; all windows and counts
    then share one exchange.
    """
    if df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WHOLE).isEmpty():
        return (df.repartition(*by) if by else df).withColumns({f"_range_{v}": F.when(F.col(v).isNotNull(), F.lit(0)) for v in values})
    stats = df.groupBy(*by).agg(*[_borders(v).alias(f"_b_{v}") for v in values])
    cols = {f"_range_{v}": F.when(F.col(v).isNotNull(), _range_of(F.col(v), F.col(f"_b_{v}"))) for v in values}
    return attach(df, stats, by).withColumns(cols).drop(*[f"_b_{v}" for v in values])


def _below(placed: DataFrame, by: Sequence[str], cells: Sequence[str], *more: Column) -> DataFrame:
    """Rows per range (``_size``) and in all lower ranges (``_below``); a few dozen rows per group."""
    sizes = placed.where(F.col(cells[0]).isNotNull()).groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("_size"), *more)
    lower = Window.partitionBy(*by).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_below", F.coalesce(F.sum("_size").over(lower), F.lit(0)))


def _spread_key(df: DataFrame) -> Column:
    """A content hash: the same row gets the same slice when a task is run again."""
    cols = [c for c in ("code", "_h") if c in df.columns] or df.columns
    return F.pmod(F.xxhash64(*cols), F.lit(SLICES))


def ranked(
    placed: DataFrame, by: Sequence[str], value: str, out: str, cells: DataFrame | None = None
) -> DataFrame:
    """Average rank of a placed value column, appended as ``out``.

    ``cells`` may bring ready counts per (by, range) as column ``_cnt``.
    """
    rng = f"_range_{value}"
    if cells is None:
        below = _below(placed, by, [rng])
    else:
        lower = Window.partitionBy(*by).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
        below = cells.groupBy(*by, rng).agg(F.sum("_cnt").alias("_size")).withColumn("_below", F.coalesce(F.sum("_size").over(lower), F.lit(0)))
    tied = (F.col(rng) % 2) == 1
    df = attach_cells(placed, below, [*by, rng], not by or bounded_by_calendar(placed.select(*by), by))
    # equal rows need no order: any split of them over tasks will do
    df = df.withColumn("_slice", F.when(tied | F.col(rng).isNull(), _spread_key(placed)).otherwise(0))
    w = Window.partitionBy(*by, rng, "_slice").orderBy(value)
    inside = (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2.0  # lowest and highest rank of the ties
    rank = F.when(tied, F.col("_below") + (F.col("_size") + 1) / 2.0).otherwise(F.col("_below") + inside)
    return df.withColumn(out, F.when(F.col(rng).isNotNull(), rank)).drop(rng, "_size", "_below", "_slice")


def attach_cells(df: DataFrame, cells: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    return df.join(F.broadcast(cells) if bounded else cells, list(keys), "left")


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank (1-based, ties share the mean) of ``value`` within ``by``; null stays null."""
    return ranked(place(df, by, [value]), by, value, out)


def _in_order(df: DataFrame, column: str) -> DataFrame:
    """Add ``_tie``, a number that never falls where ``column`` rises.

    A string gives the six bytes behind the prefix that all strings share, so
    prefixed codes spread as well as plain ones.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn("_tie", F.col(column).cast("double"))
    ends = df.agg(F.min(column).alias("_first"), F.max(column).alias("_last"))
    n = F.least(F.length("_first"), F.length("_last"))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda k, i: F.when((k == i - 1) & (F.substring("_first", i, F.lit(1)) == F.substring("_last", i, F.lit(1))), i).otherwise(k))
    df = with_global(df, ends.select(F.coalesce(same, F.lit(0)).alias("_skip")))
    rest = F.hex(F.substring(F.encode(F.substring(F.col(column), F.col("_skip") + 1, F.lit(6)), "utf-8"), 1, 6))
    return df.withColumn("_tie", F.conv(F.rpad(rest, 12, "0"), 16, 10).cast("double")).drop("_skip")


def position(df: DataFrame, by: Sequence[str], value: str, tiebreak: str, out: str, total: str | None = None) -> DataFrame:
    """1-based position in (value, tiebreak) order within ``by``; rows without a value are dropped.

    Equal values (odd ranges) are cut again by ranges of the tiebreak, so a
    heavily tied value does not gather in one task.
    """
    known = _in_order(df.where(F.col(value).isNotNull()), tiebreak)
    placed = place(known, by, [value])
    ties = with_global(placed, known.agg(F.coalesce(_borders("_tie", SLICES), F.array().cast("array<double>")).alias("_tb")))
    rng = f"_range_{value}"
    placed = ties.withColumn("_slice", F.when(F.col(rng) % 2 == 1, F.coalesce(_range_of(F.col("_tie"), F.col("_tb")), F.lit(-1))).otherwise(0)).drop("_tb", "_tie")
    below = _below(placed, by, [rng, "_slice"]).drop("_size")
    small = not by or bounded_by_calendar(placed.select(*by), by)
    w = Window.partitionBy(*by, rng, "_slice").orderBy(value, tiebreak)
    res = attach_cells(placed, below, [*by, rng, "_slice"], small)
    res = res.withColumn(out, (F.col("_below") + F.row_number().over(w)).cast("bigint")).drop(rng, "_slice", "_below")
    if total:
        sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias(total))
        res = attach(res, sizes, by)
    return res


#: Approximate quantiles are exact to 1 / ACCURACY of the rows.
ACCURACY = 10000


def _brackets(df: DataFrame, around: dict[int, tuple[str, float, float | None, float | None]]) -> dict[int, list[float]]:
    """Approximate quantiles about the share ``p`` of each column's values in [lo, hi] (None: all), in one aggregation."""
    margin = 2.0 / ACCURACY
    aggs = []
    for i, (c, p, lo, hi) in around.items():
        v = F.col(c).cast("double")
        inside = v if lo is None else F.when(v.between(F.lit(lo), F.lit(hi)), v)
        aggs.append(F.percentile_approx(inside, [max(0.0, p - margin), min(1.0, p + margin)], ACCURACY).alias(f"_{i}"))
    row = df.agg(*aggs).first()
    return {i: list(row[f"_{i}"] or []) for i in around}


def global_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], *, limit: int = 100_000) -> DataFrame:
    """One row of exact linear-interpolated quantiles: ``wanted`` maps names to (column, share).

    Approximate quantiles bracket every wanted value; a second aggregation
    counts the rows below and inside each bracket and finds the nearest values
    outside it.  A bracket of more than ``limit`` rows is bracketed again, which
    leaves a few ten-thousandths of its rows, until it is small or a single
    value.  At most ``limit`` values of a bracket are ordered, whatever the size
    of the table.
    """
    names, specs = list(wanted), [(c, float(p)) for c, p in wanted.values()]
    cols = list(dict.fromkeys(c for c, _ in specs))
    df = df.select(*cols)
    known = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    ranks = {i: (known[c] - 1) * p for i, (c, p) in enumerate(specs) if known[c]}
    bounds: dict[int, tuple[float | None, float | None]] = dict.fromkeys(ranks, (None, None))
    state: dict[int, tuple[int, int, float | None, float | None]] = {}  # below, inside, next value under, next over
    share = {i: specs[i][1] for i in ranks}
    todo = list(ranks)
    while todo:
        tried = _brackets(df, {i: (specs[i][0], share[i], *bounds[i]) for i in todo})
        aggs = []
        for i in todo:
            v, (lo, hi) = F.col(specs[i][0]).cast("double"), map(F.lit, tried[i])
            aggs += [F.count_if(v < lo).alias(f"b{i}"), F.count_if(v.between(lo, hi)).alias(f"n{i}"), F.count_if(v == lo).alias(f"l{i}"), F.count_if(v == hi).alias(f"h{i}"), F.max(F.when(v < lo, v)).alias(f"u{i}"), F.min(F.when(v > hi, v)).alias(f"o{i}")]
        row = df.agg(*aggs).first()
        again = []
        for i in todo:
            below, inside = row[f"b{i}"], row[f"n{i}"]
            k, (lo, hi) = ranks[i], tried[i]
            if below <= k and math.ceil(k) < below + row[f"l{i}"]:  # all on a value that many rows share
                hi, inside = lo, row[f"l{i}"]
            elif math.floor(k) >= below + inside - row[f"h{i}"] and math.ceil(k) < below + inside:
                lo, below, inside = hi, below + inside - row[f"h{i}"], row[f"h{i}"]
            smaller = i not in state or inside < state[i][1]
            if below - 1 <= math.floor(k) and math.ceil(k) <= below + inside and smaller:
                bounds[i], state[i] = (lo, hi), (below, inside, row[f"u{i}"], row[f"o{i}"])
                share[i] = min(1.0, max(0.0, (k - below) / max(inside - 1, 1)))
                if inside > limit and lo < hi:
                    again.append(i)
        todo = again
    inside = [F.when(F.col(specs[i][0]).cast("double").between(F.lit(lo), F.lit(hi)), F.struct(F.lit(i).alias("i"), F.col(specs[i][0]).cast("double").alias("v"))) for i, (lo, hi) in bounds.items()]
    if not inside:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])
    cells = df.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("to", F.sum("rows").over(upto))
    value = []
    for i, name in enumerate(names):
        if i not in ranks:
            value.append(F.lit(None).cast("double").alias(name))
            continue
        below, _, under, over = state[i]
        at = lambda k: F.max(F.when((F.col("i") == i) & (F.col("to") + below - F.col("rows") <= k) & (F.col("to") + below > k), F.col("v")))  # noqa: B023, E731
        lo, hi = F.coalesce(at(math.floor(ranks[i])), F.lit(under)), F.coalesce(at(math.ceil(ranks[i])), F.lit(over))
        value.append((lo + (hi - lo) * (ranks[i] - math.floor(ranks[i]))).alias(name))
    return cells.agg(*value)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per entry.

    Only the ranges that hold a wanted order statistic are sorted.
    """
    if not by:
        return global_quantiles(df, {name: (value, p) for name, p in probs.items()})
    rng = f"_range_{value}"
    placed = place(df.where(F.col(value).isNotNull()).select(*by, value), by, [value])
    below = _below(placed, by, [rng], F.min(value).alias("_min"))
    total = F.sum("_size").over(Window.partitionBy(*by))
    cells = below.withColumn("_n", total)
    spots = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * float(p)
        for side, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            spots.append(F.struct(F.lit(f"{side}_{name}").alias("spot"), k.cast("bigint").alias("k")))
    wanted = cells.withColumn("_spots", F.filter(F.array(*spots), lambda s: (F.col("_below") <= s["k"]) & (s["k"] < F.col("_below") + F.col("_size")))).where(F.size("_spots") > 0)
    wanted = wanted.withColumnRenamed(rng, "_rng")
    # odd ranges hold one value; open ranges are ordered
    tied = wanted.where(F.col("_rng") % 2 == 1).select(*by, "_n", F.explode("_spots").alias("_s"), F.col("_min").alias("_v"))
    open_ = wanted.where(F.col("_rng") % 2 == 0).select(*[F.col(b) for b in by], F.col("_rng").alias(rng), "_n", "_below", "_spots")
    small = not by or bounded_by_calendar(placed.select(*by), by)
    rows = placed.join(F.broadcast(open_) if small else open_, [*by, rng])
    w = Window.partitionBy(*by, rng).orderBy(value)
    rows = rows.withColumn("_k", F.col("_below") + F.row_number().over(w) - 1)
    rows = rows.select(*by, "_n", F.explode(F.filter("_spots", lambda s: s["k"] == F.col("_k"))).alias("_s"), F.col(value).alias("_v"))
    got = tied.unionByName(rows).groupBy(*by).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("_s.spot") == f"{s}_{n}", F.col("_v"))).alias(f"_{s}_{n}") for n in probs for s in ("lo", "hi")])
    outs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * float(p)
        outs.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (pos - F.floor(pos))).alias(name))
    return got.select(*by, *outs)


def quantile_bucket(position_col: str, total_col: str, k: int = 5) -> Column:
    """Quantile bucket 1..k of a first-rank position, edges included on the right."""
    pos, n = F.col(position_col), F.col(total_col)
    return F.greatest(F.lit(1), F.ceil(F.try_divide((pos - 1) * float(k), n - 1))).cast("int")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group; the tie order must be complete.

    Spark keeps only k rows per group in every task before the shuffle, for k
    up to ``spark.sql.optimizer.windowGroupLimitThreshold``; a larger k would
    send whole groups to one task and is refused: use ``position``.
    """
    most = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > most:
        raise ValueError(f"top_k is for at most {most} rows a group; cut at a position instead")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
