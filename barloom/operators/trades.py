"""Positions, profit and book curves from a trade log.

The log has sym, date, action (BUY/SELL), price, shares and ``seq``, which
orders a symbol's trades of one day.  Everything that adds up is summed per (symbol, day)
on the map side first, so later windows run on at most one row per symbol and
day.  Only the rounded weighted-average cost depends on the order of single
trades; it is folded in blocks of the log, most of which need no predecessor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import div
from barloom.operators.joins import asof
from barloom.operators.ranking import with_global
from barloom.sources.sinks import publish


def is_buy() -> Column:
    return F.col("action") == "BUY"


def signed_shares() -> Column:
    return F.when(is_buy(), F.col("shares")).when(F.col("action") == "SELL", -F.col("shares")).otherwise(0)


def numbered(trades: DataFrame, out: str = "n") -> DataFrame:
    """Place of every row in the order of its symbol (1, 2, ...).

    Days are counted first, so that rows are ordered within a symbol's day only
    and a symbol with a third of all trades is spread over its days.
    """
    days = trades.groupBy(F.col("sym").alias("_s"), F.col("date").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_s").orderBy(F.col("_d").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_s", "_d", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    rows = trades.withColumn("_i", F.row_number().over(Window.partitionBy("sym", "date").orderBy("seq")))
    both = rows.join(days, F.col("sym").eqNullSafe(F.col("_s")) & F.col("date").eqNullSafe(F.col("_d")))
    return both.select(*trades.columns, (F.col("_before") + F.col("_i")).alias(out))


def in_blocks(days: DataFrame, rows: int) -> DataFrame:
    """(sym, date, n, ...) with ``block``: a symbol's days in order, cut where about ``rows`` trades are reached."""
    upto = F.sum("n").over(Window.partitionBy("sym").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("block", F.floor((upto - 1) / rows).cast("int"))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Decimal rounding of each value as ``round`` does it; values close to a tie are left to it."""
    scale = 10.0**digits
    y = x * scale
    near = np.rint(y)
    out = near / scale
    ties = np.abs(y - near) > 0.4999
    if ties.any():
        for i in np.nonzero(ties)[0].tolist():
            out[i] = round(float(x[i]), digits)
    return out


BUFFER = 200_000  # trades that a task folds at once
WIDE = 24  # so many blocks are folded side by side; the rest of the longest ones alone


def _cost(cost: np.ndarray, held: np.ndarray, shares: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Average after buys; a buy while flat or short restarts it."""
    some = held > 0
    return rounded(np.where(some, (held * cost + shares * price) / np.where(some, held + shares, 1), price), 4)


def _advance(rows: dict[str, np.ndarray], starts: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Fold blocks of trades from the lowest and the highest cost before them, in place; profit in cents where both are one.

    Every step is monotone in the cost, so the cost after a block lies between
    its two ends; where they have met, the cost before it no longer matters.
    """
    exact, cents = low == high, np.zeros(len(starts), np.int64)
    order = np.argsort(-sizes, kind="stable")
    t = 0
    while (live := int(np.searchsorted(-sizes[order], -t, "left"))) >= WIDE:
        idx = order[:live]
        buy, held, shares, price = (rows[n][starts[idx] + t] for n in ("buy", "held", "shares", "price"))
        sold = np.nonzero(~buy & exact[idx] & (held > 0))[0]
        if len(sold):
            k = idx[sold]
            gain = rounded((price[sold] - low[k]) * np.minimum(shares[sold], held[sold]), 2)
            cents[k] += np.rint(gain * 100).astype(np.int64)
        k, args = idx[buy], (held[buy], shares[buy], price[buy])
        apart = low[k] != high[k]
        low[k], top = _cost(low[k], *args), high[k]
        high[k] = low[k]
        if apart.any():
            high[k[apart]] = _cost(top[apart], *(v[apart] for v in args))
        t += 1
    for k in order[:live].tolist():
        part = slice(int(starts[k]) + t, int(starts[k] + sizes[k]))
        a, z, sure, total = float(low[k]), float(high[k]), bool(exact[k]), 0
        for buy, held, shares, price in zip(*(rows[n][part].tolist() for n in ("buy", "held", "shares", "price")), strict=True):
            if buy:
                apart = a != z
                a = round((held * a + shares * price) / (held + shares), 4) if held > 0 else round(price, 4)
                z = a if not apart else round((held * z + shares * price) / (held + shares), 4) if held > 0 else a
            elif sure and held > 0:
                total += round(round((price - a) * min(shares, held), 2) * 100)
        low[k], high[k] = a, z
        cents[k] += total
    return cents


_BLOCK = "sym string, block int, low double, high double, cents bigint"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered trades of (sym, unit) runs -> cost after each (sym, block), and its profit where the cost before it is known.

    A run starts with a cost between ``low0`` and ``high0``; a further block of
    it starts where the one before ended.
    """
    schema = pa.schema([("sym", pa.string()), ("block", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("cents", pa.int64())])
    carry: dict = {}  # what is known of the block that the last buffer ended in

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal carry
        table = table.combine_chunks()
        code = table.column(0).combine_chunks().dictionary_encode()
        names, sym = code.dictionary.to_pylist(), code.indices.to_numpy()
        unit, number, buy, price, shares, held0, low0, high0 = (table.column(i).to_numpy() for i in range(1, 9))
        changed = lambda *v: np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in v]))
        starts = np.nonzero(changed(sym, unit, number))[0]
        sizes = np.diff(np.append(starts, len(sym)))
        head = changed(sym, unit)[starts]  # blocks that begin a run
        turn = np.cumsum(head) - 1
        level = np.arange(len(starts)) - np.nonzero(head)[0][turn]  # blocks before it in its run
        signed = np.where(buy, shares, -shares)
        total = np.cumsum(signed) - signed
        base = held0[starts] - total[starts]
        low, high = low0[starts].astype(float), high0[starts].astype(float)
        known, cents = np.ones(len(starts), bool), np.zeros(len(starts), np.int64)
        first = (names[sym[0]], int(unit[0]))
        if carry.get("run") == first:  # goes on from the buffer before
            low[0], high[0] = carry["low"], carry["high"]
            if carry["block"] == int(number[0]):
                base[0], known[0], cents[0] = carry["held"] - total[0], carry["known"], carry["cents"]
                carry = {}
        if carry:
            yield row(carry)
        rows = {"buy": buy, "price": price, "shares": shares, "held": total + np.repeat(base, sizes)}
        for n in range(int(level.max()) + 1):
            now = np.nonzero(level == n)[0]
            if n:
                low[now], high[now] = low[now - 1], high[now - 1]
            known[now] &= low[now] == high[now]
            a, z = low[now], high[now]
            cents[now] += _advance(rows, starts[now], sizes[now], a, z)
            low[now], high[now] = a, z
        last = len(starts) - 1
        carry = {"sym": names[sym[-1]], "run": (names[sym[-1]], int(unit[-1])), "block": int(number[-1]), "low": float(low[last]), "high": float(high[last]),
                 "known": bool(known[last]), "cents": int(cents[last]), "held": int(rows["held"][-1] + signed[-1])}
        if last:
            yield pa.RecordBatch.from_arrays([
                pa.array([names[i] for i in sym[starts[:-1]]], pa.string()), pa.array(number[starts[:-1]], pa.int32()), pa.array(low[:-1]), pa.array(high[:-1]),
                pa.array(cents[:-1], mask=~known[:-1])], schema=schema)

    def row(c: dict) -> pa.RecordBatch:
        values = (c["sym"], c["block"], c["low"], c["high"], c["cents"] if c["known"] else None)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BUFFER:
                yield from work(pa.Table.from_batches(held))
                held = []
    if held:
        yield from work(pa.Table.from_batches(held))
    if carry:
        yield row(carry)


def _folded(log: DataFrame, units: DataFrame, cut: DataFrame | None) -> DataFrame:
    """Cost and profit of the blocks of ``units`` (sym, block, unit, held0, low0, high0); ``cut`` has the days of symbols with several."""
    rows = log.where(F.col("action").isin("BUY", "SELL"))
    if cut is None:
        rows = rows.join(units, "sym")
    else:
        rows = rows.join(cut, ["sym", "date"], "left").withColumn("block", F.coalesce("block", F.lit(0))).join(units, ["sym", "block"])
    rows = rows.repartition("sym", "unit").sortWithinPartitions("sym", "unit", "block", "date", "seq").select(
        "sym", "unit", "block", is_buy().alias("buy"), F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce(F.col("shares").cast("bigint"), F.lit(0)).alias("shares"), "held0", "low0", "high0")
    return rows.mapInArrow(_fold, _BLOCK)


def first_names(log: DataFrame, days: DataFrame) -> DataFrame:
    """(sym, name): the first name of a symbol that is not empty; its day is known, so one day's names are ordered."""
    day = days.where("named > 0").groupBy("sym").agg(F.min("date").alias("date"))
    named = log.where(F.coalesce(F.col("name"), F.lit("")) != "").select("sym", "date", "seq", "name")
    return named.join(day, ["sym", "date"]).groupBy("sym").agg(F.min_by("name", "seq").alias("name"))


def positions(trades: DataFrame, *, block_rows: int = 1_000_000) -> DataFrame:
    """Position state per symbol: weighted-average cost, realised profit, totals and status.

    With a ``name`` column, also the first name that is not empty.  Everything
    that adds up comes from sums per symbol and day.  For the rounded average a
    symbol's days are cut into blocks of about ``block_rows`` trades, so a hot
    symbol is folded by many tasks.  A block is folded from the lowest and the
    highest cost it may start with; where both end in one cost, that is the cost
    whatever came before.  Blocks whose start was open are then folded again
    from the cost that is known by now, side by side; a block that did not
    settle runs with the one behind it.  The profit of each sale is rounded to
    cents and added exactly; where it is half a cent, a total that is rounded at
    every sale may go the other way.
    """
    named = "name" in trades.columns
    log = trades.select("sym", "date", "seq", "action", "price", "shares", *(["name"] if named else []))
    sell = F.col("action") == "SELL"
    cents = F.round(F.col("shares") * F.col("price"), 2)
    price = F.when(is_buy(), F.round(F.col("price").cast("double"), 4))
    sum_if = lambda cond, c: F.sum(F.when(cond, c))
    days = publish(log.groupBy("sym", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(signed_shares()).cast("bigint").alias("s"), F.min(price).alias("low"), F.max(price).alias("high"),
        sum_if(is_buy(), F.col("shares")).alias("bought"), sum_if(sell, F.col("shares")).alias("sold"), sum_if(is_buy(), cents).alias("paid"), sum_if(sell, cents).alias("got"),
        F.count_if(is_buy()).alias("n_buy"), F.count_if(sell).alias("n_sell"), (F.count_if(F.coalesce(F.col("name"), F.lit("")) != "") if named else F.lit(0)).alias("named")), "trade-days")
    cutting = in_blocks(days, block_rows)
    before = Window.partitionBy("sym").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a cost lies between the prices paid before; wider by a digit, as both sides may round ties their own way
    blocks = cutting.groupBy("sym", "block").agg(F.sum("s").alias("_s"), F.min("low").alias("_low"), F.max("high").alias("_high")).select(
        "sym", "block", F.col("block").alias("unit"), F.coalesce(F.sum("_s").over(before), F.lit(0)).cast("bigint").alias("held0"),
        F.coalesce(F.min("_low").over(before) - 1e-4, F.lit(0.0)).alias("low0"), F.coalesce(F.max("_high").over(before) + 1e-4, F.lit(0.0)).alias("high0"))
    blocks = publish(blocks, "trade-units")  # one row per symbol and block
    several = blocks.where("block > 0").select("sym").distinct()
    if several.isEmpty():
        final = _folded(log, blocks.drop("block").withColumn("block", F.lit(0)), None)
    else:
        cut = publish(cutting.join(several, "sym", "left_semi").select("sym", "date", "block"), "trade-cuts")
        once = publish(_folded(log, blocks, cut), "trade-costs")
        settled = F.col("low") == F.col("high")
        state = once.withColumns({
            "chain": F.coalesce(F.count(F.when(settled, 1)).over(before), F.lit(0)).cast("int"), "start": F.last(F.when(settled, F.col("low")), ignorenulls=True).over(before)})
        open_ = publish(state.where("cents is null").join(blocks.select("sym", "block", "held0"), ["sym", "block"]).select(
            "sym", "block", F.col("chain").alias("unit"), "held0", F.col("start").alias("low0"), F.col("start").alias("high0")), "trade-open")
        final = once.where("cents is not null").unionByName(_folded(log, open_, cut))
    newest = final.groupBy("sym").agg(F.max_by("low", "block").alias("weighted_avg_cost"), (F.sum("cents") / 100.0).alias("realized_pnl"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = days.groupBy("sym").agg(
        F.sum("s").alias("net_shares"), zero("bought").alias("total_buy_shares"), zero("sold").alias("total_sell_shares"),
        F.round(zero("paid"), 2).alias("total_buy_cost"), F.round(zero("got"), 2).alias("total_sell_revenue"),
        F.max(F.when(F.col("n_buy") > 0, F.col("date"))).alias("last_buy_date"), F.max(F.when(F.col("n_sell") > 0, F.col("date"))).alias("last_sell_date"),
        F.max("date").alias("last_trade_date"), F.sum("n").alias("trade_count"))
    n = F.col("net_shares")
    status = F.when(n > 0, "holding").when(n < 0, "short").when(F.col("total_buy_shares") > 0, "closed").otherwise("none")
    out = totals.join(newest, "sym", "left").withColumn("status", status)
    return out.join(first_names(log, days), "sym", "left").fillna({"name": ""}) if named else out


def pnl(pos: DataFrame, closes: DataFrame) -> DataFrame:
    """Realised and floating profit, market value, cost basis (closes: sym, close)."""
    j = pos.join(closes, "sym", "left")
    held = F.col("net_shares") > 0
    value = F.when(held, F.col("net_shares") * F.col("close")).otherwise(0.0)
    basis = F.when(held, F.col("net_shares") * F.col("weighted_avg_cost")).otherwise(0.0)
    return j.withColumns({"market_value": value, "cost_basis": basis, "floating_pnl": F.coalesce(value - basis, F.lit(0.0))}).withColumn(
        "total_pnl", F.col("realized_pnl") + F.col("floating_pnl"))


def book_totals(valued: DataFrame) -> DataFrame:
    """One row: total cost, total value (cost where no price is known), holdings."""
    held = valued.where(F.col("net_shares") > 0)
    return held.agg(
        F.sum("cost_basis").alias("total_cost"), F.sum(F.coalesce("market_value", "cost_basis")).alias("total_value"), F.count(F.lit(1)).alias("n_holdings"))


def daily_flow(trades: DataFrame) -> DataFrame:
    """Net shares and cash per (symbol, day)."""
    cash = F.when(is_buy(), -F.col("price") * F.col("shares")).otherwise(F.col("price") * F.col("shares"))
    return trades.groupBy("sym", "date").agg(F.sum(signed_shares()).alias("d_shares"), F.sum(cash).alias("d_cash"))


def marked_value(holdings: DataFrame, closes: DataFrame, out: str = "market_value") -> DataFrame:
    """Market value of the book on every date something changes: date, ``out``.

    ``holdings``: sym, date, qty after the day; ``closes``: sym, date, close.
    Each symbol contributes the change of its value at its own change dates;
    summing changes per date and running the total gives the book without a
    symbol x calendar grid.
    """
    both = holdings.select("sym", "date", "qty", F.lit(None).cast("double").alias("close")).unionByName(
        closes.select("sym", "date", F.lit(None).cast(holdings.schema["qty"].dataType).alias("qty"), "close"))
    both = both.groupBy("sym", "date").agg(F.max("qty").alias("qty"), F.max("close").alias("close"))
    w = Window.partitionBy("sym").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(F.last("qty", ignorenulls=True).over(upto) * F.last("close", ignorenulls=True).over(upto), F.lit(0.0))
    # decimals: the changes telescope exactly, whatever the order of the sums
    both = both.withColumn("_v", value.cast("decimal(30,10)"))
    both = both.withColumn("_dv", F.col("_v") - F.coalesce(F.lag("_v", 1).over(w), F.lit(0)))
    days = both.groupBy("date").agg(F.sum("_dv").alias("_dv"))
    total = F.sum("_dv").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # one row per date
    return days.select("date", total.cast("double").alias(out))


def book_curve(trades: DataFrame, closes: DataFrame) -> DataFrame:
    """Daily market value, net invested cash and profit on the dates of trades and closes."""
    flow = daily_flow(trades)
    w = Window.partitionBy("sym").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = flow.select("sym", "date", F.sum("d_shares").over(w).alias("qty"))
    known = closes.join(trades.select("sym").distinct(), "sym", "left_semi")
    value = marked_value(held, known)
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cash = flow.groupBy("date").agg(F.sum("d_cash").alias("_c"))
    curve = value.join(cash, "date", "full_outer").withColumns({
        "market_value": F.last("market_value", ignorenulls=True).over(run), "cost_basis": -F.sum(F.coalesce("_c", F.lit(0.0))).over(run)})
    return curve.select("date", "market_value", "cost_basis", (F.col("market_value") - F.col("cost_basis")).alias("pnl"))


def clamped_lots(log: DataFrame, lot: int = 100) -> DataFrame:
    """Lots held after each (symbol, day) when a sale never goes below zero.

    With S the running sum of signed lots, the clamped holding is
    S - min(0, lowest S so far).  Sum and lowest prefix of a day are windows
    over that day; days are combined by windows over (symbol, day) rows.
    """
    valid = log.where(F.col("price") > 0)
    step = F.when(is_buy(), lot).when(F.col("action") == "SELL", -lot).otherwise(0)
    in_day = Window.partitionBy("sym", "date").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    steps = valid.withColumn("_s", step).withColumn("_p", F.sum("_s").over(in_day))
    days = steps.groupBy("sym", "date").agg(F.sum("_s").alias("_d"), F.min("_p").alias("_low"))
    w = Window.partitionBy("sym").orderBy("date")
    days = days.withColumn("_end", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("_floor", F.min(F.col("_end") - F.col("_d") + F.col("_low")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return days.select("sym", "date", (F.col("_end") - F.least(F.lit(0), F.col("_floor"))).alias("qty"))


def nav_series(log: DataFrame, closes: DataFrame, *, capital: float = 100000.0, lot: int = 100) -> DataFrame:
    """cash + sum of lots x last close, on close dates from the first trade on: date, nav."""
    first = log.agg(F.min("date").alias("_first"))
    cash = log.where(F.col("price") > 0).groupBy("date").agg(
        F.sum(F.when(is_buy(), -F.col("price")).when(F.col("action") == "SELL", F.col("price")).otherwise(0.0) * lot).alias("_c"))
    known = with_global(closes.join(log.select("sym").distinct(), "sym", "left_semi"), first).where(F.col("date") >= F.col("_first")).drop("_first")
    mark = marked_value(clamped_lots(log, lot), known, "_mark")
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = known.groupBy("date").agg(F.lit(1).alias("_open"))
    j = mark.join(cash, "date", "full_outer").join(days, "date", "left")
    j = j.withColumns({"_m": F.coalesce(F.last("_mark", ignorenulls=True).over(run), F.lit(0.0)), "_k": F.sum(F.coalesce("_c", F.lit(0.0))).over(run)})
    return j.where(F.col("_open") == 1).select("date", (F.lit(float(capital)) + F.col("_k") + F.col("_m")).alias("nav"))


def replay_curve(log: DataFrame, closes: DataFrame) -> DataFrame:
    """Equal-weight curve of the names held by a signal log: date, n_held, ret, cum_return.

    A day's sales come before its buys, so a name bought on a day is held after it.
    """
    acts = log.where(F.col("action").isin("BUY", "SELL")).groupBy("sym", "date").agg(F.bool_or(is_buy()).alias("held"))
    span = log.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    marks = with_global(closes.where(F.col("close").isNotNull()), span).where((F.col("date") >= F.col("_a")) & (F.col("date") <= F.col("_b"))).drop("_a", "_b")
    hit = asof(marks, acts, ["held"], key="sym").where(F.col("held"))
    w = Window.partitionBy("sym").orderBy("date")
    prev = F.lag("close", 1).over(w)
    hit = hit.withColumn("_r", F.when(prev > 0, F.col("close") / prev - 1.0))
    per = hit.groupBy("date").agg(F.count(F.lit(1)).alias("n_held"), F.coalesce(F.avg("_r"), F.lit(0.0)).alias("ret"))
    days = marks.select("date").distinct().join(per, "date", "left").fillna({"n_held": 0, "ret": 0.0})
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("cum_return", F.product(1.0 + F.col("ret")).over(run) - 1.0)


def daily_pnl(log: DataFrame, closes: DataFrame, lot: int = 100) -> DataFrame:
    """Yesterday's lots x change of close, summed per date: date, pnl."""
    step = F.when(is_buy(), 1).when(F.col("action") == "SELL", -1).otherwise(0)
    per = log.groupBy("sym", "date").agg(F.sum(step).alias("_d"))
    w = Window.partitionBy("sym").orderBy("date")
    held = per.select("sym", "date", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("qty"))
    marks = closes.join(log.select("sym").distinct(), "sym", "left_semi").withColumn("_dc", F.col("close") - F.lag("close", 1).over(w)).where(F.col("_dc").isNotNull())
    hit = asof(marks, held, ["qty"], key="sym", strict=True)
    gain = F.when(F.col("qty") > 0, F.col("qty") * F.col("_dc") * lot).otherwise(0.0)
    return hit.groupBy("date").agg(F.sum(gain).alias("pnl"))


def action_items(pos: DataFrame, picks: DataFrame, closes: DataFrame, today: Column) -> DataFrame:
    """Per symbol: stop breached, near stop, new or stale recommendation (picks: sym, stop_loss, rec_date, recommended)."""
    j = picks.join(pos.select("sym", "net_shares"), "sym", "full_outer").join(closes, "sym", "left")
    held = F.coalesce(F.col("net_shares") > 0, F.lit(False))
    c, stop = F.col("close"), F.col("stop_loss")
    kind = (
        F.when(held & (c < stop), "stop_breached").when(held & (c < stop * 1.05), "near_stop")
        .when(~held & F.col("recommended") & (F.col("rec_date") == today), "new_recommendation")
        .when(~held & F.col("recommended"), "stale_recommendation")
    )
    rank = F.when(kind == "stop_breached", 0).when(kind == "near_stop", 1).when(kind == "new_recommendation", 2).otherwise(3)
    return j.select("sym", kind.alias("kind"), rank.alias("priority"), div(c, stop).alias("_q")).where(F.col("kind").isNotNull()).withColumn(
        "gap_pct", (F.col("_q") - 1.0) * 100.0).drop("_q")


