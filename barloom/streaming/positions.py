"""Continuous positions from appended trades, and gate events."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barloom.streaming.state import start

OUT = "sym string, net_shares bigint, weighted_avg_cost double, realized_pnl double, trade_count bigint"
STATE = "sym string, net_shares bigint, cost double, cents bigint, trades bigint"
#: Groups of symbols of a stream; a checkpoint keeps the number it began with.
GROUPS = 4096


class Position(StatefulProcessor):
    """Folds the new trades of a group of symbols into four numbers of state for each of them.

    A call, a reading and a writing of state, and a batch of results go with
    every group; for every symbol they take longer than its trades do.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("positions", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = {sym: rest for sym, *rest in self.state.get()}
        # five scalars of each of the batch's trades; the source's batch size bounds them
        log = sorted(itertools.chain.from_iterable(zip(*(frame[c].tolist() for c in ("sym", "at", "action", "price", "shares"))) for frame in rows))
        out = []
        for sym, trades in itertools.groupby(log, key=lambda r: r[0]):
            held, cost, cents, n = kept.get(sym, (0, 0.0, 0, 0))
            for _, _, action, price, shares in trades:
                n += 1
                if action == "BUY":
                    cost = round((held * cost + shares * price) / (held + shares), 4) if held > 0 else round(price, 4)
                    held += shares
                elif action == "SELL":
                    sold = min(shares, max(held, 0))
                    if sold > 0:
                        cents += round(round((price - cost) * sold, 2) * 100)
                    held -= shares
            kept[sym] = (held, cost, cents, n)
            out.append((sym, held, cost, cents / 100.0, n))
        self.state.put([(sym, *rest) for sym, rest in kept.items()])
        yield pd.DataFrame(out, columns=["sym", "net_shares", "weighted_avg_cost", "realized_pnl", "trade_count"])


def live_positions(trades: DataFrame) -> DataFrame:
    """Updated position per symbol after every micro-batch; a batch holds only new trades.

    The trades of a batch are taken in the order of ``recorded_at`` (then
    action, price, shares); a trade that arrives in a later batch counts as
    later.  State lies in ``GROUPS`` hashed groups of symbols; a batch writes
    those that it has trades for.  Limit a source's batches
    (``maxFilesPerTrigger``) where a backlog may hold more trades of one group
    than a worker has memory for.
    """
    narrow = trades.selectExpr("sym", "action", "cast(price as double) price", "cast(shares as bigint) shares", "unix_micros(cast(recorded_at as timestamp)) at").where("sym is not null and price is not null and shares is not null and at is not null")
    return narrow.withColumn("symbols", F.pmod(F.xxhash64("sym"), F.lit(GROUPS))).groupBy("symbols").transformWithStateInPandas(Position(), OUT, "Update", "None")


def follow_positions(trades: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``live_positions`` over what has arrived; ``save`` takes each batch's changed positions.

    State and progress lie in the checkpoint: started again, it goes on where it stopped.
    """
    return start(live_positions(trades).writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True), trades.sparkSession)


def emit_events(gates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append failed gate rows as events."""
    return gates.where("not ok").writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
