"""Streams that stop and start again, batches that come twice, partitions that stay closed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.streaming import bars as SB
from barloom.streaming import positions as SP
from barloom.streaming.state import PROVIDER, read_version, versions

DAY = dt.datetime(2024, 1, 1)
TRADE = "sym string, action string, price double, shares bigint, recorded_at timestamp"
BAR = "code string, datetime timestamp, close double, volume bigint"


def trades(n, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "a", "b"]), rng.choice(["BUY", "BUY", "SELL"]), rng.uniform(1, 90), rng.randrange(1, 200), DAY + dt.timedelta(minutes=i)) for i in range(n)]


def fold(log):
    state = {}
    for sym, action, price, shares, _ in log:
        held, cost, realized, n = state.get(sym, (0, 0.0, 0.0, 0))
        if action == "BUY":
            cost = round((held * cost + shares * price) / (held + shares), 4) if held > 0 else round(price, 4)
            held += shares
        else:
            sold = min(shares, max(held, 0))
            if sold > 0:
                realized = round(realized + (price - cost) * sold, 2)
            held -= shares
        state[sym] = (held, cost, realized, n + 1)
    return state


def test_positions_go_on_from_the_checkpoint(spark, tmp_path):
    log, seen = trades(400), {}

    def save(batch, batch_id):
        seen.update({r.sym: (batch_id, r) for r in batch.collect()})

    before = spark.conf.get(PROVIDER, None)
    for part in (log[:150], log[150:151], log[151:]):
        rows = part[:]
        random.Random(1).shuffle(rows)  # a batch is folded in order of time, however it arrives
        spark.createDataFrame([*rows, (None, "BUY", 1.0, 1, DAY), ("a", "BUY", None, 1, DAY)], TRADE).write.mode("append").parquet(f"{tmp_path}/feed")
        stream = spark.readStream.schema(TRADE).parquet(f"{tmp_path}/feed")
        SP.follow_positions(stream, save, f"{tmp_path}/ckpt").awaitTermination()
    assert spark.conf.get(PROVIDER, None) == before
    got = {k: (r.net_shares, r.weighted_avg_cost, r.realized_pnl, r.trade_count) for k, (_, r) in seen.items()}
    want = fold(log)
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9)


def test_live_view_goes_on_from_the_checkpoint(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(4)}", DAY + dt.timedelta(minutes=rng.randrange(200)), rng.uniform(1, 9), i) for i in range(500)]
    rows += [("single", DAY, 2.0, 0)]
    newest = {}
    for k, part in enumerate((rows[:200], rows[200:210], rows[210:])):
        spark.createDataFrame([*part, (None, DAY, 1.0, 1), ("c0", None, 1.0, 1)], BAR).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        SB.live_view_stream(spark.readStream.schema(BAR).parquet(f"{tmp_path}/feed"), f"{tmp_path}/view", f"{tmp_path}/ckpt", n=5).awaitTermination()
        batch = {}
        for code, at, close, volume in part:
            x = (f"{close}|{volume}", close)
            batch[code, at] = max(batch.get((code, at), x), x)
        for (code, at), (_, close) in batch.items():  # a bar older than the kept ones stays out
            held = newest.setdefault(code, {})
            held[at] = close
        for code in newest:
            newest[code] = dict(sorted(newest[code].items())[-5:])
        got = {r.code: r for r in read_version(spark, f"{tmp_path}/view").collect()}
        assert set(got) == set(newest)
        for code, held in newest.items():
            assert got[code].spark == pytest.approx(list(held.values())) and got[code].close == list(held.values())[-1]
            closes = list(held.values())
            assert got[code].ret == (pytest.approx(closes[-1] / closes[-2] - 1) if len(closes) > 1 else None)
    assert len(versions(spark, f"{tmp_path}/view")) <= 3


def daily(spark, rows):
    return spark.createDataFrame([(c, dt.date(2024, 1, d), x) for c, d, x in rows], "code string, date date, close double")


def test_daily_merge_opens_only_touched_days_and_once(spark, tmp_path):
    main, feed, ckpt = f"{tmp_path}/main", f"{tmp_path}/feed", f"{tmp_path}/ckpt"
    daily(spark, [("a", d, 1.0) for d in range(1, 10)] + [("b", d, 2.0) for d in range(1, 10)]).write.partitionBy("date").parquet(main)
    for f in (tmp_path / "main" / "date=2024-01-03").iterdir():
        f.chmod(0o600)
        f.write_bytes(b"not a table" if f.name.startswith("part") else b"")  # fails whoever opens it
    daily(spark, [("a", 5, 9.0), ("c", 12, 3.0)]).write.parquet(feed)
    schema = daily(spark, []).schema
    run = lambda: SB.daily_merge(spark.readStream.schema(schema).parquet(feed), main, ckpt, order=["close"]).awaitTermination()
    run()
    rows = lambda: {(r.code, r.date.day): r.close for r in spark.read.schema(schema).parquet(main).where("date <> date'2024-01-03'").collect()}
    want = {(c, d): x for c, x in (("a", 1.0), ("b", 2.0)) for d in range(1, 10) if d != 3} | {("a", 5): 9.0, ("c", 12): 3.0}
    assert rows() == want
    # the stream forgets that it has done the batch; the merge does not
    (tmp_path / "ckpt" / "commits" / "0").unlink()
    for f in (tmp_path / "ckpt" / "commits").glob(".0*"):
        f.unlink()
    daily(spark, [("a", 5, 8.0)]).write.mode("overwrite").partitionBy("date").option("partitionOverwriteMode", "dynamic").parquet(main)  # a later correction
    run()
    assert rows() == {**{k: v for k, v in want.items() if k != ("b", 5)}, ("a", 5): 8.0}


def test_touched_days_are_in_the_plan(spark, tmp_path):
    path = f"{tmp_path}/t"
    daily(spark, [("a", d, 1.0) for d in range(1, 29)]).write.partitionBy("date").parquet(path)
    stored, batch = spark.read.parquet(path), daily(spark, [("x", 4, 1.0), ("y", 9, 1.0), ("z", 9, 1.0)])
    near = SB.touched(stored, batch, "date")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [date" in plan and "2024-01-04" in plan and "Join" not in plan
    assert sorted(r.date.day for r in near.collect()) == [4, 9]
    assert SB.touched(stored, batch.limit(0), "date").count() == 0
    old, SB.LISTED = SB.LISTED, 1
    try:
        wide = SB.touched(stored, batch, "date")
    finally:
        SB.LISTED = old
    assert sorted(r.date.day for r in wide.collect()) == [4, 9]
    assert wide.select(F.max("date")).first()[0].day == 9


@pytest.mark.parametrize("groups", [1, 3])
def test_positions_share_state_by_groups(spark, tmp_path, monkeypatch, groups):
    """a key of state for each symbol before; symbols of a group keep apart, also those a batch does not touch."""
    monkeypatch.setattr(SP, "GROUPS", groups)
    log, seen = trades(300, seed=5), {}
    log += [("quiet", "BUY", 3.0, 7, DAY)]
    parts = [[r for r in log if r[0] in ("quiet", "a")], [r for r in log if r[0] in ("hot", "b")], [("a", "SELL", 50.0, 3, DAY + dt.timedelta(days=9))]]
    changed, keys = [], []

    def save(batch, batch_id):
        rows = batch.collect()
        changed.append({r.sym for r in rows})
        seen.update({r.sym: (r.net_shares, r.weighted_avg_cost, r.realized_pnl, r.trade_count) for r in rows})

    for part in parts:
        spark.createDataFrame(part, TRADE).write.mode("append").parquet(f"{tmp_path}/feed")
        q = SP.follow_positions(spark.readStream.schema(TRADE).parquet(f"{tmp_path}/feed"), save, f"{tmp_path}/ckpt")
        q.awaitTermination()
        keys += [o.numRowsTotal for p in q.recentProgress for o in p.stateOperators]
    assert changed == [{"quiet", "a"}, {"hot", "b"}, {"a"}] and max(keys) <= groups
    want = fold([r for part in parts for r in sorted(part, key=lambda r: r[4])])
    assert set(seen) == set(want) and seen["quiet"] == (7, 3.0, 0.0, 1)
    for k, w in want.items():
        assert seen[k] == pytest.approx(w, abs=1e-9)
