"""Cases beside the small tables: ratios to nothing, boards by prefix, numbered trades, layouts."""

import datetime as dt
import math

from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import metrics as M
from barloom.operators import trades as P
from barloom.sources import readers, sinks


def test_attribution_without_losses(spark):
    """Ratios to nothing are infinite, as in the SQL of metric_attribution."""
    gains = [("g", i, 0.01 * i, 0.02 * (i % 3)) for i in range(1, 9)]
    flat = [("z", i, 0.0, 0.01 * (i % 3)) for i in range(1, 9)]
    df = spark.createDataFrame(gains + flat, "variant string, date int, ret double, b double")
    got = {r.variant: r for r in M.attribution(df, "ret", "b", ["variant"]).collect()}
    assert got["g"].sortino == math.inf and got["g"].omega == math.inf and math.isfinite(got["g"].tail_ratio)
    assert all(math.isnan(got["z"][c]) for c in ("sortino", "omega", "tail_ratio", "stability"))


def test_boards_of_coverage_go_by_two_digits(spark):
    codes = ["600001", "688001", "004000", "000001", "305000", "300001", "830000", "64"]
    df = spark.createDataFrame([(c,) for c in codes], "code string").select("code", S.board_by_head(F.col("code")).alias("b"))
    assert dict(df.collect()) == {
        "600001": "沪主板", "688001": "其他", "004000": "深主板", "000001": "深主板", "305000": "创业板", "300001": "创业板", "830000": "其他", "64": "其他"}


def test_trades_are_numbered_over_all_days(spark):
    """Every row counts, the rejected ones of proj_validate_trades as well as the others."""
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 2), None]
    rows = [(s, d, i) for s in ("a", "b", None) for d in days for i in range(4 if s == "a" else 1)]
    df = spark.createDataFrame(rows[::-1], "sym string, date date, seq int")
    got = {(r.sym, r.date, r.seq): r.n for r in P.numbered(df).collect()}
    assert [got["a", d, i] for d in days for i in range(4)] == list(range(1, 13))
    assert [got[None, d, 0] for d in days] == [got["b", d, 0] for d in days] == [1, 2, 3]


def test_directories_do_not_grow_with_the_symbols(spark, tmp_path):
    df = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("code"), F.lit("2020-01-01").cast("date").alias("date"), F.col("id").alias("v"))
    path = f"{tmp_path}/t"
    sinks.write_grouped(df, path)
    assert 0 < len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) <= readers.GROUPS
    back = spark.read.schema("code string, date date, v bigint, key_group int").parquet(path)
    assert back.count() == 3000
    one = readers.symbol(back, "000007")
    assert [r.v for r in one.collect()] == [7]
    assert "PartitionFilters: [isnotnull(key_group" in one._jdf.queryExecution().toString()


def test_tasks_of_a_write_are_bounded(spark, tmp_path, monkeypatch):
    """Small parts share tasks; a task reports to the driver whatever it writes."""
    monkeypatch.setattr(sinks, "MOST_TASKS", 20)
    df = spark.range(5000).select((F.col("id") % 2).alias("key"), "id")
    sinks.write_partitioned(df, f"{tmp_path}/t", ["key"], rows=10, sort=["id"])
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 5000 and back.select(F.input_file_name()).distinct().count() <= 2 * 24


def test_a_csv_file_for_each_key(spark, tmp_path):
    """lines and directories are those of Spark's own writer, but a key costs one file and no process."""
    rows = [("a/b", 2, "x,y", 1e20), ("a/b", 1, 'say "so"', math.nan), ("k=1", 1, None, None), ("é {[^]}", 1, "", -0.0), ("100%", 1, " padded ", 0.1), (None, 1, "back\\slash", 3.0), ("", 1, "none", 2.5)]
    df = spark.createDataFrame(rows, "key string, n int, word string, v double").withColumns({"day": F.lit("2020-02-29").cast("date"), "at": F.lit("2020-02-29 12:00:00.5").cast("timestamp")})
    ours, theirs = tmp_path / "ours", tmp_path / "theirs"
    df.repartition("key").sortWithinPartitions("key", "n").write.partitionBy("key").option("header", True).csv(str(theirs))
    for _ in range(2):  # the second run replaces the first
        sinks.write_csv_per_key(df, str(ours), "key", sort=["n"])
    content = lambda root: {d.name: sorted(line for f in d.glob("part-*.csv") for line in f.read_bytes().splitlines()) for d in root.iterdir() if d.is_dir()}
    assert content(ours) == content(theirs) and len(content(ours)) == 5
    assert [p.name for d in ours.iterdir() if d.is_dir() for p in d.iterdir()] == ["part-00000.csv"] * 5
    assert (ours / "key=a%2Fb" / "part-00000.csv").read_text().splitlines()[1].startswith("1,")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["ours", "theirs"] and (ours / "_SUCCESS").exists()


def test_directories_of_keys_are_listed_by_few_tasks(spark, tmp_path):
    """a task listed one directory each before."""
    df = spark.range(600).select(F.col("id").alias("v"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("symbol"))
    sinks.write_csv_per_key(df, f"{tmp_path}/t", "symbol")
    tracker = spark.sparkContext.statusTracker()
    seen = set(tracker.getJobIdsForGroup())
    back = readers.csv_per_key(spark, f"{tmp_path}/t", "v long, symbol string")
    tasks = [tracker.getStageInfo(s).numTasks for j in set(tracker.getJobIdsForGroup()) - seen for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert back.where("symbol = concat('S', v)").count() == 600
    assert spark.conf.get(readers.LISTING) == "10000"


def test_no_rows_make_an_empty_export(spark, tmp_path):
    df = spark.createDataFrame([], "v int, symbol string")
    sinks.write_csv_per_key(df, f"{tmp_path}/t", "symbol")
    assert [p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")] == ["_SUCCESS"]
