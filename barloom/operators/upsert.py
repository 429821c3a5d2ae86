"""Keyed merges of a stored table with new rows.

The stored side is only anti-joined: a day's increment is small, and Spark
broadcasts it by measured size, so the big table is not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.tables import first_per_key, newest_per_key


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], *, order: Sequence[str]) -> DataFrame:
    """New row wins; of several new rows of one key the last in ``order``."""
    fresh = newest_per_key(new, keys, order)
    return old.join(fresh, list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str], *, order: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet (the stored row wins), the first in ``order`` of each key; append these."""
    fresh = first_per_key(new, keys, order)
    return fresh.join(old.select(*keys), list(keys), "left_anti")


def upsert_protected(old: DataFrame, new: DataFrame, keys: Sequence[str], protected: DataFrame, *, order: Sequence[str], required: Sequence[str] = ("date", "close"), key: str = "code") -> DataFrame:
    """Upsert that leaves protected symbols alone and ignores incomplete new rows."""
    usable = new.dropna(subset=list(required)).join(protected.select(key), key, "left_anti")
    return upsert(old, usable, keys, order=order).dropna(subset=list(required))


def keep_largest(parts: Sequence[DataFrame], keys: Sequence[str], by: str = "close") -> DataFrame:
    """Union of the parts with the row of the largest ``by`` per key; the other columns, in their order, break ties."""
    alls = parts[0]
    for p in parts[1:]:
        alls = alls.unionByName(p)
    return newest_per_key(alls, keys, [by, *(c for c in alls.columns if c != by and c not in keys)])


def stitch(main: DataFrame, backfill: DataFrame, cut: Column, *, keys: Sequence[str] = ("code", "date"), date: str = "date") -> DataFrame:
    """Backfill before the cut, main rows before it that the backfill lacks, main from it on."""
    early = backfill.where(F.col(date) < cut)
    gaps = main.where(F.col(date) < cut).join(early.select(*keys), list(keys), "left_anti")
    return early.unionByName(gaps, allowMissingColumns=True).unionByName(main.where(F.col(date) >= cut), allowMissingColumns=True)


def needs_refresh(universe: DataFrame, table: DataFrame, today: Column, stale_days: int) -> DataFrame:
    """Codes without rows, or whose newest row is older than allowed."""
    last = table.groupBy("code").agg(F.max("date").alias("last_date"))
    j = universe.select("code").distinct().join(last, "code", "left")
    return j.where(F.col("last_date").isNull() | (F.datediff(today, "last_date") > stale_days))
