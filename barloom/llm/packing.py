"""Packing documents into sequences of fixed length.

Pieces of full length are sequences of their own.  The others are dealt by a
hash into shards of bounded size, and every shard is packed by a grouping
genetic algorithm on several islands, one task each:

* an individual is a partition of the shard's pieces into bins;
* crossover injects a random choice of one parent's well-filled bins whole into
  the other, removes the bins that held any of those pieces, and puts the
  displaced pieces back by best fit, longest first;
* fitness is the number of bins, then the mean squared fill;
* after each epoch the island's elite travels to the next island of the shard.

The best elite of a shard is its packing.  Islands stop early at the lower
bound, the total length over the capacity.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import slices
from barloom.llm.tokens import encoder
from barloom.sources.sinks import publish


class Bins:
    """Bins by free space; the tightest fit is found on a bit mask of the free spaces in use."""

    def __init__(self, capacity: int, bins: Iterable[tuple[int, list[int]]] = ()):
        self.capacity = capacity
        self.by_free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for free, items in bins:
            self.add(free, items)

    def add(self, free: int, items: list[int]) -> None:
        self.by_free[free].append(items)
        self.mask |= 1 << free

    def best_fit(self, item: int, size: int) -> None:
        fitting = self.mask >> size
        if not fitting:
            self.add(self.capacity - size, [item])
            return
        free = size + (fitting & -fitting).bit_length() - 1
        here = self.by_free[free]
        items = here.pop()
        if not here:
            self.mask &= ~(1 << free)
        items.append(item)
        self.add(free - size, items)

    def groups(self) -> list[tuple[int, list[int]]]:
        return [(free, items) for free, here in enumerate(self.by_free) for items in here]


def pack_best_fit(sizes: list[int], order: Iterable[int], capacity: int) -> list[tuple[int, list[int]]]:
    b = Bins(capacity)
    for i in order:
        b.best_fit(i, sizes[i])
    return b.groups()


def fitness(groups: list[tuple[int, list[int]]], capacity: int) -> tuple[int, float]:
    """Smaller is better: bins, then minus the mean squared fill."""
    return len(groups), -sum((capacity - f) ** 2 for f, _ in groups) / max(1, len(groups))


def crossover(
    base: list[tuple[int, list[int]]], donor: list[tuple[int, list[int]]], sizes: list[int], capacity: int, rng: random.Random,
) -> list[tuple[int, list[int]]]:
    """Child of two partitions: the donor's well-filled bins whole, the rest of ``base``, displaced pieces by best fit."""
    full = max(1, capacity // 64)
    given = [(f, items) for f, items in donor if f <= full and rng.random() < 0.5]
    taken = {i for _, items in given for i in items}
    child, displaced = [(f, list(items)) for f, items in given], []
    for f, items in base:
        if taken.isdisjoint(items):
            if f <= full or rng.random() < 0.5:  # open bins are broken up now and then, so that they can mix
                child.append((f, list(items)))
            else:
                displaced.extend(items)
        else:
            displaced.extend(i for i in items if i not in taken)
    displaced.sort(key=lambda i: -sizes[i])
    b = Bins(capacity, child)
    for i in displaced:
        b.best_fit(i, sizes[i])
    return b.groups()


def evolve(
    sizes: list[int], capacity: int, seeds: list[list[tuple[int, list[int]]]], rng: random.Random, population: int, generations: int,
) -> list[tuple[int, list[int]]]:
    """Best partition after some generations; ``seeds`` are elites to start from."""
    lowest = -(-sum(sizes) // capacity)
    items = range(len(sizes))
    people = list(seeds)
    if not people:
        people.append(pack_best_fit(sizes, sorted(items, key=lambda i: -sizes[i]), capacity))
    while len(people) < population and min(len(p) for p in people) > lowest:
        noise = [s * (1 + 0.2 * rng.random()) for s in sizes]
        people.append(pack_best_fit(sizes, sorted(items, key=lambda i: -noise[i]), capacity))
    for _ in range(generations):
        people.sort(key=lambda p: fitness(p, capacity))
        if len(people[0]) <= lowest or len(people) < 2:
            break
        base, donor = rng.sample(people, 2)
        child = crossover(base, donor, sizes, capacity, rng)
        if fitness(child, capacity) < fitness(people[-1], capacity):
            people[-1] = child
    return min(people, key=lambda p: fitness(p, capacity))


def pieces(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2) -> DataFrame:
    """(row, id, piece, start, length, ids_crc32): documents' ids and ``end``, cut into pieces.

    Only documents longer than the capacity are cut; the first piece takes what
    is over.  Null texts are empty and consist of ``end`` alone.
    """
    names = ("row", "id", "piece", "start", "length", "ids_crc32")
    schema = pa.schema([(n, pa.int64() if n != "piece" else pa.int32()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(tokenizer), (TaskContext.get().partitionId() << 36) - 1
        for b in slices(batches):
            out: list[tuple] = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.append(enc.ids(t.as_py() or ""), np.array([end], "<u4")).tobytes()
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row += 1
                    out.append((row, doc, k, a, z - a, zlib.crc32(raw[4 * a:4 * z])))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text)).mapInArrow(
        run, "row long, id long, piece int, start long, length long, ids_crc32 long")


def pack(
    items: DataFrame, *, row: str = "row", length: str = "length", capacity: int = 1024, shard_items: int = 4096,
    islands: int = 3, epochs: int = 2, population: int = 4, generations: int = 8, seed: int = 5,
) -> DataFrame:
    """Place of every item: (row, sequence_id, offset).

    ``row`` must be unique and lengths between 1 and the capacity.  Read the
    items from a written table: rows are looked up in it several times.
    """
    full = items.where(F.col(length) == capacity).select(
        F.col(row).alias("row"), (-F.col(row) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col(length) < capacity).select(F.col(row).alias("row"), F.col(length).cast("int").alias("length"))
    shards = max(1, -(-rest.count() // shard_items))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)).cast("int"))
    schema = "shard int, island int, row long, length int, bin int, bins int, fill double"

    def epoch(n: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
            rng = random.Random(f"{seed} {shard} {island} {n}")
            pdf = pdf.sort_values(["origin", "row"], kind="stable")
            one = pdf[pdf["origin"] == pdf["origin"].iloc[0]]
            rows, sizes = one["row"].to_numpy(), one["length"].tolist()
            seeds = []
            if n:
                for _, part in pdf.groupby("origin", sort=True):
                    bins: dict[int, list[int]] = {}
                    for i, b in enumerate(part["bin"].tolist()):
                        bins.setdefault(b, []).append(i)
                    seeds.append([(capacity - sum(sizes[i] for i in g), g) for g in bins.values()])
            best = evolve(sizes, capacity, seeds, rng, population, generations)
            bin_of = np.empty(len(sizes), np.int64)
            for k, (_, g) in enumerate(best):
                bin_of[g] = k
            count, fill = fitness(best, capacity)
            return pd.DataFrame({"shard": shard, "island": island, "row": rows, "length": sizes, "bin": bin_of, "bins": count, "fill": fill})

        return run

    people = rest.select("shard", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "row", "length", F.lit(-1).alias("bin"), F.lit(0).alias("origin"))
    for n in range(epochs):
        elite = people.groupBy("shard", "island").applyInPandas(epoch(n), schema)
        if n < epochs - 1:
            elite = publish(elite, "pack-elites")
            cols = ["shard", "row", "length", "bin"]
            own = elite.select("island", *cols, F.lit(0).alias("origin"))
            guest = elite.select(((F.col("island") + 1) % islands).alias("island"), *cols, F.lit(1).alias("origin"))
            people = own.unionByName(guest) if islands > 1 else own
    elite = publish(elite, "pack-best")
    best = elite.groupBy("shard").agg(F.min(F.struct("bins", "fill", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    inside = Window.partitionBy("shard", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    packed = elite.join(best, ["shard", "island"]).select(
        "row", (F.shiftleft(F.col("shard").cast("long"), 32) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", capacity: int = 1024, **options) -> DataFrame:
    """Pieces of all documents with their place: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Every row gives pieces, also repeated ones; an empty table gives none.
    """
    cut = publish(pieces(docs, tokenizer, id=id, text=text, capacity=capacity), "pack-pieces")
    placed = pack(cut, capacity=capacity, **options)
    return cut.join(placed, "row").drop("row").withColumnRenamed("id", id)
