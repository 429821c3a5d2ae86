"""Near-duplicate documents by MinHash.

1. One pass over the texts makes, per row, the set of word shingles, its
   128-bit digest and the minima of many universal hash functions.
2. Rows with one digest have the same set; the first stands for all of them.
3. Minima are cut into bands.  In each bucket every member is compared with
   the first one: sizes, then signatures, then the full sets.
4. Components of these links.  Buckets whose members still lie in several
   components are compared throughout, but only between components.  A large
   bucket is cut into blocks, one task for each pair of blocks, so no bucket
   has to fit in a task and no pair is a row: tasks return confirmed links.
5. Components of all links.

With ``rows`` minima per band and ``bands`` bands, a pair at the threshold t is
missed with probability (1 - t^rows)^bands, 1.3e-7 for 0.85, 5 and 28.
Signatures reject pairs 3.6 standard errors below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import input_tasks, keep_rows, slices
from barloom.llm.components import connected_components
from barloom.sources.sinks import publish


@dataclass(frozen=True)
class MinHash:
    """Parameters; ``percent`` is the least similarity in hundredths."""

    words: int = 5
    percent: int = 85
    rows: int = 5
    bands: int = 28
    seed: int = 11
    block: int = 1024

    @property
    def size(self) -> int:
        return self.rows * self.bands

    @property
    def agree(self) -> int:
        """Equal minima that a linked pair has, but for one in several thousand at the very threshold."""
        t = self.percent / 100
        return int(self.size * t - 3.6 * (self.size * t * (1 - t)) ** 0.5)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def normal_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], k: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct runs of k words; of the whole text if it is shorter."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    w = min(k, n)
    out = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i:n - w + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Low 16 bits of the smallest value of each hash (a * x + b) / 2^32 over the 32-bit x of the set."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    x = (found >> np.uint64(32))[:, None]
    for i in range(0, len(x), 256):
        np.minimum(low, (x[i:i + 256] * a + b).min(0) >> np.uint64(32), out=low)
    return low.astype("<u2")


def _sets(p: MinHash):
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("minima", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(p.seed)
        a = rng.integers(1, 1 << 63, p.size, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, p.size, np.uint64) * np.uint64(2)
        known, pack = _WordHash(), zstandard.ZstdCompressor(level=1).compress
        row = (TaskContext.get().partitionId() << 36) - 1
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for t in batch.column(1):
                row += 1
                words = normal_words(t.as_py())
                s = shingles(words, p.words, known)
                for col, v in zip(out, (row, len(s), xxhash.xxh3_128_digest(s.tobytes()), minima(s, a, b).tobytes() if len(s) else None, pack(b" ".join(words)) if len(s) else None), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)] + [pa.array(c, f.type) for c, f in zip(out, list(schema)[2:], strict=True)], schema=schema)

    return run


def overlap_linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(p: MinHash):
    """Arrow pass over candidate pairs: sizes, signatures, full sets."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack, kept = _WordHash(), zstandard.ZstdDecompressor().decompress, {}

        def full(row: int, words: bytes) -> np.ndarray:
            if row not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[row] = shingles(unpack(words).split(), p.words, known)
            return kept[row]

        for b in batches:
            u, v, nu, nv = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            good = (100 * np.minimum(nu, nv) >= p.percent * np.maximum(nu, nv)).nonzero()[0]
            yes = []
            for i in good.tolist():
                mu, mv = (np.frombuffer(b.column(c)[i].as_py(), "<u2") for c in (4, 5))
                if (mu == mv).sum() >= p.agree and overlap_linked(full(int(u[i]), b.column(6)[i].as_py()), full(int(v[i]), b.column(7)[i].as_py()), p.percent):
                    yes.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(u[yes], pa.int64()), pa.array(v[yes], pa.int64())], schema=schema)

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of a stream sorted by its first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.nonzero(change)[0].tolist(), b.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                done, held = [held], []
                yield pa.Table.from_batches(done.pop())  # whoever reads a group may let go of it
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _between(p: MinHash):
    """Arrow pass over (bucket, block pair) groups: links between components, enough to join them."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack = _WordHash(), zstandard.ZstdDecompressor().decompress
        for g in runs(batches, 4):
            band, left, right = (g.column(i)[0].as_py() for i in (1, 2, 3))
            rows, comp, n, side = (g.column(c).to_numpy() for c in ("row", "comp", "n", "block"))
            first = g.column("first")[0].as_py()
            sig = np.frombuffer(b"".join(g.column("minima").to_pylist()), "<u2").reshape(len(rows), p.size)
            texts, full, parent, links = g.column("words"), {}, {}, []

            def root(c: int, parent=parent) -> int:
                while c in parent:
                    c = parent[c]
                return c

            def get(i: int, full=full, texts=texts) -> np.ndarray:
                if i not in full:
                    full[i] = shingles(unpack(texts[i].as_py()).split(), p.words, known)
                return full[i]

            top = np.array([root(c) for c in comp.tolist()])
            for i in range(len(rows) - 1):
                j = np.arange(i + 1, len(rows))
                ok = (top[j] != top[i]) & (100 * np.minimum(n[j], n[i]) >= p.percent * np.maximum(n[j], n[i]))
                if left != right:
                    ok &= side[j] != side[i]
                ok &= (rows[j] != first) & (rows[i] != first)  # compared before
                j = j[ok]
                if not len(j):
                    continue
                same = sig[j] == sig[i]
                j, same = (x[same.sum(1) >= p.agree] for x in (j, same))
                if not len(j):
                    continue
                shared = same.reshape(len(j), p.bands, p.rows).all(2)
                j = j[shared.argmax(1) == band]  # a pair belongs to the first band it shares
                for k in j.tolist():
                    if top[k] != top[i] and overlap_linked(get(i), get(k), p.percent):
                        links.append((int(rows[i]), int(rows[k])))
                        a, b = int(min(top[i], top[k])), int(max(top[i], top[k]))
                        parent[b] = a
                        top[top == b] = a
            if links:
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return run


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", params: MinHash | None = None) -> DataFrame:
    """Components of similar rows: (id, text_hash, n_shingles, component_id, kept).

    The component id is the smallest id in it and that row is kept (the first
    of rows that share it).  Null and blank texts have no shingles and link
    with nothing.  Null ids come last: a component of null ids alone has a null
    id and keeps one row.  An empty table gives an empty result.
    """
    p = params or MinHash()
    rows = publish(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
        _sets(p), "id long, text_hash long, row long, n long, digest binary, minima binary, words binary"), "minhash-rows")
    total = rows.count()
    small = rows.select("id", "text_hash", "row", "n", "digest")
    first = small.where("n > 0").groupBy("digest").agg(F.min("row").alias("first"))
    member = publish(small.join(first, "digest", "left").select("id", "text_hash", "row", "n", F.coalesce("first", "row").alias("first")), "minhash-members")
    copies = member.where("row <> first").select(F.col("row").alias("u"), F.col("first").alias("v"))
    heads = member.where("n > 0 and row = first").select("row")

    step = 2 * p.rows
    keys = [F.xxhash64(F.substring("minima", i * step + 1, step), F.lit(i)) for i in range(p.bands)]
    bands = publish(rows.select("row", "minima").join(heads, "row").select(
        "row", F.posexplode(F.array(*keys)).alias("band", "key")), "minhash-bands")
    buckets = bands.groupBy("key", "band").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = publish(bands.join(buckets, ["key", "band"]), "minhash-buckets")

    pairs = placed.where("row <> first").select(F.col("row").alias("u"), F.col("first").alias("v")).distinct()
    needed = placed.select("row").distinct()
    full = publish(rows.select("row", "n", "minima", "words").join(needed, "row"), "minhash-candidates")
    side = lambda x: full.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("minima").alias(f"m_{x}"), F.col("words").alias(f"w_{x}"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "m_u", "m_v", "w_u", "w_v")
    star = publish(joined.mapInArrow(_confirm(p), "u long, v long").unionByName(copies), "minhash-links")

    comp = publish(connected_components(star), "minhash-components")
    lying = placed.where("members > 2").join(comp.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("component", "row")).drop("component")
    mixed = lying.groupBy("key", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "band")
    lying = lying.join(mixed, ["key", "band"])
    blocks = F.ceil(F.col("members") / p.block).cast("int")
    lying = lying.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("row"), blocks).cast("int")})
    units = lying.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "band", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "row", "comp", "first")
    tasks = input_tasks(docs, 2000, total)
    units = units.join(full, "row").select("key", "band", "left", "right", "block", "row", "comp", "first", "n", "minima", "words")
    units = units.repartition(tasks, "key", "band", "left", "right").sortWithinPartitions("key", "band", "left", "right", "row")
    more = publish(units.mapInArrow(_between(p), "u long, v long"), "minhash-links")
    if not more.isEmpty():
        comp = connected_components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
        comp = publish(comp, "minhash-components")

    out = member.join(comp.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    out = publish(out.select("id", "text_hash", "row", "n", "component"), "minhash-labels")
    low = publish(out.groupBy("component").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("top")), "minhash-heads")
    return out.join(low.select("component", "component_id", F.col("top.row").alias("top")), "component").select(
        F.col("id").alias(id), "text_hash", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("top")).alias("kept"))


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text", params: MinHash | None = None) -> DataFrame:
    """One row of each component, with all its columns."""
    return keep_rows(docs, near_duplicates(docs, id=id, text=text, params=params), id, text)
