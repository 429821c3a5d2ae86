"""Repeated passages, found with automata.

A window is a run of consecutive words; it is a repeat if its words also start
earlier, in a document with a smaller id or before in the same one.

1. Anchors.  Every window holds the smallest-hashed of its short runs of words.
   Equal windows have equal anchors, so only windows whose anchor occurs twice
   can be repeats.  One anchor covers about seven windows.
2. Passages.  Runs of windows with one such anchor are cut out as passages (at
   most ``LONGEST`` windows each).  A passage whose digest recurs is a phrase.
   Phrases are sharded by digest and compiled, at their first occurrence, into
   Aho-Corasick automata over words; all passages of a shard are streamed
   through, and where an earlier phrase is found the words are repeats.  A
   digest with more occurrences than a lot is salted over several units, each
   with a copy of the phrase.
3. Confirmation.  What is left are first occurrences that share only some
   windows: passages that differ but have one anchor, and passages that repeat
   themselves.  Their windows are counted by fingerprint; those that occur twice
   are further phrases, each with its first place.
4. These are sharded by anchor, a bounded number to an automaton, and the
   passages of step 3 are streamed through.  Shards with too many phrases or
   passages are split into blocks, one task for each pair of blocks.
   In both steps the automaton compares the words themselves: digests and
   fingerprints only route.
5. Hits become covered intervals of the passages, of their occurrences, and of
   documents, whose words are dropped where covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import input_tasks, slices
from barloom.llm.minhash import runs
from barloom.sources.sinks import discard, publish

PLACE = 24  # bits of a word's place in its document
ROWS = 26  # bits of a document's place in its range
LONGEST = 4096  # windows in a passage


@dataclass(frozen=True)
class Windows:
    """``words`` per window, ``anchor`` words per anchor."""

    words: int = 20
    anchor: int = 8


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "replace").split()


def fingerprints(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit fingerprints of all runs of k word hashes, from those of runs half as long."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    part, size, step = h, 1, pow(0x9E3779B97F4A7C15, 1, 1 << 64)
    out, done = None, 0  # fingerprints of runs of ``done`` words
    while True:
        if k & size:
            if out is None:
                out = part
            else:  # the longer part comes first
                out = part[:len(part) - done] * np.uint64(pow(0x9E3779B97F4A7C15, done, 1 << 64)) + out[size:size + len(part) - done]
            done += size
        if 2 * size > k:
            break
        part = part[:-size] * np.uint64(step) + part[size:]
        size, step = 2 * size, step * step % (1 << 64)
    out = out[:len(h) - k + 1].copy()
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def sliding(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """Smallest or largest (``best``) of each run of ``span`` values, by doubling."""
    size = 1
    while 2 * size <= span:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[:len(x) - (span - size)], x[span - size:]) if span > size else x


#: An odd multiplier and its inverse modulo 2^64.
STEP = 0xD1342543DE82EF95
BACK = pow(STEP, -1, 1 << 64)


class WordHashes:
    """Hashes of the words of a text whose words are joined by single spaces: equal words have equal hashes.

    A word's hash is the difference of two prefix sums of bytes times powers,
    brought back to the word's start, so no word becomes an object.
    """

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.append(np.uint64(1), np.full(size - 1, STEP, np.uint64)))
                self.down = np.cumprod(np.append(np.uint64(1), np.full(size - 1, BACK, np.uint64)))

    def __call__(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each word."""
        if not joined:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        raw = np.frombuffer(joined, np.uint8)
        ends = np.append(np.nonzero(raw == 32)[0], len(raw))
        starts = np.append(0, ends[:-1] + 1)
        self._powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.up[:len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h, starts, ends


def window_anchors(h: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window, and the fingerprints of all runs of anchor length."""
    short = fingerprints(h, w.anchor)
    if len(h) < w.words:
        return short[:0], short
    return sliding(short, w.words - w.anchor + 1, np.minimum), short


def anchor_places(anchors: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Places whose run is the anchor of a window: it equals the largest anchor of the windows over it."""
    span = len(short) - len(anchors)
    edge = np.zeros(span, np.uint64)
    return np.nonzero(short == sliding(np.concatenate([edge, anchors, edge]), span + 1, np.maximum))[0] if len(anchors) else np.empty(0, np.int64)


def _documents(w: Windows):
    schema = pa.schema([
        ("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("whole", pa.string()),
        ("anchors", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = WordHashes(), zstandard.ZstdCompressor(level=1).compress
        row = (TaskContext.get().partitionId() << 36) - 1
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1):
                row += 1
                joined = b" ".join(split(t.as_py()))
                h, _, _ = hashes(joined)
                if len(h) >= 1 << PLACE:
                    raise ValueError(f"a document of {len(h)} words; the limit is {1 << PLACE}")
                anchors, short = window_anchors(h, w)
                value, times = np.unique(short[anchor_places(anchors, short)], return_counts=True)
                for c, v in zip(cols, (row, len(h), hashlib.sha256(joined).hexdigest(), value.view(np.int64), times.astype(np.int32), pack(joined)), strict=True):
                    c.append(v)
            cols.insert(1, b.column(0))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _passages(w: Windows):
    """Arrow pass (place, words, anchors) -> passages (at, key, anchor, inner, words); inner: has a window twice."""
    schema = pa.schema([("at", pa.int64()), ("key", pa.binary()), ("anchor", pa.int64()), ("inner", pa.bool_()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack, digest = WordHashes(), zstandard.ZstdDecompressor().decompress, xxhash.xxh3_128_digest
        for b in slices(batches, 500):
            cols: list[list] = [[] for _ in schema]
            at, key, anchor, inner, text = cols
            for i in range(b.num_rows):
                joined = unpack(b.column(1)[i].as_py())
                h, begin, end = hashes(joined)
                anchors, short = window_anchors(h, w)
                wanted = b.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                hit = np.isin(anchors, wanted)
                edge = np.ones(len(hit) + 1, bool)
                edge[1:-1] = anchors[1:] != anchors[:-1]
                cuts = np.nonzero(edge)[0]
                wide = np.nonzero(np.diff(cuts) > LONGEST)[0]
                if len(wide):  # one anchor over and over, as in a long run of one word
                    cuts = np.unique(np.concatenate([cuts, *(np.arange(cuts[c], cuts[c + 1], LONGEST) for c in wide)]))
                first, last = cuts[:-1][hit[cuts[:-1]]], cuts[1:][hit[cuts[:-1]]]
                base = b.column(0)[i].as_py() << PLACE
                at.extend((base + first).tolist())
                anchor.extend(anchors[first].view(np.int64).tolist())
                # places of each passage's anchor: a passage that holds it once holds no window twice
                spots = np.nonzero(np.isin(short, wanted))[0]
                value = short[spots]
                parts = [joined[s:e] for s, e in zip(begin[first].tolist(), end[last + w.words - 2].tolist(), strict=True)]
                text.extend(parts)
                key.extend(map(digest, parts))
                left, right = np.searchsorted(spots, first), np.searchsorted(spots, last + w.words - w.anchor)
                for s, e, x, y in zip(first.tolist(), last.tolist(), left.tolist(), right.tolist(), strict=True):
                    inner.append(y - x > 1 and np.count_nonzero(value[x:y] == anchors[s]) > 1 and len(np.unique(fingerprints(h[s:e + w.words - 1], w.words))) < e - s)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _windows(w: Windows):
    """Arrow pass (at, words) of passages -> their distinct windows (print, at, place, inner)."""
    names = ["print", "at", "place", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            at = b.column(0).to_numpy(zero_copy_only=False)
            texts = [t.as_py() for t in b.column(1)]
            h, starts, _ = hashes(b" ".join(texts))
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            of = np.searchsorted(ends, starts, "right")  # passage of each word
            prints = fingerprints(h, w.words)
            first = np.nonzero(of[:len(prints)] == of[w.words - 1:])[0] if len(prints) else np.empty(0, np.int64)  # windows inside one passage
            if not len(first):
                continue
            order = first[np.lexsort((first, prints[first], of[first]))]
            new = np.append(True, (prints[order[1:]] != prints[order[:-1]]) | (of[order[1:]] != of[order[:-1]]))
            heads = np.nonzero(new)[0]
            times = np.diff(np.append(heads, len(order)))
            kept = order[heads]
            begin = np.searchsorted(of, np.arange(len(texts)))  # first word of each passage
            place = at[of[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (prints[kept].view(np.int64), place + kept - begin[of[kept]], place, times > 1)], names=names)

    return run


def intervals(starts: list[int], width: int) -> list[int]:
    """Union of [s, s + width), flat: begin, end, begin, end ..."""
    out: list[int] = []
    for s in starts:
        if out and s <= out[-1]:
            out[-1] = s + width
        else:
            out += [s, s + width]
    return out


def _repeats():
    """Arrow pass over (shard, lot) units of passages: recurring ones compiled, all streamed.

    Gives (at, anchor, inner, cover, words): the interval found again, or the words of what was not.
    """
    schema = pa.schema([
        ("at", pa.int64()), ("anchor", pa.int64()), ("inner", pa.bool_()), ("cover", pa.list_(pa.int32())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for g in runs(batches, 2):
            at, model = g.column("at").to_numpy(), g.column("model").to_numpy()
            key = g.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            twice = np.nonzero(np.bincount(key)[key] > 1)[0]
            twice = twice[np.lexsort((~model[twice], at[twice]))]  # first occurrences first
            texts = g.column("words").take(pa.array(twice)).to_pylist()
            number: dict[bytes, int] = {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            compiled: set[int] = set()
            numbered: dict[bytes, tuple[int, ...]] = {}  # words of a text as numbers, once for all its copies
            for k, place, t in zip(key[twice].tolist(), at[twice].tolist(), texts, strict=True):
                if k not in compiled:
                    compiled.add(k)
                    ids = numbered[t] = tuple([number.setdefault(x, len(number) + 1) for x in t.split(b" ")])
                    automaton.add_word(ids, (place, len(ids)))
            covers: list[list[int] | None] = [None] * len(at)
            if compiled:
                automaton.make_automaton()
            for i, own, t in zip(twice.tolist(), at[twice].tolist(), texts, strict=True):
                ids = numbered.get(t) or numbered.setdefault(t, tuple(map(number.get, t.split(b" "), repeat(0))))
                for e, (place, n) in automaton.iter(ids):
                    if n == len(ids) and place < own:
                        covers[i] = [e - n + 1, e + 1]
            out = np.nonzero(~model)[0]
            g = g.take(pa.array(out)).combine_chunks()
            cover = pa.array([covers[i] for i in out.tolist()], pa.list_(pa.int32()))
            words = pc.if_else(cover.is_null(), g.column("words"), pa.scalar(None, pa.binary()))
            yield from pa.table([g.column("at"), g.column("anchor"), g.column("inner"), cover, words], schema=schema).to_batches()

    return run


def _locate(w: Windows):
    """Arrow pass over (shard, block, lot) groups: phrases compiled, passages streamed; covered intervals of passages."""
    schema = pa.schema([("at", pa.int64()), ("first", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for g in runs(batches, 3):
            at = g.column("at").to_pylist()
            texts, offsets = g.column("words"), g.column("offsets")
            number: dict[bytes, int] = {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            stream = []
            for i in range(len(at)):
                wanted = offsets[i].as_py()
                if wanted is None:
                    stream.append(i)
                    continue
                ids = [number.setdefault(x, len(number) + 1) for x in texts[i].as_py().split(b" ")]
                for o in wanted:
                    automaton.add_word(tuple(ids[o:o + w.words]), at[i] + o)
            if not stream or not len(automaton):
                continue
            automaton.make_automaton()
            cols: list[list] = [[], []]
            for i in stream:
                ids = tuple(map(number.get, texts[i].as_py().split(b" "), repeat(0)))
                hits = ((e - w.words + 1, place) for e, place in automaton.iter(ids))
                first = intervals([s for s, place in hits if place != at[i] + s], w.words)
                if first:
                    cols[0].append(at[i])
                    cols[1].append(first)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _drop():
    """Arrow pass (row, words, covers) -> (row, n_removed, kept)."""
    schema = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            removed, kept = [], []
            for i in range(b.num_rows):
                joined = unpack(b.column(1)[i].as_py())
                ends = np.append(np.nonzero(np.frombuffer(joined, np.uint8) == 32)[0], len(joined))
                edge = np.zeros(len(ends) + 1, np.int64)
                for c in b.column(2)[i].as_py():
                    cover = np.array(c["cover"], np.int64) + c["start"]
                    np.add.at(edge, cover[::2], 1)
                    np.add.at(edge, cover[1::2], -1)
                gone = np.append(True, np.append(np.cumsum(edge[:-1]) > 0, True))
                turn = np.nonzero(gone[1:] != gone[:-1])[0]  # first word kept, first word gone behind it ...
                starts = np.append(0, ends[:-1] + 1)
                removed.append(int(gone.sum()) - 2)
                kept.append(b" ".join([joined[s:e] for s, e in zip(starts[turn[::2]].tolist(), ends[turn[1::2] - 1].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def remove_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", windows: Windows | None = None, phrases: int = 20000, lot: int = 20000,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text): words outside repeated windows.

    ``kept_text`` is null where nothing was removed.  Null texts and texts
    shorter than a window keep all their words.  Documents are ordered by id,
    null ids last; rows that share an id follow each other in any fixed order.
    An empty table gives an empty result.
    """
    w = windows or Windows()
    rows = publish(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        _documents(w), "row long, id long, n_words long, whole string, anchors array<long>, times array<int>, words binary"), "phrase-documents")
    each = rows.select("row", F.explode(F.arrays_zip("anchors", "times")).alias("a")).select("row", F.col("a.anchors").alias("anchor"), F.col("a.times").alias("times"))
    twice = each.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    found = each.select("row", "anchor").join(twice, "anchor").groupBy("row").agg(F.collect_list("anchor").alias("anchors"))

    tasks = min(1 << 63 - PLACE - ROWS, input_tasks(docs, 50000, rows.count()))
    order = rows.select("row", "id").repartitionByRange(tasks, F.col("id").isNull(), "id", "row").sortWithinPartitions(F.col("id").isNull(), "id", "row")
    number = F.monotonically_increasing_id()
    order = order.select("row", F.shiftleft(F.shiftright(number, 33), ROWS).bitwiseOR(number.bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    found = publish(found, "phrase-anchors").join(publish(order, "phrase-order"), "row")
    held = publish(rows.select("row", "words").join(found, "row"), "phrase-candidates")
    plain = publish(rows.select("row", "id", "n_words", "whole"), "phrase-plain")
    discard(rows)

    seen = publish(held.select("place", "words", "anchors").mapInArrow(
        _passages(w), "at long, key binary, anchor long, inner boolean, words binary"), "passages")
    unit = -(-lot // 5)  # building an automaton takes time with the square of the phrases at its root, so units are small
    heavy = publish(seen.groupBy("key").agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("n")).where(F.col("n") > unit).select(
        "key", "head", F.ceil(F.col("n") / unit).cast("int").alias("lots")), "passages-heavy")  # at most one in ``unit`` passages
    shards = max(1, -(-seen.count() // unit))
    place = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    fields = ["at", "key", "anchor", "inner", "words"]
    each = seen.join(heavy.select("key", "lots"), "key", "left").select(
        place, F.pmod(F.xxhash64("at"), F.coalesce("lots", F.lit(1))).cast("int").alias("lot"), *fields, F.lit(False).alias("model"))
    model = seen.join(heavy.withColumnRenamed("head", "at"), ["key", "at"]).select(
        place, F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), *fields, F.lit(True).alias("model"))
    units = each.unionByName(model).repartition(max(tasks, min(shards, 4 * tasks)), "shard", "lot").sortWithinPartitions("shard", "lot")
    once = publish(units.mapInArrow(_repeats(), "at long, anchor long, inner boolean, cover array<int>, words binary"), "passages-once")
    discard(seen)
    heads = once.where("cover is null")
    several = heads.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner")).where("n > 1 or inner").select("anchor")
    passages = publish(heads.select("at", "anchor", "words").join(several, "anchor"), "passages-mixed")

    window = publish(passages.select("at", "words").mapInArrow(_windows(w), "print long, at long, place long, inner boolean"), "passage-windows")
    first = window.groupBy("print").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner")).where("n > 1 or inner").select("at")
    wanted = first.join(window.select("at", "place"), "at").groupBy("place").agg(F.sort_array(F.collect_list((F.col("at") - F.col("place")).cast("int"))).alias("offsets"))
    phrase = publish(passages.join(wanted.withColumnRenamed("place", "at"), "at"), "phrases")

    total = phrase.agg(F.coalesce(F.sum(F.size("offsets")), F.lit(0))).first()[0]
    shards = max(1, -(-total // phrases))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")
    sizes = phrase.groupBy(shard).agg(F.ceil(F.sum(F.size("offsets")) / phrases).cast("int").alias("blocks")).join(
        passages.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / lot).cast("int").alias("lots")), "shard")
    block, part = F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("at", F.lit(1)), F.col("lots")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = phrase.select(shard, "at", "words", "offsets").join(sizes, "shard").select(
        "shard", block.alias("block"), all_of("lots").alias("lot"), "at", "words", "offsets")
    right = passages.select(shard, "at", "words").join(sizes, "shard").select(
        "shard", all_of("blocks").alias("block"), part.alias("lot"), "at", "words", F.lit(None).cast("array<int>").alias("offsets"))
    keys = ["shard", "block", "lot"]
    hits = left.unionByName(right).repartition(max(tasks, min(shards, 4 * tasks)), *keys).sortWithinPartitions(*keys)
    hits = publish(hits.mapInArrow(_locate(w), "at long, first array<int>"), "phrase-hits")

    again = once.where("cover is not null").select("at", "cover")
    covered = again.unionByName(hits.select("at", F.col("first").alias("cover"))).select(
        F.shiftright("at", PLACE).alias("place"), F.col("at").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("start"), "cover")
    covered = covered.groupBy("place").agg(F.collect_list(F.struct("start", "cover")).alias("covers"))
    changed = held.select("row", "place", "words").join(covered, "place").select("row", "words", "covers").mapInArrow(
        _drop(), "row long, n_removed long, kept string")
    changed = publish(changed, "phrase-kept")
    return plain.join(changed, "row", "left").select(
        F.col("id").alias(id), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.sha2("kept", 256), F.col("whole")).alias("kept_sha256"), F.col("kept").alias("kept_text"))
