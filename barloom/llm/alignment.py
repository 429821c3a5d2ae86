"""Alignment of two tokenizers: which tokens of one cover which of the other.

Both encode the same bytes, a space and the text.  The character offsets of the
tokenizers library and the byte spans of sentencepiece's proto are coarse cuts;
tokens inside a character (multibyte characters, byte fallback) share a span
there and get their ends from the decoded bytes.  Places where tokens of both
end cut them into groups; the ends of either cut the bytes into segments, and a
segment lies in one token of each: a link.

Words recur, so a worker encodes the words that are new to it together, as one
text, and keeps the results of those used last.  Texts may be cut between a
word and the white space behind it as no token of either vocabulary goes over
such a place; where a vocabulary has such tokens, or its text is normalised or
split in another way, whole texts are encoded.

Counts of linked id pairs cover all documents.  The most frequent pairs, a
bounded number, travel to the documents; all others are joined by shuffling.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices
from barloom.llm.tokens import _letters
from barloom.sources.sinks import publish

SHIFT = 32  # bits of the second id in a pair's code
#: A word with the white space before it; it ends before a space, tab or line feed.  Other white space joins words.
CHUNK = re.compile(r"\s*\S+(?:[^\S \t\n]\s*\S+)*(?:[^\S \t\n]\s*\Z)?|\s+")
_OVER = re.compile(r"[^\s▁][ \t\n▁]")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_HEAD = " ."  # encoded before words, so that a space comes first


class Tokenizers:
    """Both tokenizers, the bytes of their entries, and what they make of a text."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letter = _letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        text = lambda n, end: [f"{i}{end}" for i in range(n)]
        self.a_names = [text(len(names), e) for e in ",|"]
        self.b_names = [text(len(pieces), e) for e in ",;"]
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        odd = "x  y \t z"
        same = b"".join(self.b_bytes[i] for i in self.b.encode(odd)) == b" " + odd.encode()
        self.by_word = bool(plain and same and not any(_OVER.search(p) for p in [*pieces, *names]))

    def cuts(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of both for a text that begins with a space; none if joined tokens are not its bytes."""
        raw = text.encode()
        done = self.a.encode(text, add_special_tokens=False)
        a_ids = done.ids
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        b_ids, b_ends = [p.id for p in pieces], [p.end for p in pieces]
        if b"".join([self.a_bytes[i] for i in a_ids]) != raw or b"".join([self.b_bytes[i] for i in b_ids]) != raw:
            return None
        first = np.nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[0]
        place = np.append(first, len(raw))  # byte of each character
        a_ids, b_ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_ends = place[np.array([e for _, e in done.offsets], np.int64)]
        b_ends = np.array(b_ends, np.int64) + 1
        if b_ends[-1] == len(first) < len(raw):  # releases that give characters
            b_ends = place[b_ends]
        return a_ids, refine(a_ends, self.a_size[a_ids]), b_ids, refine(b_ends, self.b_size[b_ids])


def refine(coarse: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse cut where it is as long as the token's bytes, else the bytes so far."""
    return np.where(np.diff(coarse, prepend=0) == size, coarse, np.cumsum(size))


class _Index(dict):
    """Number of each word; new ones are listed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Words:
    """Groups and links of the words met; the half used last stays when there are too many."""

    def __init__(self, both: Tokenizers, limit: int = 500_000, size: int = 32 << 20, want_ends: bool = False):
        self.both, self.limit, self.bytes, self.want_ends = both, limit, size, want_ends
        self.index, self.groups, self.held = _Index(), [], 0
        self.ends: list[np.ndarray] = []
        self.n = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, bad
        self.start, self.codes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.clock = np.zeros(0, np.int64), 0

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Word numbers of each text (empty for empty texts)."""
        self.clock += 1
        if len(self.index) > self.limit or self.held > self.bytes:
            self._forget()
        cut = CHUNK.findall if self.both.by_word else lambda t: [t]
        out = []
        for t in texts:
            words = cut(" " + t) if t else []
            out.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        self._learn()
        for x in out:
            self.used[x] = self.clock
        return out

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """Pair codes of all links of these words."""
        n = self.n[numbers, 3]
        at = np.repeat(self.start[numbers] - (np.cumsum(n) - n), n)
        return self.codes[at + np.arange(len(at))]

    def _forget(self) -> None:
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        codes = self.links(np.nonzero(keep)[0])
        old, self.index = self.index, _Index()
        chosen = keep.tolist()
        for w, k in zip(old, chosen, strict=True):
            if k:
                self.index[w] = len(self.index)
        self.groups = [g for g, k in zip(self.groups, chosen, strict=True) if k]
        self.ends = [g for g, k in zip(self.ends, chosen, strict=False) if k]  # empty if not wanted
        self.n, self.used, self.codes = self.n[keep], self.used[keep], codes
        self.start = np.cumsum(self.n[:, 3]) - self.n[:, 3]
        self.held = sum(map(len, self.index)) + sum(map(len, self.groups))

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        lots: list[tuple[list[int], bool]] = [([], False)]
        size = 0
        for i, w in enumerate(new):
            if not self.both.by_word or w[-1].isspace():  # white space at the end of a text stands alone
                lots.insert(0, ([i], not self.both.by_word))
                continue
            lots[-1][0].append(i)
            size += len(w)
            if size > 100_000:
                lots.append(([], False))
                size = 0
        counts, codes = [], [self.codes]
        groups, ends = [], []
        for lot, whole in lots:
            self._encode([new[i] for i in lot], whole, counts, codes, groups, ends)
        place = np.empty(len(new), np.int64)  # of each new word in the lots
        place[np.array([i for lot, _ in lots for i in lot])] = np.arange(len(new))
        n = np.concatenate(counts)
        start = np.cumsum(n[:, 3]) - n[:, 3] + len(self.codes)
        order = place.tolist()
        self.n, self.codes = np.concatenate([self.n, n[place]]), np.concatenate(codes)
        self.start = np.concatenate([self.start, start[place]])
        self.groups += [groups[i] for i in order]
        if self.want_ends:
            self.ends += [ends[i] for i in order]
        self.used = np.concatenate([self.used, np.full(len(new), self.clock)])
        self.held += sum(map(len, new)) + sum(map(len, groups))

    def _encode(self, words: list[str], whole: bool, counts: list[np.ndarray], codes: list[np.ndarray], groups: list[str], ends: list[np.ndarray]) -> None:
        """Append what the tokenizers make of these words, encoded as one text."""
        if not words:
            return
        head = 0 if whole else len(_HEAD)
        done = self.both.cuts(("" if whole else _HEAD) + "".join(words))
        stops = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words))) + head
        if done is not None and not (np.isin(stops, done[1]).all() and np.isin(stops, done[3]).all()):
            done = None
        if done is None:
            if len(words) > 1:  # look for the words to blame
                self._encode(words[:len(words) // 2], whole, counts, codes, groups, ends)
                self._encode(words[len(words) // 2:], whole, counts, codes, groups, ends)
            else:
                counts.append(np.array([[0, 0, 0, 0, 1]]))
                groups.append("")
                ends.append(np.empty(0, np.int64))
            return
        a_ids, a_ends, b_ids, b_ends = done
        both = np.union1d(a_ends, b_ends)
        code = a_ids[np.searchsorted(a_ends, both)] << SHIFT | b_ids[np.searchsorted(b_ends, both)]
        shared = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        edges = np.append(head, stops)
        at = np.stack([np.searchsorted(x, edges, "right") for x in (a_ends, b_ends, shared, both)])
        n = np.diff(at, axis=1).T
        counts.append(np.hstack([n, np.zeros((len(n), 1), np.int64)]))
        codes.append(code[at[3][0]:])
        last = [np.append(g[1:] != g[:-1], True).astype(int) for g in (a_group, b_group)]
        names = [t[i] for x, ids, sep in ((self.both.a_names, a_ids, last[0]), (self.both.b_names, b_ids, last[1])) for t, i in zip(map(x.__getitem__, sep.tolist()), ids.tolist(), strict=True)]
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable").tolist()
        names = list(map(names.__getitem__, order))
        tokens = (at[0] + at[1]).tolist()
        groups += ["".join(names[s:e])[:-1] for s, e in itertools.pairwise(tokens)]
        if self.want_ends:
            cuts = at[2].tolist()
            ends += [shared[cuts[k]:cuts[k + 1]] - edges[k] for k in range(len(words))]


def _words(a: str, b: str, limit: int, want_ends: bool) -> Words:
    """One pair of tokenizers, with its words, for all tasks of a Python worker."""
    import sys
    import types

    kept = sys.modules.setdefault("_corpus_alignment", types.ModuleType("_corpus_alignment"))
    key = f"{a}|{b}|{limit}|{want_ends}"
    if key not in kept.__dict__:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept.__dict__[key] = Words(Tokenizers(a, b), limit, want_ends=want_ends)
    return kept.__dict__[key]


def pack_links(codes: np.ndarray, pack) -> bytes:
    """Distinct pair codes and how often each occurs, compressed."""
    value, times = np.unique(codes, return_counts=True)
    steps = np.diff(value, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return pack(steps.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_links(data: bytes, unpack) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(unpack(data), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view("<i8").ravel()
    return np.cumsum(steps), np.ascontiguousarray(raw[8 * n:].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def align(
    docs: DataFrame, a: str, b: str, *, id: str = "doc_id", text: str = "text", ends: bool = False, words: int = 500_000, batch: int = 256,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, links[, group_ends]) of every row.

    ``a`` is a byte-level tokenizer file, ``b`` a sentencepiece model; both see
    a space and the text.  ``groups`` lists ids as ``a1,a2|b1;a3|b2``, ``links``
    holds the distinct linked pairs with their numbers (``unpack_links``), and
    with ``ends`` ``group_ends`` the byte each group ends at, the space
    included.  Null and empty texts, and texts whose tokens are not their bytes,
    have no tokens: zeros and empty values.  Repeated rows are aligned again;
    null ids stay null; an empty table gives an empty result.  ``words`` bounds
    what a worker remembers.
    """
    schema = pa.schema([("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("links", pa.binary())]
                       + ([("group_ends", pa.list_(pa.int64()))] if ends else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words(a, b, words, ends)
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in slices(batches, batch):
            found = known.numbers([t or "" for t in part.column(1).to_pylist()])
            cols: list[list] = [[] for _ in schema.names[1:]]
            for x in found:
                n = known.n[x].sum(0)
                if n[4]:
                    n, x = np.zeros(5, np.int64), x[:0]
                groups = ";".join([known.groups[i] for i in x.tolist()])
                row = [*n[:4].tolist(), groups, pack_links(known.links(x), pack)]
                if ends:
                    sizes = np.array([known.ends[i][-1] for i in x.tolist()], np.int64)
                    row.append(np.concatenate([known.ends[i] + s for i, s in zip(x.tolist(), np.cumsum(sizes) - sizes, strict=True)]) if len(x) else sizes)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    out = docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(
        run, "id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary" + (", group_ends array<long>" if ends else ""))
    return out.withColumnRenamed("id", id)


def _tally(limit: int = 1 << 21):
    """Arrow pass links -> (code, n): documents of each pair, summed while they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        codes, counts, held = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            value, where = np.unique(np.concatenate(codes), return_inverse=True)
            return value, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)

        for b in batches:
            for x in b.column(0):
                found, _ = unpack_links(x.as_py(), unpack)
                codes.append(found)
                counts.append(np.ones(len(found), np.int64))
                held += len(found)
                if held > limit:
                    value, n = summed()
                    codes, counts, held = [value], [n], len(value)
                    if held > limit // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["code", "n"])
                        codes, counts, held = [], [], 0
        if codes:
            value, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["code", "n"])

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n, best): documents that hold each pair linked, and whether no pair of its first id is held by more."""
    n = publish(aligned.select("links").mapInArrow(_tally(), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("code", SHIFT)
    most = n.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return n.join(most, first == F.col("a")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, *, held: int = 1 << 20) -> DataFrame:
    """Rows of a written ``align`` table with ``n_best`` and ``count_sum`` in place of ``links``.

    ``n_best``: links whose pair is held by as many documents as any pair of its
    first id; ``count_sum``: documents of the pair, summed over links.  At most
    ``held`` pairs, those in most documents, are sent to all tasks; links of the
    others are joined.
    """
    counts = publish(pair_counts(aligned), "pair-values")
    level = F.floor(F.log2("n")).cast("int")
    room, least = held, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 63 rows
        room -= r["count"]
        if room < 0:
            least = 2 << r.level
            break
    hot = counts.where(F.col("n") >= least).toPandas().sort_values("code")  # at most ``held`` rows
    code, n, best = hot["code"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(np.int64)
    names = [c for c in aligned.columns if c != "links"]
    fields = aligned.select(*names).schema

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        row = (TaskContext.get().partitionId() << 36) - 1
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for x in b.column(len(names)):
                row += 1
                found, times = unpack_links(x.as_py(), unpack)
                at = np.searchsorted(code, found)
                known = at < len(code)
                known[known] = code[at[known]] == found[known]
                at = at[known]
                for c, v in zip(cols, (row, int(times[known] @ best[at]), int(times[known] @ n[at]), found[~known], times[~known]), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                             names=[*names, "_row", "n_best", "count_sum", "_codes", "_times"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _row long, n_best long, count_sum long, _codes array<long>, _times array<long>"
    out = aligned.select(*names, "links").mapInArrow(weigh, kind)
    if not least:
        return out.drop("_row", "_codes", "_times")
    out = publish(out, "pair-links")
    rare = out.select("_row", F.explode(F.arrays_zip("_codes", "_times")).alias("x")).select("_row", F.col("x._codes").alias("code"), F.col("x._times").alias("t"))
    more = rare.join(counts.where(F.col("n") < least), "code").groupBy("_row").agg(
        F.sum(F.col("t") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_best"))
    whole = lambda c, extra: (F.col(c) + F.coalesce(F.col(extra), F.lit(0))).alias(c)
    return out.join(more, "_row", "left").select(*names, whole("n_best", "_best"), whole("count_sum", "_sum"))


def align_documents(docs: DataFrame, a: str, b: str, *, id: str = "doc_id", text: str = "text", held: int = 1 << 20) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum): alignment with corpus-wide counts.

    Rows as ``align`` defines them; ``groups_sha256`` is empty where there are
    no tokens.  Every row counts as a document, repeated ones too.
    """
    made = align(docs, a, b, id=id, text=text)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    made = publish(made.select(id, "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"), "alignment")
    return score_links(made, held=held)
