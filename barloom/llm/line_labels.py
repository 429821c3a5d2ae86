"""Quality rules: lines labelled as content or boilerplate by a linear-chain CRF.

Every line with a word is described by shares of its characters and words.  A
conditional random field weighs these and the labels of neighbouring lines;
Viterbi decoding finds the likeliest labels of the whole text, and the share of
words in content lines decides whether it is kept.

The field is trained by maximum likelihood on documents with a quality label.
Their lines carry no labels, so all lines of good documents are content, and
those of bad ones start as boilerplate and are labelled anew by the field in a
few rounds, as long as they leave half of the document's words boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices
from barloom.llm.minhash import _WordHash
from barloom.llm.phrases import fingerprints

SYMBOLS = b"#*$%&|<>"
RUN = 8  # words of a window that counts as repeated
FEATURES = ("one", "symbols", "many symbols", "capitals", "all capitals", "digits", "punctuation", "exclamations", "words", "word length", "repeated", "line again", "sentence end")


def _classes() -> np.ndarray:
    """Rows: white space, symbol, capital, letter, digit, other punctuation, exclamation mark; columns: bytes."""
    t = np.zeros((7, 256), bool)
    t[0, [9, 10, 11, 12, 13, 32]] = True
    t[1, list(SYMBOLS)] = True
    t[2, 65:91] = True
    t[3, 65:91] = t[3, 97:123] = t[3, 128:] = True
    t[4, 48:58] = True
    t[5, 33:127] = ~(t[1] | t[3] | t[4])[33:127]
    t[6, 33] = True
    return t


@dataclass(frozen=True)
class LineField:
    """Weights of the features for content, of label pairs (boilerplate first) and of the first label."""

    weights: tuple[float, ...]
    pairs: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    first: tuple[float, float] = (0.0, 0.0)


class Lines:
    """Counts of a text and features of its lines."""

    def __init__(self) -> None:
        self.known, self.classes = _WordHash(), _classes()

    def __call__(self, text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray, np.ndarray]:
        """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); features, words, number of each line with a word."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        if not words:
            return (0, 0, 0, 0, 0), np.empty((0, len(FEATURES))), np.empty(0, np.int64), np.empty(0, np.int64)
        again = self.repeated(words)
        lines = raw.split(b"\n")
        size = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
        starts = np.cumsum(size) - size
        data = np.frombuffer(raw + b"\n", np.uint8)
        per = [np.add.reduceat(c[data], starts, dtype=np.int64) for c in self.classes]
        space = self.classes[0][data]
        begins = np.append(True, space[:-1]) & ~space
        n = np.add.reduceat(begins, starts, dtype=np.int64)
        kept = np.nonzero(n)[0]
        seen: set[bytes] = set()
        dup = np.zeros(len(kept), bool)
        ends = np.zeros(len(kept), bool)
        for k, i in enumerate(kept.tolist()):
            line = lines[i]
            dup[k] = line in seen
            seen.add(line)
            ends[k] = line.rstrip()[-1:] in b".?!:;\"'"
        _, symbols, capitals, letters, digits, marks, bangs = (x[kept] for x in per)
        size, w = size[kept] - per[0][kept], n[kept]  # bytes in words
        at = np.cumsum(w) - w
        twice = np.add.reduceat(again, at, dtype=np.int64)
        share = lambda x, y: x / np.maximum(y, 1)
        upper = share(capitals, letters)
        features = np.stack([
            np.ones(len(kept)), np.sqrt(share(symbols, size)), share(symbols, w) > 0.3, np.sqrt(upper), upper > 0.6, np.sqrt(share(digits, size)),
            np.sqrt(share(marks, size)), np.minimum(share(bangs, w), 2), np.log1p(w) / 4, np.minimum(size / w / 8, 4), share(twice, w), dup, ends], axis=1)
        chars = len(text) - int(per[0].sum() - 1)  # the line end added above
        return (len(words), chars, int(symbols.sum()), int(dup.sum()), int(again.sum())), features, w, kept

    def repeated(self, words: list[bytes]) -> np.ndarray:
        """Which words lie in windows of RUN words that occur twice or more; equal fingerprints are compared by words."""
        covered = np.zeros(len(words) + 1, np.int64)
        if len(words) > RUN:
            prints = fingerprints(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)), RUN)
            order = np.sort(prints)
            if (order[1:] == order[:-1]).any():
                twice = np.unique(order[1:][order[1:] == order[:-1]])
                at = np.nonzero(twice[np.minimum(np.searchsorted(twice, prints), len(twice) - 1)] == prints)[0]
                first: dict[tuple[bytes, ...], int] = {}
                for i in at.tolist():
                    j = first.setdefault(tuple(words[i:i + RUN]), i)
                    if j != i:
                        covered[i] += 1
                        covered[i + RUN] -= 1
                        if j >= 0:
                            covered[j] += 1
                            covered[j + RUN] -= 1
                            first[tuple(words[i:i + RUN])] = -1
        return np.cumsum(covered[:-1]) > 0


def viterbi(scores: list[float], field: LineField) -> list[bool]:
    """Likeliest labels (content?) of lines with these content scores."""
    if not scores:
        return []
    t00, t01, t10, t11 = field.pairs
    a0, a1 = field.first[0], field.first[1] + scores[0]
    back = []
    for s in scores[1:]:
        x0, y0, x1, y1 = a0 + t00, a1 + t10, a0 + t01, a1 + t11
        back.append((y0 > x0, y1 > x1))
        a0, a1 = (y0 if y0 > x0 else x0), (y1 if y1 > x1 else x1) + s
    label = a1 >= a0
    out = [label]
    for b in reversed(back):
        label = b[label]
        out.append(label)
    return out[::-1]


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weight: np.ndarray, pull: float) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood of label chains and its gradient; chains are ordered longest first.

    ``theta``: feature weights, the four pairs, the two first labels.
    """
    k = x.shape[1]
    pairs, first = theta[k:k + 4].reshape(2, 2), theta[k + 4:]
    score = np.stack([np.zeros(len(x)), x @ theta[:k]], axis=1)
    steps = int(sizes.max())
    active = [int((sizes > t).sum()) for t in range(steps)]
    log_sum = lambda v, axis: np.logaddexp(*np.moveaxis(v, axis, 0))
    forward, backward = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    forward[starts] = first + score[starts]
    for t in range(1, steps):
        at = starts[:active[t]] + t
        forward[at] = log_sum(forward[at - 1][:, :, None] + pairs, 1) + score[at]
    for t in range(steps - 1, 0, -1):
        at = starts[:active[t]] + t
        backward[at - 1] = log_sum((backward[at] + score[at])[:, None, :] + pairs, 2)
    ends = starts + sizes - 1
    z = log_sum(forward[ends], 1)
    chain = np.repeat(np.arange(len(starts)), sizes)  # rows are in chain order
    p = np.exp(forward + backward - z[chain][:, None])
    inner = np.ones(len(x), bool)
    inner[starts] = False
    later = np.nonzero(inner)[0]
    both = np.exp(forward[later - 1][:, :, None] + pairs + (score + backward)[later][:, None, :] - z[chain[later]][:, None, None])
    held = weight[chain]
    want = y.astype(int)
    told = score[np.arange(len(x)), want] @ held + pairs[want[later - 1], want[later]] @ held[later] + first[want[starts]] @ weight
    loss = weight @ z - told + 0.5 * pull * (theta @ theta)
    grad_pairs = (both * held[later][:, None, None]).sum(0)
    np.subtract.at(grad_pairs, (want[later - 1], want[later]), held[later])
    grad_first = (p[starts] * weight[:, None]).sum(0)
    np.subtract.at(grad_first, want[starts], weight)
    grad = np.concatenate([x.T @ ((p[:, 1] - want) * held), grad_pairs.ravel(), grad_first])
    return float(loss), grad + pull * theta


def minimise(f, theta: np.ndarray, rounds: int = 60) -> np.ndarray:
    """BFGS with halved steps."""
    loss, grad = f(theta)
    inverse = np.eye(len(theta)) / max(1.0, float(np.abs(grad).max()))
    for _ in range(rounds):
        step = -inverse @ grad
        slope, size = float(step @ grad), 1.0
        while True:
            new = theta + size * step
            now, found = f(new)
            if now <= loss + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        if size < 1e-8 or loss - now < 1e-7 * max(1.0, abs(loss)):
            break
        s, v = new - theta, found - grad
        theta, loss, grad = new, now, found
        if s @ v > 1e-12:
            r = 1 / (s @ v)
            m = np.eye(len(theta)) - r * np.outer(s, v)
            inverse = m @ inverse @ m.T + r * np.outer(s, s)
    return theta


def train(chains: list[tuple[np.ndarray, np.ndarray, int]], *, rounds: int = 3, least: float = 0.5, pull: float = 1.0) -> LineField:
    """Field of (features, words per line, document label) chains; both labels weigh the same."""
    chains = sorted(chains, key=lambda c: -len(c[0]))
    x = np.concatenate([c[0] for c in chains])
    sizes = np.array([len(c[0]) for c in chains])
    starts = np.cumsum(sizes) - sizes
    good = np.array([c[2] for c in chains])
    weight = np.where(good == 1, len(good) / 2 / max((good == 1).sum(), 1), len(good) / 2 / max((good == 0).sum(), 1))
    y = np.repeat(good == 1, sizes)
    theta = np.zeros(x.shape[1] + 6)
    k = x.shape[1]
    for r in range(rounds):
        theta = minimise(lambda v: likelihood(v, x, y, starts, sizes, weight, pull), theta)  # noqa: B023
        field = LineField(tuple(theta[:k].tolist()), tuple(theta[k:k + 4].tolist()), tuple(theta[k + 4:].tolist()))
        if r + 1 == rounds:
            break
        for (f, w, label), s in zip(chains, starts.tolist(), strict=True):
            if label == 0:
                content = np.array(viterbi((f @ theta[:k]).tolist(), field))
                y[s:s + len(f)] = content if w[content].sum() <= least * w.sum() else False
    return field


def fit(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1000, lines: int = 400,
) -> LineField:
    """Train on a bounded sample of labelled documents.

    Per label at most ``per_class`` ids (smallest hash first), and of their
    documents those of 1 to ``lines`` lines.  Null ids and labels other than 0
    and 1 are left out, ids with both labels teach both.  Without documents of
    both labels every line is content.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").distinct()
    ids = [(r.k, r.y) for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class).collect()]
    sample = docs.select(F.col(id).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(spark.createDataFrame(ids, "k long, y int")), "k")
    sample = sample.dropDuplicates(["k", "y"])  # of repeated ids one row teaches
    schema = pa.schema([("k", pa.int64()), ("y", pa.int32()), ("x", pa.binary()), ("w", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Lines()
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for k, y, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                _, x, w, _ = measure(t)
                if 0 < len(x) <= lines:
                    for c, v in zip(cols, (k, y, x.astype("<f8").tobytes(), w), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = sample.select("k", "y", "t").mapInArrow(run, "k long, y int, x binary, w array<long>").collect()  # bounded by both parameters
    if len({r.y for r in rows}) < 2:
        return LineField((1.0, *[0.0] * (len(FEATURES) - 1)))
    rows.sort(key=lambda r: (r.k, r.y))
    return train([(np.frombuffer(bytes(r.x), "<f8").reshape(-1, len(FEATURES)), np.array(r.w), r.y) for r in rows])


def label_lines(docs: DataFrame, field: LineField, *, id: str = "doc_id", text: str = "text", spans: bool = True, batch: int = 256) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_words[, lines]) of every row.

    ``lines``: (line, n_words, content) of each line with a word, by its number
    from 0 in the \\n-split text.  Null, empty and blank texts have zeros and no
    lines.  Repeated rows and null ids keep their rows; an empty table gives an
    empty result.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")
    line = pa.struct([("line", pa.int64()), ("n_words", pa.int64()), ("content", pa.bool_())])
    schema = pa.schema([("id", pa.int64()), *((n, pa.int64()) for n in names)] + ([("lines", pa.list_(line))] if spans else []))
    weights = np.array(field.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Lines()
        for b in slices(batches, batch):
            cols: list[list] = [[] for _ in schema.names[1:]]
            for t in b.column(1):
                counts, x, w, numbers = measure(t.as_py())
                content = viterbi((x @ weights).tolist(), field)
                row = [*counts, int(w[np.array(content, bool)].sum())]
                if spans:
                    row.append([{"line": i, "n_words": n, "content": c} for i, n, c in zip(numbers.tolist(), w.tolist(), content, strict=True)])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    kind = "id long, " + ", ".join(f"{n} long" for n in names) + (", lines array<struct<line: long, n_words: long, content: boolean>>" if spans else "")
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text)).mapInArrow(run, kind).withColumnRenamed("id", id)


def judge(labelled: DataFrame, *, least: float = 0.5) -> DataFrame:
    """With ``base_failed`` (fewer than 20 words, or over 30 % of them in repeated windows) and ``kept``.

    Kept are texts that do not fail and have at least ``least`` of their words in content lines.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return labelled.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_words") >= least * F.col("n_words")))
