"""Quality score by compression.

Two zstandard dictionaries are built, one from well and one from badly
labelled text.  A text that looks like the bad examples compresses better with
their dictionary.  With g and b the compressed sizes of a text under the good
and the bad dictionary, the features are

* (b - g) / (b + g), the normalised difference, and
* log(g / bytes), how far the text compresses at all (endless repetition),

and a logistic curve over them, fitted on other labelled documents than the
dictionaries, makes them a probability of label 1.  Long texts are compressed
in blocks, every block with a fresh dictionary, so that the dictionaries count
alike in short and in long texts; every byte is compressed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    block: int
    level: int


def _sizer(good: bytes, bad: bytes, block: int, level: int):
    """Function text -> (normalised difference, log ratio)."""
    sides = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data) if data else None
        if d is not None:
            d.precompute_compress(level=level)
        sides.append(zstandard.ZstdCompressor(
            level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    by_good, by_bad = sides

    def sizes(text: str | None) -> tuple[float, float]:
        raw = (text or "").encode("utf-8", "replace")
        g = b = 0
        for i in range(0, max(len(raw), 1), block):
            part = raw[i:i + block]
            g += len(by_good(part))
            b += len(by_bad(part))
        return (b - g) / (b + g), float(np.log(g / max(len(raw), 1)))

    return sizes


def _terms(d: np.ndarray, r: np.ndarray) -> np.ndarray:
    d = 10.0 * d
    return np.stack([np.ones_like(d), d, r, d * d, r * r, d * r], axis=1)


def _dictionary(texts: list[str], size: int, block: int, most: int) -> bytes:
    """Trained dictionary; from too little text, the text itself."""
    parts, held = [], 0
    for t in texts:
        raw = t.encode("utf-8", "replace")
        for i in range(0, len(raw), block):
            if held < most:
                parts.append(raw[i:i + block])
                held += len(parts[-1])
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Ridge-penalised logistic regression; the first column of ``x`` is the constant and is not penalised.

    Newton steps are halved until the penalised loss falls, so that nearly
    separable labels cannot make them diverge.
    """
    shift, scale = x.mean(0), x.std(0)
    shift[0], scale = 0.0, np.where(scale > 0, scale, 1.0)
    z = (x - shift) / scale
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.logaddexp(0, m).sum() - y @ m + 0.5 * (pull * w * w).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(h, z.T @ (y - p) - pull * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    out = w / scale
    out[0] -= (w / scale * shift)[1:].sum()
    return out


def fit(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality",
    per_class: int = 1500, calibration: int = 3000, dictionary: int = 112640, block: int = 2048, level: int = 3,
    train_bytes: int = 32 << 20,
) -> QualityModel:
    """Learn from a bounded sample of labelled documents.

    Per label, at most ``per_class`` documents (smallest hash of the id first)
    train the dictionary, of at most ``train_bytes`` bytes of them, and at most
    ``calibration`` others the curve.  Null ids, texts and labels are left out.
    With one class only, or none, the score is that class's label, or 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").distinct()
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class + calibration)
        picked = one if picked is None else picked.unionByName(one)
    rows = picked.collect()  # at most 2 * (per_class + calibration) ids
    n = {y: sum(r.y == y for r in rows) for y in (0, 1)}
    first = {y: min(per_class, max(n[y] // 2, 1)) for y in n}
    seen, role = {0: 0, 1: 0}, []
    for r in rows:
        role.append((r.k, r.y, seen[r.y] < first[r.y]))
        seen[r.y] += 1
    if not n[0] or not n[1]:
        p = 0.5 if not rows else float(bool(n[1]))
        return QualityModel(b"", b"", (float(np.log((p + 1e-6) / (1 - p + 1e-6))), 0, 0, 0, 0, 0), block, level)
    ids = spark.createDataFrame(role, "k bigint, y int, dictionary boolean")
    sample = docs.select(F.col(id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(ids), "k")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([zlib.crc32(str(k).encode()) for k in pdf["k"]], kind="stable")]  # mixed: neighbours by id may be alike
        return pd.DataFrame({"y": [int(pdf["y"].iloc[0])], "d": [_dictionary(list(pdf["t"]), dictionary, block, train_bytes)]})

    made = {r.y: bytes(r.d) for r in sample.where("dictionary").groupBy("y").applyInPandas(train, "y int, d binary").collect()}
    if len(made) < 2:
        return QualityModel(b"", b"", (0.0,) * 6, block, level)
    good, bad = made[1], made[0]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = _sizer(good, bad, block, level)
        for pdf in batches:
            d, r = zip(*map(sizes, pdf["t"]), strict=True) if len(pdf) else ((), ())
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "d": d, "r": r})

    fitted = sample.where("not dictionary").mapInPandas(measure, "k long, y int, d double, r double").collect()
    if len({r.y for r in fitted}) < 2:  # hardly any labels: calibrate on the dictionaries' documents too
        fitted = sample.mapInPandas(measure, "k long, y int, d double, r double").collect()
    fitted.sort(key=lambda r: (r.k, r.y, r.d, r.r))
    x = _terms(np.array([r.d for r in fitted]), np.array([r.r for r in fitted]))
    return QualityModel(good, bad, tuple(map(float, logistic(x, np.array([r.y for r in fitted], float)))), block, level)


def score(model: QualityModel, text: str | Column = "text") -> Column:
    """Probability of label 1 of every whole text; null counts as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _sizer(model.good, model.bad, model.block, model.level)
        w = np.array(model.weights)
        for s in batches:
            a = np.array([sizes(t) for t in s], float).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(_terms(a[:, 0], a[:, 1]) @ w, -30, 30))))

    return scored(F.col(text) if isinstance(text, str) else text)
