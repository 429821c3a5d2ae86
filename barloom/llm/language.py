"""Language by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram of letters (and word
ends) is the product of its letters' vectors, permuted by their place, so that
"abc" and "cba" differ.  A document is the sum of its trigram vectors, a
language prototype the sum of its training documents' unit vectors, and the
closest prototype by cosine is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    prototypes: np.ndarray  # one unit vector per language
    seed: int


class _Encoder:
    """Document vectors; trigram vectors are kept in a table of bounded size."""

    def __init__(self, dim: int, seed: int, table: int = 16384):
        self.dim, self.seed, self.most = dim, seed, table
        self.alpha = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.int64)  # sorted
        self.rows = np.empty(0, np.int64)  # row of the table for each key
        self.table = np.empty((self.most, self.dim), np.float32)
        self.used = 0

    def _letter(self, c: int) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            if len(self.letters) > 4096:
                self.letters.clear()
            v = self.letters[c] = (np.random.default_rng([self.seed, c]).integers(0, 2, self.dim) * 2 - 1).astype(np.float32)
        return v

    def _index(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == codes[inside]
        if known.all():
            return self.rows[at]
        new = codes[~known]
        if self.used + len(new) > self.most:
            self._clear()
            new = codes
        for k in new.tolist():
            a, b, c = k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF
            self.table[self.used] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            self.used += 1
        keys = np.concatenate([self.keys, new])
        rows = np.concatenate([self.rows, np.arange(self.used - len(new), self.used)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        return self.rows[np.searchsorted(self.keys, codes)]

    def vector(self, text: str | None) -> np.ndarray | None:
        """Sum of the trigram vectors; None without any letter."""
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        low = c < 0x10000
        letter = self.alpha[np.where(low, c, 0)]
        for i in np.nonzero(~low)[0]:
            letter[i] = chr(int(c[i])).isalpha()
        if not letter.any():
            return None
        c = np.where(letter, c, 32)
        c = np.concatenate([[32], c, [32]])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]  # one word end between words
        codes, counts = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)
        out = np.zeros(self.dim, np.float32)
        for i in range(0, len(codes), self.most):
            rows = self._index(codes[i:i + self.most])
            out += counts[i:i + self.most].astype(np.float32) @ self.table[rows]
        return out


def fit(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 2000,
    dim: int = DIM, seed: int = 7,
) -> LanguageModel:
    """Prototypes from about ``per_language`` documents of each language (a hash of the id decides).

    Null languages, texts and texts without letters teach nothing.  Languages
    are columns of the model: their number must be small, as it is for any
    table of language codes.
    """
    known = docs.select(F.col(id).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    counts = known.groupBy("l").count()
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    # One row per language, and languages are columns of the model: texts of a common one must not be shuffled together.
    chosen = known.join(F.broadcast(counts.select("l", share.alias("share"))), "l").where(
        F.pmod(F.xxhash64(F.coalesce("k", F.lit(0)), F.lit(seed)), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sums = _Encoder(dim, seed), {}
        for pdf in batches:
            for lang_, t in zip(pdf["l"], pdf["t"], strict=True):
                v = enc.vector(t)
                if v is not None and (norm := float(np.linalg.norm(v))) > 0:
                    sums[lang_] = sums.get(lang_, 0.0) + np.round(v.astype(np.float64) / norm * 2**40)
        for lang_, v in sums.items():  # whole numbers: the sum does not depend on the order of tasks
            yield pd.DataFrame({"l": lang_, "i": np.arange(dim), "v": v.astype(np.int64)})

    sums = chosen.select("l", "t").mapInPandas(bundle, "l string, i int, v long").groupBy("l", "i").agg(F.sum("v").alias("v")).collect()
    names = sorted({r.l for r in sums})
    proto = np.zeros((len(names), dim))
    place = {n: j for j, n in enumerate(names)}
    for r in sums:
        proto[place[r.l], r.i] = r.v
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)
    return LanguageModel(tuple(names), proto.astype(np.float32), seed)


def predict(model: LanguageModel, text: str | Column = "text") -> Column:
    """Struct (lang, score): closest prototype and its cosine, cut to 0..1.

    ``und`` and 0 for texts that are null or have no letter, and where nothing
    was learned; equal cosines go to the first name in order.
    """

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = _Encoder(model.prototypes.shape[1], model.seed)
        for s in batches:
            names, scores = [], []
            for t in s:
                v = enc.vector(t) if model.names else None
                if v is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cos = (model.prototypes @ v).astype(float) / max(float(np.linalg.norm(v)), 1e-12)
                best = int(cos.argmax())
                names.append(model.names[best])
                scores.append(min(1.0, max(0.0, float(cos[best]))))
            yield pd.DataFrame({"lang": names, "score": scores})

    return predicted(F.col(text) if isinstance(text, str) else text)
