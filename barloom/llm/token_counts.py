"""Tokens by section.

Each document is encoded once, as a whole.  The character spans of its tokens
are joined with the sections' intervals (both are sorted, so two binary
searches per token do), and a token that crosses a boundary goes to one section
by a stated rule: the one that holds most of its characters, the earlier one of
equals (``overlap``), or the one that holds its first or last character
(``start``, ``end``).  Section counts therefore add up to the document's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import encoder

RULES = ("overlap", "start", "end")


def sections(text: str, end: re.Pattern) -> np.ndarray:
    """Section starts and the end of the text; a section ends behind a match of ``end``."""
    cuts = [m.end() for m in end.finditer(text)]
    return np.array([0, *(c for c in cuts if 0 < c < len(text)), len(text)], np.int64)


def allocate(spans: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens allotted to each section."""
    n = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, spans[:, 0], "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(bounds, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1, 0, n - 1)
    where = first.copy() if rule != "end" else last.copy()
    crossing = np.nonzero(first != last)[0]
    if rule == "overlap":
        for i in crossing:
            k = np.arange(first[i], last[i] + 1)
            held = np.minimum(bounds[k + 1], spans[i, 1]) - np.maximum(bounds[k], spans[i, 0])
            where[i] = k[held.argmax()]
    return np.bincount(where, minlength=n), np.bincount(where[crossing], minlength=n)


def count(
    docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", end: str = "\n", rule: str = "overlap",
    batch: int = 64,
) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing), one row per section of every row.

    Spans are in code points.  Null and empty texts have one empty section with
    no tokens.  Repeated rows are counted again.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = pa.schema([("id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stop = encoder(tokenizer), re.compile(end)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(0, len(b), batch):
                part = [t or "" for t in texts.slice(i, batch).to_pylist()]
                bounds = [sections(t, stop) for t in part]
                counts = [allocate(enc.spans(t), x, rule) for t, x in zip(part, bounds, strict=True)]
                sizes = [len(x) - 1 for x in bounds]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, batch).take(pa.array(np.repeat(np.arange(len(part)), sizes))),
                    pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32()),
                    pa.array(np.concatenate([x[:-1] for x in bounds])), pa.array(np.concatenate([x[1:] for x in bounds])),
                    pa.array(np.concatenate([c for c, _ in counts])), pa.array(np.concatenate([c for _, c in counts])),
                ], schema=schema)

    out = docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(run, "id long, section int, start long, end long, n_tokens long, n_crossing long")
    return out.withColumnRenamed("id", id)
