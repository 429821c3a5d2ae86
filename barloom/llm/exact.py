"""Exact duplicates, combined in three steps so that no group meets in one task.

1. Locally: inside a slice of an Arrow batch, texts equal after deleting ASCII white space
   share a leader, found by digest and then by comparing the content.
2. Salted: leaders meet by (digest, salt) and full content; one leader of each
   salt's group goes on.
3. Globally: the salts' leaders, at most one per salt and group, meet.

Content travels as a lossless zstandard frame, made alike in all tasks (same
library, same level), so equal frames and equal contents are the same thing and
two texts with one digest stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import keep_rows, slices
from barloom.sources.sinks import publish

_DELETE = b" \t\n\x0b\x0c\r"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _leaders(digest: Callable[[bytes], str], chunk: int = 2000):
    """Arrow pass (id, text) -> rows with their leader among ``chunk`` rows; leaders carry what their group needs."""
    schema = pa.schema([
        ("id", pa.int64()), ("text_hash", pa.int64()), ("row", pa.int64()), ("lead", pa.int64()), ("digest", pa.string()), ("content", pa.binary()),
        ("n", pa.int64()), ("members", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        row = (TaskContext.get().partitionId() << 36) - 1
        for batch in slices(batches, chunk):
            ids = batch.column(0).to_pylist()
            groups: dict[tuple[str, bytes], list] = {}
            out = {k: [None] * len(ids) for k in ("row", "lead", "digest", "content", "n", "members")}
            first = row + 1
            for i, t in enumerate(batch.column(1)):
                row += 1
                t = t.as_py() or ""
                bare = t.encode("utf-8", "replace").translate(None, _DELETE)
                key = (digest(bare), pack(bare))
                rank = (-len(t), ids[i] is None, ids[i] or 0, row)
                g = groups.get(key)
                if g is None:
                    groups[key] = [rank, [i]]
                else:
                    g[0] = min(g[0], rank)
                    g[1].append(i)
                out["row"][i] = row
            for (d, content), (best, members) in groups.items():
                for i in members:
                    out["lead"][i] = best[3]
                j = best[3] - first
                out["digest"][j], out["content"][j], out["n"][j], out["members"][j] = d, content, -best[0], len(members)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2)] + [pa.array(out[f.name], f.type) for f in list(schema)[2:]], schema=schema)

    return run


def assign(docs: DataFrame, *, id: str = "doc_id", text: str = "text", salts: int = 16, digest: Callable[[bytes], str] = sha256) -> DataFrame:
    """Group every row: (id, text_hash, keep_id, group_size, kept, text_sha256).

    Null texts are empty, and empty texts are equal.  Of a group the row with
    the most code points, then the smallest id, stays; null ids come last and
    of rows that are repeated in full any one is kept, so every group keeps
    exactly one row.  An empty table gives an empty result.
    """
    ids = F.col(id).cast("long").alias("id")
    rows = publish(docs.select(ids, F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
        _leaders(digest), "id long, text_hash long, row long, lead long, digest string, content binary, n long, members long"), "exact-rows")

    best = [F.col("n").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    frame = (Window.unboundedPreceding, Window.unboundedFollowing)

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys, "content").orderBy(*best).rowsBetween(*frame)
        return df.withColumns({"top": F.first("row").over(w), "top_id": F.first("id").over(w), "total": F.sum("members").over(w)})

    leaders = rows.where("row = lead").drop("lead", "text_hash").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    salted = merged(leaders, "digest", "salt")
    salted = publish(salted.select(
        "row", "top", "digest", "id", "n", F.col("total").alias("members"),
        F.when(F.col("row") == F.col("top"), F.col("content")).alias("content")), "exact-salted")
    final = merged(salted.where("row = top").drop("top"), "digest").select(
        F.col("row").alias("top"), F.col("top").alias("keep_row"), F.col("top_id").alias("keep_id"), F.col("total").alias("group_size"), "digest")
    by_lead = salted.select(F.col("row").alias("lead"), "top").join(final, "top")
    return rows.select("id", "text_hash", "row", "lead").join(by_lead, "lead").select(
        F.col("id").alias(id), "text_hash", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, assign(docs, id=id, text=text, salts=salts), id, text)


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text,'')) AS n, sha256(regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
