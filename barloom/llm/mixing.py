"""Mixing sources to target weights.

Sizes are summed per source and shared out as word budgets (``targets``).
Inside a source documents are ordered by a hash-random key.  The key's first
digits are a range, ranges are summed, their sums are accumulated, and inside a
range a window accumulates documents: a distributed prefix sum in which no task
holds a source.  The budget is cut where the prefix sum reaches it, the last
document in the middle; a budget above the source's size takes whole epochs
first.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.llm.common import SPACE, WORD
from barloom.sources.sinks import publish

WEIGHTS = (5, 2, 1)


def word_count(text: str | Column) -> Column:
    """Number of words; null counts 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Budgets of sources: (key, source_size) gains ``target``.

    Budgets are proportional to weights dealt by rank, but no more than ``most``
    times the source; what is cut off is shared by the others.  That is one
    level: with the k sources of least capacity by weight full, the rest share
    what remains.  The table has one row per source.
    """
    ranked = sizes.withColumn("_w", F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumn("_full", cap / F.col("_w"))
    before = Window.orderBy("_full", "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_full", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - zero(F.sum(cap).over(before))) / (
        F.sum("_w").over(every) - zero(F.sum("_w").over(before)))
    ranked = ranked.withColumn("_level", level)
    # The water level is that of the first source it does not fill.
    chosen = F.coalesce(F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "key", "_level"))).over(every)["_level"], F.max("_level").over(every))
    return ranked.withColumn("target", F.least(cap, chosen * F.col("_w"))).select("key", "source_size", "target")


def mix(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5,
    most: float = 2.0, weights: Sequence[int] = WEIGHTS, range_rows: int = 20000,
) -> DataFrame:
    """Words to take of every document: (id, text_hash, size, source_size, target, taken).

    One row per input row.  A null text is empty; documents without words take
    part with 0; null sources are one source, ranked last.  The order of a
    source is md5 of the id, then size, so reruns agree; rows equal in id and
    text are interchangeable.  An empty table gives an empty result.
    """
    rows = publish(docs.select(
        F.col(id).alias("id"),
        F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1")).alias("key"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.md5(F.col(id).cast("string")), F.lit("g")).alias("draw"),
    ), "mix-sizes")
    digits, n = 1, rows.count()
    while n > range_rows * 16**digits:
        digits += 1
    rows = rows.withColumn("range", F.substring("draw", 1, digits))
    ranges = rows.groupBy("key", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("skip", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    budget = targets(ranges.groupBy("key").agg(F.sum("words").alias("source_size")), share=share, most=most, weights=weights)
    inside = Window.partitionBy("key", "range").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ranges.select("key", "range", "skip"), ["key", "range"])
        .join(budget, "key"))
    whole = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = whole - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("skip") - F.col("within")))
    return placed.select(F.col("id").alias(id), "text_hash", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    """Text up to the end of its n-th word; null stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(texts, counts, strict=True):
            out.append(None if t is None else t[:next(itertools.islice(WORD.finditer(t), int(k) - 1, None)).end()])
        return pd.Series(out, dtype=object)

    return cut(text, n)


def take(docs: DataFrame, *, id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix itself, with all columns of ``docs``: a row for each epoch of a document.

    A document that the budget cuts ends behind the last word taken, and
    ``n_chars`` is counted again.  Documents without words are left out.
    """
    plan = mix(docs, id=id, text=text, **options).where("taken > 0").groupBy(F.col(id).alias("_k"), F.col("text_hash").alias("_h")).agg(
        F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    plan = publish(plan, "mix-plan")
    same = F.col(id).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_h"))
    # Equal rows share what was taken of them; one of them carries it.  The plan tells whether there are any: texts are not moved to see it.
    several = plan.where("_rows > 1")
    if several.isEmpty():
        rows = docs.join(plan, same)
    else:
        rows = docs.join(plan.where("_rows = 1"), same).unionByName(docs.join(several, same).dropDuplicates([id, text]))
    epochs, rest = F.floor(F.col("_taken") / F.col("_size")).cast("int"), (F.col("_taken") % F.col("_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), epochs), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_cut", F.explode(copies))
    part = _first_words(F.when(F.col("_cut") > 0, F.col(text)), F.col("_cut"))
    rows = rows.withColumn("_part", part)
    changed = {text: F.coalesce("_part", text)}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(F.col("_part").isNull(), F.col(n_chars)).otherwise(F.length("_part").cast("long"))
    return rows.withColumns(changed).select(*docs.columns)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0'||source, '1') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), 'g') AS draw
  FROM documents),
src AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY k) AS rk FROM sized GROUP BY k),
wts AS (SELECT *, CASE (rk-1)%3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS wt FROM src),
lev AS (
  SELECT *, 2.0*source_size/wt AS full_at,
    (1.5*sum(source_size) OVER () - coalesce(sum(2.0*source_size) OVER b, 0))/(sum(wt) OVER () - coalesce(sum(wt) OVER b, 0)) AS lvl
  FROM wts WINDOW b AS (ORDER BY 2.0*source_size/wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (
  SELECT k, source_size, least(2.0*source_size, wt*(SELECT lvl FROM lev WHERE lvl<=full_at ORDER BY full_at, k LIMIT 1))::DOUBLE AS target FROM lev),
cut AS (SELECT *, CAST(floor(target+0.5) AS BIGINT) AS goal FROM tgt),
pre AS (
  SELECT s.*, c.source_size, c.target, c.goal, CASE WHEN c.source_size>0 THEN c.goal//c.source_size ELSE 0 END AS ep,
    coalesce(sum(size) OVER (PARTITION BY s.k ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN cut c ON s.k=c.k)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(ep*size + greatest(0, least(size, goal-ep*source_size-before)) AS BIGINT) AS taken FROM pre
"""
