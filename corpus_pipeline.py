"""Corpus preparation in five stages: quality, exact and near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import exact, minhash, mixing, packing, quality
from barloom.llm.common import fold, read, small_batches
from barloom.llm.queries import QUALITY_CUT, vocabulary
from barloom.sources.sinks import publish

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates share 80 % of their shingles of five words.
NEAR = minhash.MinHash(words=5, percent=80)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the compression classifier rejects; it learns outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = quality.fit(docs, labels)
    return docs.select(*DOCUMENT).where(quality.score(model) >= F.lit(QUALITY_CUT))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group equal but for white space."""
    small_batches(spark)
    return exact.deduplicate(docs.select(*DOCUMENT))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents that share ``NEAR`` of their shingles; texts without words all stay."""
    small_batches(spark)
    return minhash.deduplicate(docs.select(*DOCUMENT), params=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; repeated and cut documents keep their id."""
    small_batches(spark)
    return mixing.take(docs.select(*DOCUMENT))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality", keep_good), ("exact duplicates", drop_copies), ("near duplicates", drop_near_copies),
    ("mixing", mix_sources), ("packing", pack)]
#: The classifier and the near-duplicate search are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
