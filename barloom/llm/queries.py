"""Registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    alignment,
    exact,
    html_text,
    language,
    line_labels,
    minhash,
    mixing,
    multi_index,
    packing,
    phrases,
    quality,
    token_counts,
    whitening,
)
from barloom.llm.common import fold, read

QUALITY_CUT = 0.3
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = quality.fit(docs, labels)
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), quality.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_CUT).cast("int"))


@query("op2_tokens")
def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), vocabulary())


@query("op3_minhash")
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))  # rows of one id together


@query("op4_html")
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "pages").select("page_id", "url", html_text.extract("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op5_vectors")
def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multi_index.near_vectors(read(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))  # rows of one id together


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold("doc_id", 3) != 1))
    held = fold("doc_id", 3) == 1
    out = docs.select("doc_id", held.alias("held_out"), language.predict(model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op7_exact", exact.EXACT_SQL)
def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.assign(read(spark, sf_dir, "documents")).drop("text_hash")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary())


@query("op9_phrases")
def op9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


@query("op10_mixing", mixing.MIX_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("text_hash")


@query("op11_lines")
def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_labels.fit(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return line_labels.judge(line_labels.label_lines(docs, field, spans=False))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read(spark, sf_dir, "documents"), vocabulary(), vocabulary(PIECES))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_long(read(spark, sf_dir, "embeddings"))
