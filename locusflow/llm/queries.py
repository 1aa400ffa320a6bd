"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, imi, jaccard_join, line_dedup, mixing, mixing_lm, quality, token_store, toxicity, warc
from .common import Scratch, held_out, table
from .oracles import oracle_sql


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op2").path("store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.digests(token_store.open_store(spark, path))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op3").path("archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_index(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", 7, 2)
    return mixing_lm.score(table(spark, sf_dir, "documents"), ~held, held)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def _classified(spark: SparkSession, sf_dir: str, kind, held, threshold: float) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kind.train(docs, table(spark, sf_dir, "labels"), ~held)
    scored = kind.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, held_out("doc_id", 5, 0), 0.5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality, held_out("doc_id", 4, 2), 0.7)


__all__ = ["oracle_sql", "queries", "tokenizer_path"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_token_ids, op3_warc_archive, op4_decontamination, op5_toxicity, op6_nearest, op7_jaccard_join, op8_quality, op9_lm_scoring, op10_mixing)}
