"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet and read again. ORACLE_SQL is None: the classifier
and the tokenizer can't be put in SQL; tests hold the stages against
brute-force versions instead.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import decontamination, jaccard_join, mixing, quality, token_store
from locusflow.llm.common import Scratch, held_out, table
from locusflow.llm.queries import tokenizer_path

QUALITY_THRESHOLD = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 8) doesn't reject; it learns from the rows that op8 learns from."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return quality.score(docs, model, docs.columns, "_quality").where(F.col("_quality") >= QUALITY_THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of the n-gram Jaccard join (operator 7)."""
    return jaccard_join.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage (operator 4)."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule (operator 10): files by number, rows by place."""
    total, parts = docs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # columns named like those of the schedule step aside
    aside = {c: f"_own_{c}" for c in ("position", "slot", "block", "phase") if c in docs.columns}
    mixed = mixing.mix(docs.withColumnsRenamed(aside))
    part = F.expr(f"cast(position * {parts} div {max(total, 1)} as int)")
    placed = mixed.withColumn("_part", part).repartitionById(parts, "_part").sortWithinPartitions("position")
    return placed.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (operator 2) in the order of the files read, that of the mixture; by doc_id where docs isn't from files."""
    order = None
    if docs.inputFiles():
        # the struct itself is named, as docs may have columns of its fields' names
        order = [F.regexp_extract(F.col("_metadata")["file_name"], r"part-(\d+)", 1).cast("bigint"), F.col("_metadata")["row_index"]]
    path = Scratch(spark, "tokens").path("store")
    token_store.write_store(docs, path, tokenizer_path(), order=order)
    return token_store.digests(token_store.open_store(spark, path))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token ids", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
        # the driver holds plans and broadcasts of a finished stage until both sides of it collect them
        gc.collect()
        spark._jvm.System.gc()
    return docs
