"""Genes from GFF3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_genes(spark: SparkSession, path: str, kind: str = "gene") -> DataFrame:
    """(chrom, gene, gstart, gend, strand, description) of the features of a kind; places count from 1, ends included.

    A gene without an ID is named by its Name, else by its place. Escaped
    characters are decoded. What follows ``##FASTA`` is no feature, as its lines
    have no nine columns.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") == 9)
    at = lambda k: F.get("f", F.lit(k))
    attribute = lambda name: F.nullif(F.url_decode(F.regexp_replace(F.regexp_extract(F.concat(F.lit(";"), F.regexp_replace(at(8), r"\s*;\s*", ";"), F.lit(";")), f";{name}=([^;]*);", 1), r"\+", "%2B")), F.lit(""))
    genes = rows.where(at(2) == kind).select(at(0).alias("chrom"), at(3).try_cast("bigint").alias("gstart"), at(4).try_cast("bigint").alias("gend"), at(6).alias("strand"), attribute("ID").alias("id"), attribute("Name").alias("name"), F.coalesce(attribute("Note"), attribute("description"), attribute("product")).alias("description"))
    genes = genes.where("gstart IS NOT NULL AND gend >= gstart")
    named = F.coalesce("id", "name", F.concat_ws(":", "chrom", F.col("gstart").cast("string")))
    return genes.select("chrom", named.alias("gene"), "gstart", "gend", "strand", "description")
