"""Variant sites made from the ``lineitem`` table by integer arithmetic: a fixture with parents and bulks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each column of a site. Spark and DuckDB give the same rows for them.
COLUMNS = """
concat('chr', CAST(l_suppkey % 5 + 1 AS VARCHAR(10))) AS chrom,
l_orderkey * 1000 + l_linenumber * 100 AS pos,
CASE WHEN l_partkey % 10 = 0 THEN 'AT' ELSE 'A' END AS ref,
CASE WHEN l_partkey % 15 = 0 THEN 'T,G' WHEN l_partkey % 10 = 5 THEN 'TC' ELSE 'T' END AS alt,
l_extendedprice / 1000 AS qual,
CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'LowQual' ELSE 'PASS' END AS flt,
CASE WHEN l_linestatus = 'O' THEN l_discount * 100 END AS qd,
l_tax * 1000 AS fs,
l_quantity / 12 AS sor,
CAST(35 + l_linenumber * 5 AS DOUBLE) AS mq,
CAST(l_linenumber - 15 AS DOUBLE) AS mqrs,
CAST(l_partkey % 30 - 22 AS DOUBLE) AS rprs,
CAST(20 + CAST(l_quantity AS INT) AS BIGINT) AS hb_ref,
CAST(20 + l_partkey % 50 + CASE WHEN l_suppkey % 5 = 0 AND l_orderkey BETWEEN 600 AND 700 THEN 60 ELSE 0 END AS BIGINT) AS hb_alt,
CAST(20 + (l_partkey * 7 + l_orderkey) % 50 AS BIGINT) AS lb_ref,
CAST(20 + (l_suppkey * 3 + l_linenumber * 11 + l_orderkey) % 50 + CASE WHEN l_suppkey % 5 = 1 AND l_orderkey BETWEEN 900 AND 1000 THEN 60 ELSE 0 END AS BIGINT) AS lb_alt,
CAST(CASE l_partkey % 8 WHEN 0 THEN 15 WHEN 1 THEN 1 ELSE 30 END AS BIGINT) AS hp_ref,
CAST(CASE l_partkey % 8 WHEN 0 THEN 15 WHEN 1 THEN 29 ELSE l_linenumber % 3 END AS BIGINT) AS hp_alt,
CAST(CASE l_orderkey % 8 WHEN 0 THEN 15 WHEN 1 THEN 30 ELSE l_linenumber % 2 END AS BIGINT) AS lp_ref,
CAST(CASE l_orderkey % 8 WHEN 0 THEN 12 WHEN 1 THEN 0 ELSE 28 END AS BIGINT) AS lp_alt,
CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 60 AS BIGINT) END AS hp_gq,
CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 60 AS BIGINT) END AS lp_gq,
CAST(CASE WHEN l_partkey % 15 = 0 THEN l_linenumber % 6 ELSE 0 END AS BIGINT) AS stray
"""


#: The columns of ``lineitem`` that a site is made of.
USED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _dealt(rows: DataFrame) -> DataFrame:
    """Over all cores, where the file is too small to be split that far."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, "l_orderkey", "l_linenumber") if rows.rdd.getNumPartitions() < cores else rows


def flat_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*USED)).selectExpr(*[c.strip() for c in COLUMNS.strip().rstrip(",").split(",\n")])


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites in the engine's schema. A second ALT has ``stray`` reads in each bulk, none in parents."""
    flat = flat_sites(spark, sf_dir)
    alts = F.split("alt", ",")
    two = F.size(alts) > 1
    none = F.lit(None).cast("array<int>")

    def sample(role: str, stray, gq) -> F.Column:
        own = F.when(two, F.array(f"{role}_alt", stray)).otherwise(F.array(f"{role}_alt"))
        total = F.col(f"{role}_ref") + F.col(f"{role}_alt") + F.when(two, stray).otherwise(F.lit(0))
        return F.struct(none.alias("gt"), total.cast("int").alias("dp"), gq.cast("int").alias("gq"), F.col(f"{role}_ref").alias("ref"), own.alias("alts")).alias(role)

    zero = F.lit(0).cast("bigint")
    return flat.select(
        "chrom", "pos", "ref", alts.alias("alts"), F.col("qual").cast("float").alias("qual"), F.col("flt").alias("filter"),
        *[F.col(a).cast("float").cast("double").alias(b) for a, b in (("qd", "QD"), ("fs", "FS"), ("sor", "SOR"), ("mq", "MQ"), ("mqrs", "MQRankSum"), ("rprs", "ReadPosRankSum"))],
        sample("hp", zero, F.col("hp_gq")), sample("lp", zero, F.col("lp_gq")), sample("hb", F.col("stray"), F.lit(None)), sample("lb", F.col("stray"), F.lit(None)),
    )
