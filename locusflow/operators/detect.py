"""Peaks of each statistic, their consolidation, and the final merge with BRM blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.config import TWO_BULK

from .islands import merged, regions, rounded

#: Name, smoothed column, tail, slot of evidence, threshold columns (99 %, 95 %).
TWO_BULK_PEAKS = (
    ("Gstat", "Sm_Gstat", "upper", "Gstat", "Gstat_P99", "Gstat_P95"),
    ("DeltaSI+", "Sm_DeltaSI", "upper", "DeltaSI", "DeltaSI_P99", "DeltaSI_P95"),
    ("DeltaSI-", "Sm_DeltaSI", "lower", "DeltaSI", "DeltaSI_Mp99", "DeltaSI_Mp95"),
    ("ED4", "Sm_ED4", "upper", "ED", "ED4_P99", "ED4_P95"),
    ("LOD", "Sm_LOD", "upper", "LOD", "LOD_P99", "LOD_P95"),
    ("BBLogBF", "Sm_BBLogBF", "upper", "BBLogBF", "BBLogBF_P99", "BBLogBF_P95"),
)
ONE_BULK_PEAKS = (
    ("AFDev+", "Sm_AFDev", "upper", "AFDev", "AFDev_P99", "AFDev_P95"),
    ("AFDev-", "Sm_AFDev", "lower", "AFDev", "AFDev_Mp99", "AFDev_Mp95"),
    ("OneBulkGstat", "Sm_Gstat1", "upper", "OneBulkG", "OneBulkGstat_P99", "OneBulkGstat_P95"),
    ("OneBulkLOD", "Sm_LOD1", "upper", "OneBulkLOD", "OneBulkLOD_P99", "OneBulkLOD_P95"),
    ("OneBulkBBLogBF", "Sm_BBLogBF1", "upper", "OneBulkBBLogBF", "OneBulkBBLogBF_P99", "OneBulkBBLogBF_P95"),
)


def _levelled(markers: DataFrame, table: list[tuple]) -> DataFrame:
    """Peaks at the 99 % thresholds; of chromosomes without any, those at the 95 % ones. One pass for all of ``table``."""
    curves = [(F.col(value), F.col(level), tail) for _, value, tail, _, *levels in table for level in levels]
    name = lambda k: F.element_at(F.array(*[F.lit(row[k]) for row in table]), F.expr("cast(curve div 2 as int)") + 1)
    found = regions(markers, curves).withColumns({"level": F.when(F.col("curve") % 2 == 0, "p99").otherwise("p95"), "stat": name(0), "slot": name(3)})
    strict = F.max(F.col("level") == "p99").over(Window.partitionBy("chrom", "stat"))
    return found.withColumn("_strict", strict).where((F.col("level") == "p99") | ~F.col("_strict")).drop("curve", "_strict")


def peaks_with_fallback(markers: DataFrame, value: str, p99: str, p95: str, tail: str, stat: str) -> DataFrame:
    return _levelled(markers, [(stat, value, tail, stat, p99, p95)]).drop("slot")


def all_peaks(markers: DataFrame, mode: str) -> DataFrame:
    """Peaks of every statistic; ``markers`` has smoothed columns and thresholds side by side."""
    return _levelled(markers, list(TWO_BULK_PEAKS if mode in TWO_BULK else ONE_BULK_PEAKS))


def individual_qtls(found: DataFrame, mode: str, gap: int) -> DataFrame:
    """Peaks of all statistics consolidated; for each slot the last peak by (start, longer first) is the evidence."""
    slots = dict.fromkeys(x[3] for x in (TWO_BULK_PEAKS if mode in TWO_BULK else ONE_BULK_PEAKS))
    last = lambda s, c: F.max_by(F.when(F.col("slot") == s, F.col(c)), F.when(F.col("slot") == s, F.struct("start", (-F.col("end")).alias("e")))).alias(f"{s}_{'Pos' if c == 'peak_pos' else 'Value'}")
    evidence = [last(s, c) for s in slots for c in ("peak_pos", "peak_value")]
    return merged(found, gap, [F.min(F.when(F.col("level") == "p99", "p99").otherwise("zp95")).alias("t"), *evidence]).withColumn("threshold", F.regexp_replace("t", "^z", "")).drop("t")


def composite_qtls(found: DataFrame, gap: int) -> DataFrame:
    """Composite peaks merged; the highest point, the stricter level."""
    best = F.max(F.struct(F.col("peak_value").alias("v"), (-F.col("start")).alias("s"), "peak_pos")).alias("b")
    out = merged(found, gap, [best, F.max("level").alias("level")])
    return out.select("chrom", "start", "end", F.col("b.peak_pos").alias("peak_pos"), F.col("b.v").alias("peak_value"), "level")


def final_qtls(composite: DataFrame, blocks: DataFrame, gap: int) -> DataFrame:
    """Union of composite peaks and BRM blocks, merged, with what supports each."""
    q = composite.select("chrom", rounded(F.col("start")).alias("start"), rounded(F.col("end")).alias("stop"), F.struct("peak_value", (-F.col("start")).alias("s"), "peak_pos", "level").alias("q"))
    b = blocks.select("chrom", "start", "stop", F.struct(F.abs("peak").alias("a"), (-F.col("start")).cast("double").alias("s"), "peak", "threshold").alias("b"))
    both = q.unionByName(b, allowMissingColumns=True)
    out = merged(both, gap, [F.max("q").alias("q"), F.max("b").alias("b")], "start", "stop")
    source = F.when(F.col("q").isNotNull() & F.col("b").isNotNull(), "CompositeZ+BRM").when(F.col("q").isNotNull(), "CompositeZ").otherwise("BRM")
    return out.select("chrom", "start", "stop", source.alias("source"), F.col("q.level").alias("threshold"), F.col("q.peak_pos").alias("compositez_pos"), F.col("q.peak_value").alias("compositez_value"), F.col("b.peak").alias("brm_peak"), F.col("b.threshold").alias("brm_threshold"))
