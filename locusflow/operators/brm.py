"""Block regression: runs of markers beyond an analytic, depth-aware threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.config import MODES, TWO_BULK, Analysis, expected_af, variance_scale

from .islands import TIES, along, merged
from .raw_stats import KEY


def sites(smoothed: DataFrame, mode: str, a: Analysis) -> DataFrame:
    """The markers' keys, deviation, threshold and whether the marker is significant."""
    depth = F.greatest(F.col("Depth"), F.lit(1)).cast("double")
    scale = variance_scale(a.population)

    def pool(v: Column, n: float) -> Column:
        return v / (scale * n) * (1 - 1 / depth) + v / depth

    if mode in TWO_BULK:
        af = F.least(F.greatest((F.col("Sm_HighSI") + F.col("Sm_LowSI")) / 2, F.lit(0.05)), F.lit(0.95))
        v, deviation = af * (1 - af), F.col("Sm_DeltaSI")
        variance = pool(v, a.bulk_sizes[0]) + pool(v, a.bulk_sizes[1])
    else:
        p0 = min(max(expected_af(a.population), 0.05), 0.95)
        # as in the two-bulk null, the high bulk's size holds unless one is set for the bulk
        variance, deviation = pool(F.lit(p0 * (1 - p0)), a.one_bulk_size or a.bulk_sizes[0] or a.bulk_sizes[1] or 100), F.col("Sm_AFDev")
    threshold = a.u_alpha * F.sqrt(variance)
    return smoothed.select(*[c for c in (*KEY, "Depth") if c in smoothed.columns], deviation.alias("deviation"), threshold.alias("threshold"), ((threshold > 0) & (F.abs(deviation) >= threshold)).alias("significant"))


def blocks(marked: DataFrame) -> DataFrame:
    """Runs of significant markers; the ends lie midway to the neighbours, or on the marker at a chromosome's end."""
    order = along(marked)
    rows = marked.withColumns({"before": F.lag("pos").over(order), "after": F.lead("pos").over(order), "was": F.coalesce(F.lag("significant").over(order), F.lit(False))})
    rows = rows.where("significant").withColumn("run", F.sum(F.when(F.col("was"), 0).otherwise(1)).over(order))
    best = F.min(F.struct((-F.round(F.abs("deviation"), TIES)).alias("a"), *[c for c in (*KEY[1:], "Depth") if c in marked.columns], "deviation", "threshold"))
    found = rows.groupBy("chrom", "run").agg(F.min(F.coalesce(F.expr("(before + pos) div 2"), F.col("pos"))).alias("start"), F.max(F.coalesce(F.expr("(pos + after) div 2"), F.col("pos"))).alias("stop"), best.alias("b"))
    return found.select("chrom", "start", F.greatest("start", "stop").alias("stop"), F.col("b.pos").alias("peak_pos"), F.col("b.deviation").alias("peak"), F.col("b.threshold").alias("threshold"))


def merged_blocks(found: DataFrame, gap: int) -> DataFrame:
    """Blocks within ``gap`` that deviate to the same side, merged; a block to the other side ends a group."""
    order = Window.partitionBy("chrom").orderBy("start", F.col("stop").desc())
    side = F.signum("peak")
    rows = found.withColumn("_turn", (side != F.lag(side).over(order)).cast("int"))
    rows = rows.withColumn("_side", F.sum(F.coalesce("_turn", F.lit(0))).over(order))
    best = F.max(F.struct(F.abs("peak").alias("a"), (-F.col("start")).alias("s"), "peak_pos", "peak", "threshold")).alias("b")
    out = merged(rows, gap, [best], "start", "stop", ("chrom", "_side"))
    return out.select("chrom", "start", "stop", "b.peak_pos", "b.peak", "b.threshold")


def run(smoothed: DataFrame, mode: str, a: Analysis) -> DataFrame:
    assert mode in MODES
    return merged_blocks(blocks(sites(smoothed, mode, a)), a.gap)
