"""The whole analysis as one lazily composed plan, written out by ``run``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.config import MODES, Analysis, HardFilter
from locusflow.operators import brm, detect, islands, normalise, raw_stats, smooth, thresholds, variants
from locusflow.sources import sinks, vcf


@dataclass
class Results:
    """Every stage's table; nothing runs before it is asked for, but for the few numbers that normalising needs."""

    judged: DataFrame
    raw: DataFrame
    smoothed: DataFrame
    markers: DataFrame
    blocks: DataFrame
    individual: DataFrame
    composite: DataFrame
    final: DataFrame
    #: What is held in memory until all is read; unpersist it then.
    held: DataFrame


def analyse(sites: DataFrame, mode: str, a: Analysis, h: HardFilter) -> Results:
    judged = variants.judged(sites, mode, a, h)
    raw = raw_stats.raw_stats(variants.passed(sites, mode, a, h), mode, a.population)
    columns = raw_stats.smoothed_columns(mode)
    smoothed = smooth.smooth(raw, columns, a.sigma)
    # read by the medians, the thresholds and every detector
    smoothed = smoothed.persist(StorageLevel.MEMORY_AND_DISK)
    z = normalise.with_composite(normalise.with_z(smoothed, columns), mode)
    markers = thresholds.with_thresholds(z, mode, a)
    blocks = brm.run(smoothed, mode, a)
    individual = detect.individual_qtls(detect.all_peaks(markers, mode), mode, a.gap)
    peaks = detect.peaks_with_fallback(markers, "CompositeZ", "CompositeZ_P99", "CompositeZ_P95", "upper", "CompositeZ")
    composite = detect.composite_qtls(peaks, a.gap)
    return Results(judged, raw, z, markers, blocks, individual, composite, detect.final_qtls(composite, blocks, a.gap), smoothed)


def write_records(judged: DataFrame, header: vcf.Header, roles: list[str], names: list[str], out: str) -> None:
    """The records that passed and those that didn't, as compressed VCF."""
    if "alt_of" not in judged.columns:
        judged = judged.withColumns({"alt_of": F.lit(0), "n_alts": F.size("alts")})
    for name, rows in (("hardfiltered", judged.where("target_alt > 0")), ("lowqual", judged.where("target_alt = 0"))):
        sinks.write_vcf(vcf.to_lines(rows, header, roles), vcf.header_text(header, names), f"{out}.{name}.vcf.gz")


def run(sites: DataFrame, mode: str, a: Analysis, h: HardFilter, out: str, header: vcf.Header | None = None, samples: dict[str, str] | None = None, genes: DataFrame | None = None) -> Results:
    """Analyse and write the tables (TSV folders, workbooks) and pages under ``out``.

    With the header and samples of a VCF, the records that passed and those
    that didn't are written too; with genes, those in the final intervals.
    """
    r = analyse(sites, mode, a, h)
    if header is not None and samples:
        roles = [x for x in MODES[mode]["roles"] if x in samples]
        write_records(r.judged, header, roles, [samples[x] for x in roles], f"{out}/stats/{mode}")
    if genes is not None:
        sinks.write_tsv(gene_overlaps(r.final.select("chrom", "start", "stop"), genes).orderBy("chrom", "start", "gstart"), f"{out}/gene_space/{mode}.genes.tsv", 4)
    sinks.write_tsv(r.raw.orderBy("chrom", "pos", "ref", "alt"), f"{out}/stats/{mode}.raw.tsv", 6)
    sinks.write_tsv(r.smoothed.orderBy("chrom", "pos"), f"{out}/stats/{mode}.smoothed_and_normalised.tsv", 6)
    names = [c for c in r.markers.columns if "_P9" in c or "_Mp9" in c]
    sinks.write_tsv(r.markers.select("chrom", "pos", "Depth", *names).orderBy("chrom", "pos"), f"{out}/stats/{mode}.thresholds.tsv", 4)
    sinks.write_tsv(r.blocks.orderBy("chrom", "start"), f"{out}/stats/{mode}.brm_blocks.tsv", 6)
    for name, table in (("individual", r.individual), ("compositez", r.composite), ("final", r.final)):
        sinks.write_workbook(table.orderBy("chrom", "start"), f"{out}/qtls/{mode}.{name}.qtl.xlsx")
    sinks.write_pages(r.markers, r.blocks, mode, f"{out}/plots")
    r.held.unpersist()
    return r


def marked_areas(markers: DataFrame, blocks: DataFrame) -> DataFrame:
    """First and last marker inside each block, for shading plots. Both sides meet by bins of a block's length."""
    size = 100_000
    m = markers.select("chrom", "pos", F.expr(f"pos div {size}").alias("bin"))
    b = blocks.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"stop div {size}"))))
    hit = b.join(m, ["chrom", "bin"]).where(F.col("pos").between(F.col("start"), F.col("stop")))
    return hit.groupBy("chrom", "start", "stop").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def gene_overlaps(qtls: DataFrame, genes: DataFrame, size: int = 1_000_000) -> DataFrame:
    """Genes (chrom, gene, gstart, gend) that overlap intervals (chrom, start, stop): an equi-join on bins, each pair once."""
    bins = lambda a, z: F.explode(F.sequence(F.expr(f"{a} div {size}"), F.expr(f"{z} div {size}")))
    g, q = genes.withColumn("bin", bins("gstart", "gend")), qtls.withColumn("bin", bins("start", "stop"))
    near = q.join(g, ["chrom", "bin"]).where((F.col("gstart") <= F.col("stop")) & (F.col("gend") >= F.col("start")))
    first = F.expr(f"greatest(start div {size}, gstart div {size})")
    return near.where(F.col("bin") == first).drop("bin")


__all__ = ["Results", "analyse", "gene_overlaps", "islands", "marked_areas", "run", "write_records"]
