"""One query for each operator of the engine, over the whole adapter table, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.config import MODES, Analysis, HardFilter, expected_af, inverse_normal, variance_scale
from locusflow.functions import alleles
from locusflow.operators import brm, detect, normalise, raw_stats, smooth, thresholds, variants
from locusflow.sources.adapter import flat_sites, sites

from . import sql
from .analysis import gene_overlaps, marked_areas

#: Positions of the adapter are dense, so its windows are small; bulks of 500 make some blocks significant.
SMALL = Analysis(window_size=40_000, bulk_sizes=(500, 500))
STRICT_GQ = Analysis(min_gq=20)
POPULATIONS = ("F2", "F3", "F4", "RIL", "BC1H", "BC1L", "BC2H", "BC3F2H", "BC1F2L")
TWO, ONE = "2b", "hphb"
TWO_COLUMNS, ONE_COLUMNS = raw_stats.smoothed_columns(TWO), raw_stats.smoothed_columns(ONE)
#: Deterministic thresholds that differ by marker: 99 % and 95 % of each statistic.
LEVELS = {
    "Gstat_P99": "12 + Depth % 7 * 0.5::DOUBLE", "Gstat_P95": "8 + Depth % 7 * 0.5::DOUBLE",
    "DeltaSI_P99": "0.12::DOUBLE + Depth % 5 * 0.01::DOUBLE", "DeltaSI_P95": "0.06::DOUBLE + Depth % 5 * 0.01::DOUBLE",
    "DeltaSI_Mp99": "-0.12::DOUBLE - Depth % 5 * 0.01::DOUBLE", "DeltaSI_Mp95": "-0.06::DOUBLE - Depth % 5 * 0.01::DOUBLE",
    "ED4_P99": "0.02::DOUBLE", "ED4_P95": "0.01::DOUBLE", "LOD_P99": "2.6::DOUBLE", "LOD_P95": "1.8::DOUBLE", "BBLogBF_P99": "1.6::DOUBLE", "BBLogBF_P95": "0.8::DOUBLE",
}
#: A table of thresholds by depth that needs no simulation.
DEPTH_ROWS = {"Gstat_P99": "12 + Depth % 7 * 0.5D", "DeltaSI_P99": "1.5D / (Depth + 1)", "DeltaSI_Mp99": "-1.5D / (Depth + 1)"}
ONE_LEVELS = {
    "AFDev_P99": "0.12::DOUBLE + Depth % 5 * 0.01::DOUBLE", "AFDev_P95": "0.06::DOUBLE + Depth % 5 * 0.01::DOUBLE", "AFDev_Mp99": "-0.12::DOUBLE - Depth % 5 * 0.01::DOUBLE", "AFDev_Mp95": "-0.06::DOUBLE - Depth % 5 * 0.01::DOUBLE",
    "OneBulkGstat_P99": "8 + Depth % 7 * 0.5::DOUBLE", "OneBulkGstat_P95": "5 + Depth % 7 * 0.5::DOUBLE", "OneBulkLOD_P99": "1.8::DOUBLE", "OneBulkLOD_P95": "1.1::DOUBLE", "OneBulkBBLogBF_P99": "1.1::DOUBLE", "OneBulkBBLogBF_P95": "0.4::DOUBLE",
}


def _r4(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles at four places; integers as long."""
    out = []
    for name, kind in df.select(*keep).dtypes if keep else df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c * 1e4) / 1e4 if kind == "double" else c.cast("bigint") if kind in ("int", "bigint") else c).alias(name))
    return df.select(*out)


def _raw_all(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return _r4(raw_stats.raw_stats(variants.passed(sites(spark, d), mode, Analysis(), HardFilter()), mode))


def _raw(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return raw_stats.raw_stats(variants.passed(sites(spark, d), mode, SMALL, HardFilter(light=True)), mode)


def _smoothed(spark: SparkSession, d: str, mode: str) -> DataFrame:
    columns = raw_stats.smoothed_columns(mode)
    return smooth.smooth(_raw(spark, d, mode).select(*raw_stats.KEY, "Depth", *columns), columns, SMALL.sigma)


#: The smoothed markers of the table in use, which several passes of one query read.
_HELD: dict[tuple, DataFrame] = {}


def _kept(spark: SparkSession, d: str, mode: str = TWO) -> DataFrame:
    """Smoothed markers, dealt by chromosome for the windows to come; held for one table at a time."""
    key = (spark.sparkContext.applicationId, d, mode)
    if key not in _HELD or not _HELD[key].storageLevel.useMemory:
        for df in _HELD.values():
            if df.sparkSession.sparkContext.applicationId == key[0]:
                df.unpersist()
        _HELD.clear()
        _HELD[key] = _smoothed(spark, d, mode).repartition("chrom").persist(StorageLevel.MEMORY_AND_DISK)
    return _HELD[key]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return normalise.with_composite(normalise.with_z(_kept(spark, d), TWO_COLUMNS), TWO)


def _one_scored(spark: SparkSession, d: str) -> DataFrame:
    return normalise.with_composite(normalise.with_z(_kept(spark, d, ONE), ONE_COLUMNS), ONE)


def _markers(spark: SparkSession, d: str, mode: str = TWO) -> DataFrame:
    levels = LEVELS if mode == TWO else ONE_LEVELS
    return _kept(spark, d, mode).withColumns({k: F.expr(v.replace("::DOUBLE", "D")).cast("double") for k, v in levels.items()})


def _key(df: DataFrame) -> DataFrame:
    return df.select("chrom", F.col("pos").cast("bigint").alias("pos"), "ref", F.get("alts", F.lit(0)).alias("alt"))


def _level_columns(levels: dict[str, str]) -> str:
    return ", ".join(f"({v})::DOUBLE AS {k}" for k, v in levels.items())


_WITH_TWO = f"WITH {sql.smoothed(TWO, TWO_COLUMNS, SMALL)}"
_WITH_ONE = f"WITH {sql.smoothed(ONE, ONE_COLUMNS, SMALL)}"
_MARKERS = f"{_WITH_TWO}, markers AS (SELECT *, {_level_columns(LEVELS)} FROM smoothed)"
_ONE_MARKERS = f"{_WITH_ONE}, markers AS (SELECT *, {_level_columns(ONE_LEVELS)} FROM smoothed)"
_SCORED = f"WITH {sql.scored(TWO, TWO_COLUMNS, normalise.COMPOSITE[True], SMALL)}"
_PEAK = f'chrom, {sql.r4("start")} AS start, {sql.r4(chr(34) + "end" + chr(34))} AS "end", peak_pos, {sql.r4("peak_value")} AS peak_value, {sql.r4("threshold")} AS threshold'
_BLOCK = f"chrom, start, stop, peak_pos, {sql.r4('peak')} AS peak, {sql.r4('threshold')} AS threshold"
_ONE_SCORED = f"WITH {sql.scored(ONE, ONE_COLUMNS, normalise.COMPOSITE[False], SMALL)}"


def _composite(scored: str) -> str:
    return f"""{scored}, {sql.fallback('p', 'scored', 'CompositeZ', '2.576::DOUBLE', '1.96::DOUBLE', 'upper')}, {sql.grouped('pg', 'p', SMALL.gap)},
pr AS (SELECT *, row_number() OVER (PARTITION BY chrom, g ORDER BY peak_value DESC, start) AS k FROM pg),
composite AS (SELECT chrom, min(start) AS start, max("end") AS "end", max(CASE WHEN k = 1 THEN peak_pos END) AS peak_pos, max(CASE WHEN k = 1 THEN peak_value END) AS peak_value, max(level) AS level FROM pr GROUP BY chrom, g)"""


_COMPOSITE = _composite(_SCORED)

# -- sites and filters --------------------------------------------------------


def sites_adapter(spark, d):
    return _r4(flat_sites(spark, d))


def decompose_multiallelic(spark, d):
    rows = variants.decompose(sites(spark, d))
    one = lambda r: F.get(F.col(f"{r}.alts"), F.lit(0)).alias(f"{r}_alt")
    return rows.select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), one("hb"), one("lb"), one("hp"), one("lp"), F.col("hb.dp").cast("bigint").alias("hb_dp"))


def variant_class(spark, d):
    return sites(spark, d).select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), alleles.is_snp(F.col("ref"), F.col("alts")).cast("bigint").alias("is_snp"))


def hard_filter(light, spark, d):
    return _key(variants.decompose(sites(spark, d)).where(variants.passes_hard(HardFilter(light=light))))


def bsa_filter(mode, spark, d):
    return _key(variants.passed(sites(spark, d), mode, STRICT_GQ, HardFilter(light=True)))


def target_alt_unsplit(spark, d):
    a = Analysis(split_multiallelic=False)
    return variants.judged(sites(spark, d), TWO, a, HardFilter(light=True)).select("chrom", "pos", F.array_join("alts", ",").alias("alt"), F.col("target_alt").cast("bigint").alias("target_alt"))


def filter_counts(spark, d):
    j = variants.judged(sites(spark, d), TWO, Analysis(), HardFilter())
    return j.agg(F.count("*").alias("entered"), F.count_if(F.col("target_alt") > 0).alias("kept"), F.count_if(F.col("target_alt") == 0).alias("rejected"))


# -- smoothing, scores --------------------------------------------------------


def smooth_two_bulk(spark, d):
    return _r4(_smoothed(spark, d, TWO), *raw_stats.KEY, "n_contrib", *[f"Sm_{c}" for c in TWO_COLUMNS])


def smooth_one_bulk(spark, d):
    return _r4(_smoothed(spark, d, ONE), *raw_stats.KEY, "n_contrib", *[f"Sm_{c}" for c in ONE_COLUMNS])


def smooth_sparse(spark, d):
    raw = _raw(spark, d, TWO).select(*raw_stats.KEY, "Depth", "DeltaSI")
    return _r4(smooth.smooth(raw, ["DeltaSI"], 1000.0, method="join"), *raw_stats.KEY, "n_contrib", "Sm_DeltaSI")


def robust_z(spark, d):
    return _r4(_scored(spark, d), *raw_stats.KEY, *[f"Z_{c}" for c in TWO_COLUMNS])


def composite_z(spark, d):
    return _r4(_scored(spark, d), *raw_stats.KEY, "CompositeZ", "MaxAbsZ")


def distinct_depths(spark, d):
    return normalise.distinct_depths(_raw(spark, d, TWO))


def upper_median_depth(spark, d):
    return normalise.upper_median_depth(_raw(spark, d, TWO))


# -- detection ----------------------------------------------------------------


def brm_sites(spark, d):
    return _r4(brm.sites(_smoothed(spark, d, TWO), TWO, SMALL).withColumn("significant", F.col("significant").cast("bigint")))


def brm_blocks_two_bulk(spark, d):
    return _r4(brm.blocks(brm.sites(_smoothed(spark, d, TWO), TWO, SMALL)))


def brm_blocks_one_bulk(spark, d):
    return _r4(brm.blocks(brm.sites(_smoothed(spark, d, ONE), ONE, SMALL)))


def brm_merged(spark, d):
    return _r4(brm.run(_kept(spark, d), TWO, SMALL))


def peaks_gstat(spark, d):
    return _r4(detect.peaks_with_fallback(_markers(spark, d), "Sm_Gstat", "Gstat_P99", "Gstat_P95", "upper", "Gstat").drop("stat"))


def peaks_deltasi_lower(spark, d):
    return _r4(detect.peaks_with_fallback(_markers(spark, d), "Sm_DeltaSI", "DeltaSI_Mp99", "DeltaSI_Mp95", "lower", "DeltaSI-").drop("stat"))


def _composite_peaks(spark, d):
    rows = _scored(spark, d).withColumns({"p99": F.lit(2.576), "p95": F.lit(1.96)})
    return detect.peaks_with_fallback(rows, "CompositeZ", "p99", "p95", "upper", "CompositeZ")


def peaks_composite(spark, d):
    return _r4(_composite_peaks(spark, d).drop("stat"))


def qtl_individual(spark, d):
    return _r4(detect.individual_qtls(detect.all_peaks(_markers(spark, d), TWO), TWO, SMALL.gap))


def qtl_individual_one_bulk(spark, d):
    return _r4(detect.individual_qtls(detect.all_peaks(_markers(spark, d, ONE), ONE), ONE, SMALL.gap))


def peaks_afdev(spark, d):
    return _r4(detect.peaks_with_fallback(_markers(spark, d, ONE), "Sm_AFDev", "AFDev_P99", "AFDev_P95", "upper", "AFDev+").drop("stat"))


def qtl_composite_one_bulk(spark, d):
    rows = _one_scored(spark, d).withColumns({"p99": F.lit(2.576), "p95": F.lit(1.96)})
    return _r4(detect.composite_qtls(detect.peaks_with_fallback(rows, "CompositeZ", "p99", "p95", "upper", "CompositeZ"), SMALL.gap))


def qtl_composite(spark, d):
    return _r4(detect.composite_qtls(_composite_peaks(spark, d), SMALL.gap))


def qtl_final(spark, d):
    return _r4(detect.final_qtls(detect.composite_qtls(_composite_peaks(spark, d), SMALL.gap), brm.run(_kept(spark, d), TWO, SMALL), SMALL.gap))


# -- plots, genes, parameters, simulation -------------------------------------


def plot_series(spark, d):
    columns = ["Sm_DeltaSI", "Sm_Gstat", "Sm_LOD"]
    return _r4(_smoothed(spark, d, TWO).select("chrom", "pos", F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in columns])).alias("x")).select("chrom", "pos", "x.series", "x.value"))


def plot_threshold_means(spark, d):
    return _r4(_markers(spark, d).groupBy("chrom").agg(*[F.avg(c).alias(c) for c in ("Gstat_P99", "Gstat_P95", "DeltaSI_P99", "DeltaSI_Mp99")]))


def brm_mark_areas(spark, d):
    s = _kept(spark, d)
    return _r4(marked_areas(s, brm.blocks(brm.sites(s, TWO, SMALL))))


def gene_overlap(spark, d):
    genes = spark.range(0, 4000).select(F.concat(F.lit("chr"), (F.col("id") % 5 + 1).cast("string")).alias("chrom"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("gene"), (F.col("id") * 15000).alias("gstart"), (F.col("id") * 15000 + 9000).alias("gend"))
    return gene_overlaps(brm.run(_kept(spark, d), TWO, SMALL).select("chrom", "start", "stop"), genes)


def pop_parameters(spark, d):
    rows = ", ".join(f"('{p}', {expected_af(p)!r}D, {variance_scale(p)!r}D)" for p in POPULATIONS)
    return _r4(spark.sql(f"SELECT * FROM VALUES {rows} AS t(population, expected_af, variance_scale)").withColumn("u_alpha", F.lit(inverse_normal(0.975))))


def thresholds_two_bulk(spark, d):
    return thresholds.by_depth(normalise.distinct_depths(_raw(spark, d, TWO)), TWO, SMALL)


def thresholds_one_bulk(spark, d):
    return thresholds.by_depth(normalise.distinct_depths(_raw(spark, d, ONE)), ONE, SMALL)


def robust_z_one_bulk(spark, d):
    return _r4(_one_scored(spark, d), *raw_stats.KEY, *[f"Z_{c}" for c in ONE_COLUMNS], "CompositeZ", "MaxAbsZ")


def site_thresholds(spark, d):
    """Each site with the row of its depth, and the two constants that every site gets."""
    table = spark.range(0, 400).select(F.col("id").alias("Depth")).select("Depth", *[F.expr(e).cast("double").alias(c) for c, e in DEPTH_ROWS.items()])
    joined = thresholds.joined(_kept(spark, d).select(*raw_stats.KEY, "Depth"), table, (3.25, 2.125))
    return _r4(joined, *raw_stats.KEY, "Depth", *DEPTH_ROWS, "Z_P99", "Z_P95", "CompositeZ_P99", "CompositeZ_P95")


def composite_threshold(spark, d):
    depth = int(normalise.upper_median_depth(_raw(spark, d, TWO)).first()["depth"])
    p99, p95 = thresholds.composite_levels(depth, TWO, SMALL)
    return spark.range(1).select(F.lit(depth).alias("depth"), F.lit(p99).alias("CompositeZ_P99"), F.lit(p95).alias("CompositeZ_P95"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        sites_adapter, decompose_multiallelic, variant_class, target_alt_unsplit, filter_counts, smooth_two_bulk, smooth_one_bulk, smooth_sparse, robust_z, composite_z, distinct_depths, upper_median_depth,
        brm_sites, brm_blocks_two_bulk, brm_blocks_one_bulk, brm_merged, peaks_gstat, peaks_deltasi_lower, peaks_composite, peaks_afdev, qtl_individual, qtl_individual_one_bulk, qtl_composite, qtl_composite_one_bulk, qtl_final, site_thresholds, robust_z_one_bulk,
        plot_series, plot_threshold_means, brm_mark_areas, gene_overlap, pop_parameters, thresholds_two_bulk, thresholds_one_bulk, composite_threshold,
    )
    found = {f.__name__: f for f in plain}
    found |= {"hard_filter_strict": partial(hard_filter, False), "hard_filter_light": partial(hard_filter, True)}
    found |= {f"bsa_filter_{m}": partial(bsa_filter, m) for m in MODES}
    found |= {f"raw_stats_{m}": partial(_raw_all, mode=m) for m in MODES}
    return found


def oracle_sql() -> dict[str, str]:
    r4 = sql.r4
    dec = f"WITH {sql.SITES}, {sql.DEC}"
    sm = lambda cols: "chrom, pos, ref, alt, n_contrib, " + ", ".join(f"{r4(f'Sm_{c}')} AS Sm_{c}" for c in cols)
    numbers = ("qual", "qd", "fs", "sor", "mq", "mqrs", "rprs")
    names = [c.rsplit(" AS ", 1)[1].strip().rstrip(",") for c in sql.COLUMNS.strip().split(",\n")]
    unsplit = "(hb_ref + hb_alt + stray >= 40 AND lb_ref + lb_alt + stray >= 40)"
    out = {
        "sites_adapter": f"WITH {sql.SITES} SELECT {', '.join(f'{r4(n)} AS {n}' if n in numbers else n for n in names)} FROM sites",
        "decompose_multiallelic": f"{dec} SELECT chrom, pos, ref, alt, hb_alt, lb_alt, hp_alt, lp_alt, hb_dp FROM dec",
        "variant_class": f"WITH {sql.SITES} SELECT chrom, pos, ref, alt, (length(string_split(alt, ',')[1]) = length(ref) AND (alt NOT LIKE '%,%' OR length(string_split(alt, ',')[2]) = length(ref)))::BIGINT AS is_snp FROM sites",
        "hard_filter_strict": f"{dec} SELECT chrom, pos, ref, alt FROM dec WHERE {sql.hard(False)}",
        "hard_filter_light": f"{dec} SELECT chrom, pos, ref, alt FROM dec WHERE {sql.hard(True)}",
        "target_alt_unsplit": f"""WITH {sql.SITES}, s AS (SELECT chrom, pos, ref, alt AS alts, flt, CAST(CAST(qual AS FLOAT) AS DOUBLE) AS qual, CAST(CAST(qd AS FLOAT) AS DOUBLE) AS qd, CAST(CAST(fs AS FLOAT) AS DOUBLE) AS fs, CAST(CAST(sor AS FLOAT) AS DOUBLE) AS sor, mq, mqrs, rprs, hb_ref, hb_alt, lb_ref, lb_alt, stray,
            CASE WHEN alt LIKE '%,%' AND length(ref) = 2 THEN 'T' ELSE string_split(alt, ',')[1] END AS alt FROM sites)
            SELECT chrom, pos, alts AS alt, CASE WHEN NOT ({sql.hard(True)} AND {unsplit}) THEN 0
            WHEN stray <= 0.05 * (hb_ref + hb_alt + stray) AND stray <= 0.05 * (lb_ref + lb_alt + stray) THEN 1
            WHEN alts LIKE '%,%' AND hb_alt <= 0.05 * (hb_ref + hb_alt + stray) AND lb_alt <= 0.05 * (lb_ref + lb_alt + stray) THEN 2 ELSE 0 END::BIGINT AS target_alt FROM s""",
        "filter_counts": f"{dec}, j AS (SELECT {sql.hard(False)} AND {sql.fits(TWO, Analysis())} AS ok FROM dec) SELECT count(*) AS entered, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS rejected FROM j",
        "smooth_two_bulk": f"{_WITH_TWO} SELECT {sm(TWO_COLUMNS)} FROM smoothed",
        "smooth_one_bulk": f"{_WITH_ONE} SELECT {sm(ONE_COLUMNS)} FROM smoothed",
        "smooth_sparse": f"WITH {sql.smoothed(TWO, ['DeltaSI'], Analysis(window_size=2000))} SELECT {sm(['DeltaSI'])} FROM smoothed",
        "robust_z": f"{_SCORED} SELECT chrom, pos, ref, alt, {', '.join(f'{r4(f'Z_{c}')} AS Z_{c}' for c in TWO_COLUMNS)} FROM scored",
        "composite_z": f"{_SCORED} SELECT chrom, pos, ref, alt, {r4('CompositeZ')} AS CompositeZ, {r4('MaxAbsZ')} AS MaxAbsZ FROM scored",
        "distinct_depths": f"WITH {sql.counts(TWO, SMALL, True)}, {sql.stats_cte(TWO, 'counts', 'raw')} SELECT DISTINCT Depth FROM raw WHERE Depth > 0",
        "upper_median_depth": f"WITH {sql.counts(TWO, SMALL, True)}, {sql.stats_cte(TWO, 'counts', 'raw')}, o AS (SELECT Depth, row_number() OVER (ORDER BY Depth) AS k, count(*) OVER () AS n FROM raw) SELECT Depth AS depth FROM o WHERE k = n // 2 + 1",
        "brm_sites": f"{_WITH_TWO}, {sql.brm_ctes(TWO, SMALL)} SELECT chrom, pos, ref, alt, Depth, {r4('deviation')} AS deviation, {r4('threshold')} AS threshold, significant::BIGINT AS significant FROM brm_sites",
        "brm_blocks_two_bulk": f"{_WITH_TWO}, {sql.brm_ctes(TWO, SMALL)} SELECT {_BLOCK} FROM brm_blocks",
        "brm_blocks_one_bulk": f"{_WITH_ONE}, {sql.brm_ctes(ONE, SMALL)} SELECT {_BLOCK} FROM brm_blocks",
        "brm_merged": f"{_WITH_TWO}, {sql.brm_ctes(TWO, SMALL)} SELECT {_BLOCK} FROM brm_merged",
        "peaks_gstat": f"{_MARKERS}, {sql.fallback('p', 'markers', 'Sm_Gstat', 'Gstat_P99', 'Gstat_P95', 'upper')} SELECT {_PEAK}, level FROM p",
        "peaks_deltasi_lower": f"{_MARKERS}, {sql.fallback('p', 'markers', 'Sm_DeltaSI', 'DeltaSI_Mp99', 'DeltaSI_Mp95', 'lower')} SELECT {_PEAK}, level FROM p",
        "peaks_composite": f"{_SCORED}, {sql.fallback('p', 'scored', 'CompositeZ', '2.576::DOUBLE', '1.96::DOUBLE', 'upper')} SELECT {_PEAK}, level FROM p",
        "qtl_individual": _individual_sql(_MARKERS, detect.TWO_BULK_PEAKS),
        "qtl_individual_one_bulk": _individual_sql(_ONE_MARKERS, detect.ONE_BULK_PEAKS),
        "peaks_afdev": f"{_ONE_MARKERS}, {sql.fallback('p', 'markers', 'Sm_AFDev', 'AFDev_P99', 'AFDev_P95', 'upper')} SELECT {_PEAK}, level FROM p",
        "qtl_composite_one_bulk": f'{_composite(_ONE_SCORED)} SELECT chrom, {r4("start")} AS start, {r4(chr(34) + "end" + chr(34))} AS "end", peak_pos, {r4("peak_value")} AS peak_value, level FROM composite',
        "robust_z_one_bulk": f"{_ONE_SCORED} SELECT chrom, pos, ref, alt, {', '.join(f'{r4(c)} AS {c}' for c in (*(f'Z_{c}' for c in ONE_COLUMNS), 'CompositeZ', 'MaxAbsZ'))} FROM scored",
        "site_thresholds": f"{_WITH_TWO}, t AS (SELECT Depth, {', '.join(f'({e.replace(chr(68) + ' ', '::DOUBLE ').replace('0.5D', '0.5::DOUBLE')})::DOUBLE AS {c}' for c, e in DEPTH_ROWS.items())} FROM range(400) r(Depth)) SELECT chrom, pos, ref, alt, s.Depth, {', '.join(f'{r4(c)} AS {c}' for c in DEPTH_ROWS)}, 2.576::DOUBLE AS Z_P99, 1.96::DOUBLE AS Z_P95, 3.25::DOUBLE AS CompositeZ_P99, 2.125::DOUBLE AS CompositeZ_P95 FROM smoothed s LEFT JOIN t ON s.Depth = t.Depth",
        "qtl_composite": f'{_COMPOSITE} SELECT chrom, {r4("start")} AS start, {r4(chr(34) + "end" + chr(34))} AS "end", peak_pos, {r4("peak_value")} AS peak_value, level FROM composite',
        "qtl_final": f"""{_COMPOSITE}, {sql.brm_ctes(TWO, SMALL)},
            u AS (SELECT chrom, round(start)::BIGINT AS start, round("end")::BIGINT AS stop, peak_pos, peak_value, level, NULL::DOUBLE AS peak, NULL::DOUBLE AS threshold FROM composite UNION ALL SELECT chrom, start, stop, NULL, NULL, NULL, peak, threshold FROM brm_merged),
            {sql.grouped('ug', 'u', SMALL.gap, 'stop')},
            ur AS (SELECT *, row_number() OVER (PARTITION BY chrom, g ORDER BY peak_value DESC NULLS LAST, start) AS kq, row_number() OVER (PARTITION BY chrom, g ORDER BY abs(peak) DESC NULLS LAST, start) AS kb FROM ug)
            SELECT chrom, min(start) AS start, max(stop) AS stop, CASE WHEN count(peak_value) > 0 AND count(peak) > 0 THEN 'CompositeZ+BRM' WHEN count(peak_value) > 0 THEN 'CompositeZ' ELSE 'BRM' END AS source,
            max(CASE WHEN kq = 1 THEN level END) AS threshold, max(CASE WHEN kq = 1 THEN peak_pos END) AS compositez_pos, {r4('max(CASE WHEN kq = 1 THEN peak_value END)')} AS compositez_value, {r4('max(CASE WHEN kb = 1 THEN peak END)')} AS brm_peak, {r4('max(CASE WHEN kb = 1 THEN threshold END)')} AS brm_threshold FROM ur GROUP BY chrom, g""",
        "plot_series": f"{_WITH_TWO} " + " UNION ALL ".join(f"SELECT chrom, pos, '{c}' AS series, {r4(c)} AS value FROM smoothed" for c in ("Sm_DeltaSI", "Sm_Gstat", "Sm_LOD")),
        "plot_threshold_means": f"{_MARKERS} SELECT chrom, {', '.join(f'{r4(f'avg({c})')} AS {c}' for c in ('Gstat_P99', 'Gstat_P95', 'DeltaSI_P99', 'DeltaSI_Mp99'))} FROM markers GROUP BY chrom",
        "brm_mark_areas": f"{_WITH_TWO}, {sql.brm_ctes(TWO, SMALL)} SELECT b.chrom, b.start, b.stop, min(m.pos) AS first_pos, max(m.pos) AS last_pos FROM brm_blocks b JOIN smoothed m ON m.chrom = b.chrom AND m.pos BETWEEN b.start AND b.stop GROUP BY b.chrom, b.start, b.stop",
        "gene_overlap": f"{_WITH_TWO}, {sql.brm_ctes(TWO, SMALL)}, genes AS (SELECT concat('chr', i % 5 + 1) AS chrom, concat('g', i) AS gene, i * 15000 AS gstart, i * 15000 + 9000 AS gend FROM range(4000) t(i)) SELECT q.chrom, q.start, q.stop, gene, gstart, gend FROM brm_merged q JOIN genes g ON g.chrom = q.chrom AND gstart <= q.stop AND gend >= q.start",
        "pop_parameters": "SELECT population, " + f"{r4('expected_af')} AS expected_af, {r4('variance_scale')} AS variance_scale, {r4('1.9599639845400545::DOUBLE')} AS u_alpha FROM (VALUES "
        "('F2', 0.5::DOUBLE, 2::DOUBLE), ('F3', 0.5, 4.0 / 3), ('F4', 0.5, 8.0 / 7), ('RIL', 0.5, 1), ('BC1H', 0.75, 3), ('BC1L', 0.25, 3), ('BC2H', 0.875, 7.0 / 3), ('BC3F2H', 0.9375, 15.0 / 11), ('BC1F2L', 0.25, 1.5)) t(population, expected_af, variance_scale)",
    }
    for m in MODES:
        out[f"bsa_filter_{m}"] = f"{dec} SELECT chrom, pos, ref, alt FROM dec WHERE {sql.hard(True)} AND {sql.fits(m, STRICT_GQ)}"
        columns = sql.statistics(m)
        counts = [f"{n}{x}" for r, n in (("hb", "High"), ("lb", "Low")) if r in MODES[m]["roles"] for x in "HL"]
        out[f"raw_stats_{m}"] = f"WITH {sql.counts(m, Analysis(), False)}, {sql.stats_cte(m, 'counts', 'raw')} SELECT chrom, pos, ref, alt, {', '.join(counts)}, {', '.join(c if c == 'Depth' else f'{r4(c)} AS {c}' for c in columns)} FROM raw"
    return out


def _individual_sql(markers: str, table: tuple) -> str:
    parts, names = [], []
    for k, (_, value, tail, slot, p99, p95) in enumerate(table):
        parts.append(sql.fallback(f"p{k}", "markers", value, p99, p95, tail))
        names.append(f"SELECT *, '{slot}' AS slot FROM p{k}")
    slots = dict.fromkeys(x[3] for x in table)
    last = lambda s, c: f"last({c} ORDER BY start, \"end\" DESC) FILTER (WHERE slot = '{s}')"
    evidence = ", ".join(f"{last(s, 'peak_pos')} AS {s}_Pos, {sql.r4(last(s, 'peak_value'))} AS {s}_Value" for s in slots)
    return f"""{markers}, {', '.join(parts)}, every AS ({' UNION ALL '.join(names)}), {sql.grouped('eg', 'every', SMALL.gap)}
        SELECT chrom, {sql.r4('min(start)')} AS start, {sql.r4('max("end")')} AS "end", {evidence}, CASE WHEN count(*) FILTER (WHERE level = 'p99') > 0 THEN 'p99' ELSE 'p95' END AS threshold FROM eg GROUP BY chrom, g"""

