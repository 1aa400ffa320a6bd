"""Null thresholds by seeded simulation, one group for each distinct depth."""

from __future__ import annotations

import math
import zlib
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.config import TWO_BULK, Analysis, _backcross, clean_population, expected_af

from .normalise import COMPOSITE, distinct_depths, upper_median_depth

#: The 99 % and 95 % levels of a Z score.
Z_LEVELS = (2.576, 1.960)
#: What a lone bulk's statistics are called in the simulation.
SIMULATED = {"Gstat1": "OneBulkGstat", "LOD1": "OneBulkLOD"}
#: Labels and probabilities of the quantiles; what is called P99 is the one-sided 0.995.
UPPER, LOWER = (("P99", 0.995), ("P95", 0.95)), (("Mp99", 0.005), ("Mp95", 0.05))


def pool_frequency(rng: np.random.Generator, population: str, n: int, rep: int, p0: float) -> np.ndarray:
    """Allele frequencies of pools of n diploid individuals of a cross."""
    if n <= 0:
        return np.full(rep, p0)
    p = clean_population(population)
    if p in ("F2", "F3", "F4", "RIL"):
        het = {"F2": 0.5, "F3": 0.25, "F4": 0.125, "RIL": 0.0}[p]
        kinds = rng.multinomial(n, [(1 - het) / 2, het, (1 - het) / 2], rep)
        return (kinds[:, 1] + 2 * kinds[:, 2]) / (2 * n)
    if b := _backcross(p):
        het = rng.binomial(n, 0.5 ** b[0], rep)
        return (2 * n - het if b[2] else het) / (2 * n)
    return rng.binomial(2 * n, p0, rep) / (2 * n)


def _xlogy(x, y):
    return x * np.log(np.where(x > 0, y, 1.0))


def _ll(k, n, p):
    p = np.clip(p, 1e-10, 1 - 1e-10)
    return k * np.log(p) + (n - k) * np.log(1 - p)


def _log_beta(a, b):
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(a + b)


def two_bulk_draws(a, b, depth: int) -> dict[str, np.ndarray]:
    """Statistics of draws with a and b alternative reads of ``depth`` in the two bulks."""
    x, y = depth - a, depth - b
    si, sj = a / depth, b / depth
    o = [a + 0.5, x + 0.5, b + 0.5, y + 0.5]
    total, rows, cols = 2 * depth + 2, (depth + 1, depth + 1), (a + b + 1, x + y + 1)
    g = 2 * sum(v * np.log(v * total / (rows[i // 2] * cols[i % 2])) for i, v in enumerate(o))
    common = (a + b) / (2 * depth)
    lod = (_ll(a, depth, si) + _ll(b, depth, sj) - _ll(a, depth, common) - _ll(b, depth, common)) / math.log(10)
    bf = (_log_beta(a + 0.5, x + 0.5) + _log_beta(b + 0.5, y + 0.5) - _log_beta(a + b + 0.5, x + y + 0.5) - math.log(math.pi)) / math.log(10)
    return {"HighSI": si, "LowSI": sj, "DeltaSI": si - sj, "Gstat": g, "ED4": (si - sj) ** 4, "LOD": lod, "BBLogBF": bf}


def one_bulk_draws(a, depth: int, p0: float) -> dict[str, np.ndarray]:
    f = depth - a
    g = 2 * (_xlogy(a, a / (depth * p0)) + _xlogy(f, f / (depth * (1 - p0))))
    lod = (_ll(a, depth, a / depth) - _ll(a, depth, p0)) / math.log(10)
    bf = (_log_beta(a + 0.5, f + 0.5) - math.log(math.pi) - a * math.log(p0) - f * math.log(1 - p0)) / math.log(10)
    return {"AFDev": a / depth - p0, "OneBulkGstat": g, "OneBulkLOD": lod, "OneBulkBBLogBF": bf}


def draws(mode: str, depth: int, a: Analysis) -> dict[str, np.ndarray]:
    """Seeded by (seed, mode, depth), so a rerun of a lost task gives the same."""
    rng = np.random.default_rng([a.seed, zlib.crc32(mode.encode()), depth])
    p0 = expected_af(a.population)
    if mode in TWO_BULK:
        h, l = (pool_frequency(rng, a.population, n or depth, a.rep, p0) for n in a.bulk_sizes)
        return two_bulk_draws(rng.binomial(depth, h), rng.binomial(depth, l), depth)
    return one_bulk_draws(rng.binomial(depth, pool_frequency(rng, a.population, a.one_bulk_size or depth, a.rep, p0)), depth, p0)


def threshold_names(mode: str) -> list[tuple[str, str, float]]:
    two_sided = ("HighSI", "LowSI", "DeltaSI") if mode in TWO_BULK else ("AFDev",)
    stats = (*two_sided, "Gstat", "ED4", "LOD", "BBLogBF") if mode in TWO_BULK else (*two_sided, "OneBulkGstat", "OneBulkLOD", "OneBulkBBLogBF")
    return [(f"{s}_{label}", s, q) for s in stats for label, q in (UPPER + LOWER if s in two_sided else UPPER)]


def by_depth(depths: DataFrame, mode: str, a: Analysis) -> DataFrame:
    """One row of quantiles for each distinct depth."""
    names = threshold_names(mode)
    schema = "Depth long, " + ", ".join(f"{n} double" for n, _, _ in names)

    def one(key, table):
        import pyarrow as pa

        depth = key[0].as_py()
        drawn = draws(mode, depth, a)
        row = {"Depth": [depth]} | {n: [_round6(float(np.quantile(drawn[s], q, method="inverted_cdf")))] for n, s, q in names}
        return pa.table(row)

    return depths.select(F.col("Depth").cast("long").alias("Depth")).where("Depth > 0").groupBy("Depth").applyInArrow(one, schema)


def _round6(x: float) -> float:
    return math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x)


def composite_levels(depth: int, mode: str, a: Analysis) -> tuple[float, float]:
    """99 % and 95 % of the composite's null at one depth; each column is normalised, by its deviation if its MAD is 0."""
    # a bulk without a size has 100; a lone bulk has its own size, else the high bulk's
    sizes = replace(a, bulk_sizes=tuple(n or 100 for n in a.bulk_sizes), one_bulk_size=a.one_bulk_size or a.bulk_sizes[0] or 100)
    drawn = draws(mode, depth, sizes)
    two = mode in TWO_BULK
    names = [c if two else SIMULATED.get(c, c) for c in COMPOSITE[two]]
    columns = [np.abs(drawn[names[0]]), *(drawn[c] for c in names[1:])]
    z = []
    for c in columns:
        centre = np.median(c)
        scale = np.median(np.abs(c - centre)) or c.std()
        z.append((c - centre) / (scale * 1.4826) if scale else c)
    total = sum(z) / math.sqrt(3)
    return tuple(_round6(float(np.quantile(total, q, method="inverted_cdf"))) for q in (0.99, 0.95))


def joined(smoothed: DataFrame, table: DataFrame, levels: tuple[float, float]) -> DataFrame:
    """Each site with the thresholds of its depth and the constants of the Z scores."""
    # one row for each distinct depth: joined by whichever strategy its size calls for
    constants = {"Z_P99": Z_LEVELS[0], "Z_P95": Z_LEVELS[1], "CompositeZ_P99": levels[0], "CompositeZ_P95": levels[1]}
    return smoothed.join(table, "Depth", "left").withColumns({k: F.lit(float(v)) for k, v in constants.items()})


def with_thresholds(smoothed: DataFrame, mode: str, a: Analysis) -> DataFrame:
    """Simulated thresholds of each site's depth, and the composite's levels; fixed levels where those can't be simulated."""
    middle = upper_median_depth(smoothed).first()["depth"]
    levels = composite_levels(int(middle), mode, a) if middle else Z_LEVELS
    return joined(smoothed, by_depth(distinct_depths(smoothed), mode, a), levels)
