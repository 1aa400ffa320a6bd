"""Depth-weighted Gaussian smoothing along chromosomes, with a cutoff of three sigma.

``method="tiles"`` (the default) deals out tiles of several cutoffs with a halo
of one on each side, so a chromosome is many tasks and no pair of sites is ever
a row; each weight serves all statistics. ``method="join"`` is the same as an
equi-join on bins and stays in SQL; it suits few sites.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 5
#: Cutoffs that a tile spans.
TILE = 8
#: Rows of whole tiles that are smoothed at once, and pairs of sites whose weights are held at once.
ROWS, PAIRS = 20_000, 500_000


def smooth(raw: DataFrame, columns: list[str], sigma: float, least: int = LEAST, method: str = "tiles") -> DataFrame:
    """``raw`` (chrom, pos, Depth, columns) with Sm_ columns; sites with under ``least`` contributors go."""
    if sigma <= 0:
        raise ValueError("the window must be positive")
    return (_tiles if method == "tiles" else _join)(raw, columns, float(sigma), least)


def _tiles(raw: DataFrame, columns: list[str], sigma: float, least: int) -> DataFrame:
    cutoff = 3 * sigma
    size = int(TILE * cutoff) or 1
    tile = F.floor(F.col("pos") / size)
    reach = F.sequence(F.floor((F.col("pos") - cutoff) / size), F.floor((F.col("pos") + cutoff) / size))
    keep = raw.columns
    dealt = raw.withColumn("_own", tile).withColumn("_tile", F.explode(reach))
    schema = T.StructType([*raw.schema.fields, T.StructField("n_contrib", T.LongType()), *[T.StructField(f"Sm_{c}", T.DoubleType()) for c in columns]])

    def one(table):
        """Smooth a table of whole tiles, sorted by tile and position."""
        import pyarrow as pa
        import pyarrow.compute as pc

        pos = table.column("pos").to_numpy().astype(np.float64)
        tiles = table.column("_tile").to_numpy()
        chrom = pc.dictionary_encode(table.column("chrom")).combine_chunks().indices.to_numpy()
        new = np.concatenate([[True], (tiles[1:] != tiles[:-1]) | (chrom[1:] != chrom[:-1])])
        begins = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        # one axis for all tiles: each begins beyond the reach of the one before
        spans = np.maximum.reduceat(pos, begins) - np.minimum.reduceat(pos, begins) + 4 * cutoff + 1
        axis = pos + (np.cumsum(spans) - spans - np.minimum.reduceat(pos, begins))[group]
        depth = np.maximum(table.column("Depth").to_numpy().astype(np.float64), 1)
        values = np.stack([table.column(c).to_numpy() for c in columns])
        own = np.flatnonzero(table.column("_own").to_numpy() == tiles)
        low, high = np.searchsorted(axis, axis[own] - cutoff), np.searchsorted(axis, axis[own] + cutoff, side="right")
        out, n = np.empty((len(columns), len(own))), high - low
        until, first = np.cumsum(n), 0
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(until, until[first] - n[first] + PAIRS, side="right")))
            m = n[first:last]
            begin = np.cumsum(m) - m
            at = np.arange(int(m.sum())) - np.repeat(begin - low[first:last], m)
            w = depth[at] * np.exp(-0.5 * ((pos[at] - np.repeat(pos[own[first:last]], m)) / sigma) ** 2)
            total = np.add.reduceat(w, begin)
            for k in range(len(columns)):
                out[k, first:last] = np.add.reduceat(values[k, at] * w, begin) / total
            first = last
        kept = table.select(keep).take(own)
        for name, column in [("n_contrib", n), *[(f"Sm_{c}", out[k]) for k, c in enumerate(columns)]]:
            kept = kept.append_column(name, pa.array(column))
        return kept

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows < ROWS:
                continue
            # what is left of the last tile waits for its end
            tiles, chrom = held.column("_tile").to_numpy(), pc.dictionary_encode(held.column("chrom")).combine_chunks().indices.to_numpy()
            other = np.flatnonzero((tiles != tiles[-1]) | (chrom != chrom[-1]))
            if len(other):
                whole = int(other[-1]) + 1
                yield from one(held.slice(0, whole).combine_chunks()).to_batches()
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from one(held.combine_chunks()).to_batches()

    ordered = dealt.repartition("chrom", "_tile").sortWithinPartitions("chrom", "_tile", "pos")
    return ordered.mapInArrow(run, schema).where(F.col("n_contrib") >= least)


def _join(raw: DataFrame, columns: list[str], sigma: float, least: int) -> DataFrame:
    cutoff = 3 * sigma
    bin_of = F.floor(F.col("pos") / cutoff)
    near = raw.select(F.col("chrom").alias("_c"), bin_of.alias("_b"), F.col("pos").alias("_p"), F.greatest("Depth", F.lit(1)).alias("_d"), *[F.col(c).alias(f"_v_{c}") for c in columns])
    names = raw.columns
    raw = raw.withColumn("_row", F.monotonically_increasing_id())  # equal rows are smoothed each
    sites = raw.withColumn("_bin", F.explode(F.sequence(bin_of - 1, bin_of + 1)))
    pairs = sites.join(near, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (F.abs(F.col("_p") - F.col("pos")) <= cutoff))
    z = (F.col("_p") - F.col("pos")) / sigma
    w = F.col("_d") * F.exp(-0.5 * z * z)
    summed = pairs.withColumn("_w", w).groupBy(*raw.columns).agg(F.count("*").alias("n_contrib"), *[(F.sum(F.col("_w") * F.col(f"_v_{c}")) / F.sum("_w")).alias(f"Sm_{c}") for c in columns])
    return summed.where(F.col("n_contrib") >= least).select(*names, "n_contrib", *[f"Sm_{c}" for c in columns])
