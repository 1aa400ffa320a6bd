"""Genome-wide robust Z scores and their combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.config import TWO_BULK
from locusflow.functions.stats import round6

#: The three statistics a composite is made of, for two bulks and for one.
COMPOSITE = {True: ("DeltaSI", "Gstat", "LOD"), False: ("AFDev", "Gstat1", "LOD1")}
MAD_SCALE = 1.4826
#: Values that are sorted at once; a wider range is narrowed by quantiles first.
SORTED = 200_000


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians (mean of the middle two). Large tables: the middle ranks are closed in on by counting passes."""
    n = df.count()
    if not n:
        return {}
    ranks = ((n - 1) // 2, n // 2)
    bounds: dict[str, tuple[float | None, float | None]] = {c: (None, None) for c in columns}
    out: dict[str, float] = {}
    while bounds:
        inside = lambda c: F.lit(True) if bounds[c][0] is None else F.col(c).between(*bounds[c])  # noqa: B023, E731
        aggs = []
        for c, (low, _) in bounds.items():
            aggs += [F.count_if(F.col(c) < low if low is not None else F.lit(False)).alias(f"{c}_below"), F.count_if(inside(c)).alias(f"{c}_in")]
        counts = df.agg(*aggs).first()
        small = [c for c in bounds if counts[f"{c}_in"] <= SORTED]
        if small:
            asked = {c: F.array(*[F.lit(_fraction(r - counts[f"{c}_below"], counts[f"{c}_in"])) for r in ranks]) for c in small}
            picked = df.agg(*[F.percentile(F.when(inside(c), F.col(c)), asked[c]).alias(c) for c in small]).first()
            for c in small:
                out[c] = (picked[c][0] + picked[c][1]) / 2
                del bounds[c]
        if bounds:
            asked = {c: [_fraction(r - counts[f"{c}_below"], counts[f"{c}_in"]) for r in ranks] for c in bounds}
            near = df.agg(*[F.percentile_approx(F.when(inside(c), F.col(c)), [max(0.0, a - 0.001), min(1.0, b + 0.001)], 20000).alias(c) for c, (a, b) in asked.items()]).first()
            for c in list(bounds):
                if tuple(near[c]) == bounds[c]:  # one value fills the range
                    out[c] = float(near[c][0])
                    del bounds[c]
                else:
                    bounds[c] = tuple(near[c])
    return out


def _fraction(rank: int, n: int) -> float:
    return min(max(rank / (n - 1), 0.0), 1.0) if n > 1 else 0.0


def with_z(smoothed: DataFrame, columns: list[str]) -> DataFrame:
    """Z_ of each Sm_ column: by median and MAD, by mean and deviation if the MAD is 0, else 0."""
    names = [f"Sm_{c}" for c in columns]
    centre = medians(smoothed, names)
    if not centre:
        raise ValueError("nothing to normalise")
    deviations = medians(smoothed.select(*[F.abs(F.col(c) - F.lit(centre[c])).alias(c) for c in names]), names)
    spread = smoothed.agg(*[F.avg(c).alias(f"{c}_m") for c in names], *[F.stddev_pop(c).alias(f"{c}_s") for c in names]).first()
    scores = {}
    for c in names:
        mad, sd = deviations[c] * MAD_SCALE, spread[f"{c}_s"]
        z = (F.col(c) - centre[c]) / mad if mad else (F.col(c) - spread[f"{c}_m"]) / sd if sd else F.lit(0.0)
        scores["Z_" + c[3:]] = round6(z)
    return smoothed.withColumns(scores)


def with_composite(z: DataFrame, mode: str) -> DataFrame:
    """CompositeZ = (|z1| + z2 + z3) / sqrt 3, and the largest absolute Z."""
    one, two, three = (F.col(f"Z_{c}") for c in COMPOSITE[mode in TWO_BULK])
    every = [F.abs(F.col(c)) for c in z.columns if c.startswith("Z_")]
    return z.withColumn("CompositeZ", round6((F.abs(one) + two + three) / F.sqrt(F.lit(3.0)))).withColumn("MaxAbsZ", round6(F.greatest(*every)))


def distinct_depths(sites: DataFrame) -> DataFrame:
    return sites.where("Depth > 0").select("Depth").distinct()


def upper_median_depth(sites: DataFrame) -> DataFrame:
    """The element n // 2 of the sorted depths: running sums over one row a depth."""
    counts = sites.groupBy("Depth").count()
    # one row for each distinct depth, however many sites there are
    upto = counts.select("Depth", F.sum("count").over(Window.orderBy("Depth")).alias("upto"), F.sum("count").over(Window.partitionBy()).alias("n"))
    return upto.where(F.col("upto") > F.expr("n div 2")).agg(F.min("Depth").alias("depth"))
