"""Runs along an ordered axis and merging of intervals, as windows by chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Places to which values are compared when the highest is sought: alleles of one position have equal smoothed values.
TIES = 9


def rounded(x: Column) -> Column:
    """Half away from zero, as a long."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("bigint")


def along(df: DataFrame, *within: str):
    """The order of markers on a chromosome: by position, then REF, ALT and depth where a position has several."""
    return Window.partitionBy("chrom", *within).orderBy(*[c for c in ("pos", "ref", "alt", "Depth") if c in df.columns])


def regions(markers: DataFrame, curves: list[tuple[Column, Column, str]]) -> DataFrame:
    """Regions beyond a threshold that may differ by marker, with interpolated ends and the most extreme point.

    ``curves`` are (value, threshold, tail), numbered by ``curve``; all share one
    pass over the markers, and only markers beyond a threshold go further. The
    point is sought from the first marker beyond to the first one no longer
    beyond; the earliest of equals is taken. Chromosomes of one marker have none.
    """
    signs = [1 if tail == "upper" else -1 for *_, tail in curves]
    here = F.array(*[F.struct((s * y).alias("y"), t.cast("double").alias("t"), (s * (y - t)).cast("double").alias("d")) for s, (y, t, _) in zip(signs, curves, strict=True)])
    names = [F.col(c) if c in markers.columns else F.lit("").alias(c) for c in ("ref", "alt", "Depth")]
    rows = markers.select("chrom", "pos", *names, here.alias("c"))
    order, kinds = along(rows), ("pos", "ref", "alt", "Depth", "c")
    rows = rows.withColumns({f"{c}{n}": f(c).over(order) for n, f in (("0", F.lag), ("2", F.lead)) for c in kinds if n == "2" or c in ("pos", "c")})
    rows = rows.where((F.col("pos0").isNotNull() | F.col("pos2").isNotNull()) & F.exists("c", lambda x: x["d"] > 0))
    none = F.array().cast(rows.schema["c"].dataType)
    rows = rows.select("chrom", *kinds[:4], "pos0", "pos2", "ref2", "alt2", "Depth2", F.posexplode(F.arrays_zip("c", F.coalesce("c0", none).alias("c0"), F.coalesce("c2", none).alias("c2"))).alias("curve", "z")).where("z.c.d > 0")
    rows = rows.withColumn("region", F.sum(F.when(F.col("z.c0.d") > 0, 0).otherwise(1)).over(along(rows, "curve")))
    pos, pos0, pos2 = (F.col(c).cast("double") for c in ("pos", "pos0", "pos2"))
    d, d0, d2 = (F.col(f"z.{c}.d") for c in ("c", "c0", "c2"))
    crossing = lambda p1, d1, p2, d2: p1 + d1 / (d1 - d2) * (p2 - p1)
    start = F.when(d0 <= 0, crossing(pos0, d0, pos, d)).when(F.col("pos0").isNull(), pos)
    end = F.when(d2 <= 0, crossing(pos, d, pos2, d2)).when(F.col("pos2").isNull(), pos)
    point = lambda n: F.struct((-F.round(f"z.c{n}.y", TIES)).alias("s"), F.col(f"pos{n}").alias("pos"), F.col(f"ref{n}").alias("ref"), F.col(f"alt{n}").alias("alt"), F.col(f"Depth{n}").alias("Depth"), F.col(f"z.c{n}.y").alias("y"), F.col(f"z.c{n}.t").alias("t"))
    best = F.min(F.least(point(""), F.coalesce(F.when(d2 <= 0, point("2")), point("")))).alias("b")
    found = rows.groupBy("chrom", "curve", "region").agg(F.min(start).alias("start"), F.max(end).alias("end"), best)
    sign = F.element_at(F.array(*[F.lit(s) for s in signs]), F.col("curve") + 1)
    return found.select("chrom", "curve", "start", "end", F.col("b.pos").alias("peak_pos"), (sign * F.col("b.y")).alias("peak_value"), F.col("b.t").alias("threshold"))


def peaks(markers: DataFrame, value: str, threshold: Column, tail: str = "upper") -> DataFrame:
    """The regions of one curve."""
    return regions(markers, [(F.col(value), threshold, tail)]).drop("curve")


def merged(intervals: DataFrame, gap: int, aggregates: list[Column], start: str = "start", end: str = "end", within: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Groups of intervals that overlap or lie within ``gap`` of what came before them, and their aggregates.

    ``within`` keeps groups apart. Ends are compared rounded.
    """
    order = Window.partitionBy(*within).orderBy(F.col(start), F.col(end).desc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(rounded(F.col(start)) > F.max(rounded(F.col(end))).over(before) + gap, F.lit(True))
    rows = intervals.withColumn("_new", new.cast("int")).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*within, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), *aggregates).drop("_group")
