"""Per-site statistics from filtered records: one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.config import MODES, TWO_BULK, expected_af
from locusflow.functions import alleles, stats

#: What tells records apart, in the order along a chromosome.
KEY = ("chrom", "pos", "ref", "alt")
TWO_STATS = ("DeltaSI", "Gstat", "ED4", "LOD", "BBLogBF")
ONE_STATS = ("AFDev", "Gstat1", "LOD1", "BBLogBF1")


def counted(records: DataFrame, mode: str) -> DataFrame:
    """chrom, pos, ref, alt and, for each bulk of the mode, the reads of the high and the other allele."""
    roles, target = MODES[mode]["roles"], F.col("target_alt")
    view = lambda role: None if role not in roles else alleles.measured(role) if f"_{role}_here" in records.columns else alleles.reads(F.col(role), target)
    high = alleles.high_allele(view("hp"), view("lp"), target)
    columns = [F.get("alts", target - 1).alias("alt")]
    for role, name in (("hb", "High"), ("lb", "Low")):
        if role in roles:
            s = view(role)
            ref, alt = F.when(s.usable, s.ref).otherwise(0), F.when(s.usable, F.coalesce(s.here, F.lit(0))).otherwise(0)
            columns += [F.when(high == 0, ref).otherwise(alt).alias(f"{name}H"), F.when(high == 0, alt).otherwise(ref).alias(f"{name}L")]
    return records.select("chrom", "pos", "ref", *columns)


def with_statistics(counts: DataFrame, mode: str, population: str = "F2") -> DataFrame:
    """Adds the mode's statistics to counts of reads (HighH, HighL, LowH, LowL), each rounded to six places."""
    roles = MODES[mode]["roles"]
    c = {n: f"cast({n} as double)" for n in counts.columns if n in ("HighH", "HighL", "LowH", "LowL")}
    si = {n: stats.share(c[f"{n}H"], f"({c[f'{n}H']} + {c[f'{n}L']})") for r, n in (("hb", "High"), ("lb", "Low")) if r in roles}
    out = {f"{n}SI": x for n, x in si.items()}
    r6 = stats.round6_sql
    if mode in TWO_BULK:
        cells = c["HighH"], c["HighL"], c["LowH"], c["LowL"]
        delta = f"({si['High']} - {si['Low']})"
        out |= {"DeltaSI": r6(delta), "Gstat": r6(stats.g_statistic(*cells)), "ED4": r6(f"{delta} * {delta} * {delta} * {delta}"), "LOD": r6(stats.lod(*cells)), "BBLogBF": r6(stats.bayes_factor(*cells))}
        out["Depth"] = "CASE WHEN HighH + HighL = 0 THEN LowH + LowL ELSE least(HighH + HighL, LowH + LowL) END"
    else:
        n = next(iter(si))
        p0, s, f = expected_af(population), c[f"{n}H"], c[f"{n}L"]
        out |= {"P0": stats.number(p0), "AFDev": r6(f"{si[n]} - {stats.number(p0)}"), "Gstat1": r6(stats.one_bulk_g(s, f, p0)), "LOD1": r6(stats.one_bulk_lod(s, f, p0)), "BBLogBF1": r6(stats.one_bulk_bayes_factor(s, f, p0)), "Depth": f"{n}H + {n}L"}
    return counts.selectExpr("*", *[f"{x} AS {n}" for n, x in out.items()])


def raw_stats(records: DataFrame, mode: str, population: str = "F2") -> DataFrame:
    # a generator again, so that the counts aren't worked out anew for each statistic
    counts = counted(records, mode)
    numbers = [c for c in counts.columns if c not in KEY]
    own = counts.select(*KEY, F.inline(F.array(F.struct(*numbers))))
    return with_statistics(own, mode, population)


def smoothed_columns(mode: str) -> list[str]:
    roles = MODES[mode]["roles"]
    si = [n for r, n in (("hb", "HighSI"), ("lb", "LowSI")) if r in roles]
    return [*si, *(TWO_STATS if mode in TWO_BULK else ONE_STATS)]
