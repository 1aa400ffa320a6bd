"""Predicates on alleles and samples as Column expressions.

A sample is a struct (gt array<int>, dp int, gq int, ref bigint, alts
array<bigint>); ``ref`` and ``alts`` are null where depths are unusable.
``target`` is the 1-based number of the ALT in question.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The purity of a parent's confident call, its complement and the tolerated share of other ALTs.
PURITY = 0.85
#: Written out: 1 - 0.85 is another double.
IMPURITY = 0.15
OTHER_SHARE = 0.05


def is_real(alt: Column) -> Column:
    """Not missing, not a spanning deletion, not symbolic."""
    return ~(alt.isin(".", "*") | alt.startswith("<"))


def is_snp(ref: Column, alts: Column) -> Column:
    """Every real ALT has REF's length."""
    fits = lambda a: ~is_real(a) | (F.length(a) == F.length(ref))
    return F.when(F.size(alts) == 1, fits(F.get(alts, F.lit(0)))).otherwise(F.forall(alts, fits))


def _sum(a: Column) -> Column:
    """The sum of an array; most have one entry, which needs no loop."""
    return F.when(F.size(a) == 1, F.get(a, F.lit(0))).otherwise(F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x))


@dataclass(frozen=True)
class Reads:
    """What the predicates ask of a sample, for one target ALT."""

    present: Column
    ref: Column
    #: Reads of the target, of all ALTs; null where unusable.
    here: Column
    every: Column
    depth: Column
    dp: Column
    gq: Column
    gt: Column

    @property
    def usable(self) -> Column:
        return self.ref.isNotNull() & self.every.isNotNull()

    @property
    def named(self) -> Column:
        return self.usable & self.here.isNotNull()


def reads(s: Column, target: Column) -> Reads:
    every = _sum(s["alts"])
    own = F.when(s["ref"].isNotNull() & s["alts"].isNotNull(), s["ref"] + every)
    depth = F.when(s["dp"] > 0, s["dp"].cast("bigint")).otherwise(F.coalesce(own, F.lit(0).cast("bigint")))
    return Reads(s.isNotNull(), s["ref"], F.get(s["alts"], target - 1), every, depth, s["dp"], s["gq"], s["gt"])


def measured(role: str) -> Reads:
    """The same from the columns that ``variants.measure`` adds."""
    s = F.col(role)
    return Reads(s.isNotNull(), s["ref"], F.col(f"_{role}_here"), F.col(f"_{role}_every"), F.col(f"_{role}_depth"), s["dp"], s["gq"], s["gt"])


def deep_enough(s: Reads, least: int, most: int = 0, min_gq: int = 0) -> Column:
    fine = s.depth >= least
    if most > 0:
        fine = fine & (s.depth <= most)
    if min_gq > 0:
        fine = fine & F.coalesce(s.gq >= min_gq, F.lit(True))
    return s.present & fine


def clear_signal(s: Reads, target: Column) -> Column:
    """Hardly any reads on ALTs other than the target; by genotype where depths are unusable."""
    total = F.greatest(s.ref + s.every, F.coalesce(s.dp, F.lit(0)).cast("bigint"))
    by_depth = (total > 0) & (s.every - s.here <= OTHER_SHARE * total)
    by_gt = F.coalesce(F.size(s.gt) > 0, F.lit(False)) & F.coalesce(F.forall(s.gt, lambda g: (g == 0) | (g == target)), F.lit(False))
    return F.when(s.named, by_depth).otherwise(by_gt)


def parent_allele(s: Reads, target: Column) -> Column:
    """0 or the target for a confident call, null otherwise."""
    total = s.ref + s.every
    ref_share, other = s.ref / F.when(total > 0, total), s.every
    by_depth = F.when((ref_share >= PURITY) | ((other <= 1) & (s.ref > other)), F.lit(0)).when((ref_share <= IMPURITY) | ((s.ref <= 1) & (other > s.ref)), target.cast("int"))
    first = F.get(s.gt, F.lit(0))
    by_gt = F.when((first >= 0) & F.forall(s.gt, lambda g: g == first), first)
    return F.when(s.named & (total > 0), by_depth).otherwise(by_gt)


def main_allele(s: Reads, target: Column) -> Column:
    """The allele most of a parent's reads have (ref on ties), null if there are none."""
    return F.when(s.usable & (s.ref + s.here > 0), F.when(s.ref >= s.here, F.lit(0)).otherwise(target.cast("int")))


def high_allele(hp: Reads | None, lp: Reads | None, target: Column) -> Column:
    """The allele of the high phenotype: the high parent's, else not the low parent's, else ref."""
    if hp is not None:
        return F.coalesce(main_allele(hp, target), F.get(hp.gt, F.lit(0)), F.lit(0))
    if lp is not None:
        main = main_allele(lp, target)
        by_gt = F.when(F.get(lp.gt, F.lit(0)) == 0, target.cast("int")).otherwise(F.lit(0))
        return F.when(main == 0, target.cast("int")).when(main.isNotNull(), F.lit(0)).otherwise(by_gt)
    return F.lit(0)
