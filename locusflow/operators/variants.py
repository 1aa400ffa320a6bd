"""Decomposition, hard filter, segregation filter: narrow transformations, one stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.config import MODES, Analysis, HardFilter
from locusflow.functions import alleles

ROLES = ("hp", "lp", "hb", "lb")


def roles_of(sites: DataFrame) -> list[str]:
    return [r for r in ROLES if r in sites.columns]


def has_alt(alts: Column) -> Column:
    """False for records without an ALT, or with ``.`` or ``<NON_REF>`` alone."""
    return (F.size(alts) > 0) & ~((F.size(alts) == 1) & F.get(alts, F.lit(0)).isin(".", "<NON_REF>"))


def decompose(sites: DataFrame, keep_index: bool = False) -> DataFrame:
    """One row for each real ALT of a record with two or more; others as they are.

    ``keep_index`` adds ``alt_of`` (the ALT's number, 0 for records as they
    were) and ``n_alts``, which rendering a record again needs.

    Genotypes become 1 for the row's ALT and 0 for others (missing stays), depths
    keep REF and that ALT.
    """
    n = F.size(F.filter("alts", alleles.is_real))
    kept = F.when(F.size("alts") == 1, F.array(F.lit(0))).when(n >= 2, F.filter(F.sequence(F.lit(1), F.size("alts")), lambda k: alleles.is_real(F.get("alts", k - 1)))).otherwise(F.array(F.lit(0)))
    rows = sites.withColumn("_k", F.explode(kept))
    k = F.col("_k")

    def sample(role: str) -> Column:
        s = F.col(role)
        gt = F.transform(s["gt"], lambda g: F.when(g < 0, g).when(g == k, F.lit(1)).otherwise(F.lit(0)))
        here = F.get(s["alts"], k - 1)
        own = F.when(here.isNotNull(), F.array(here))
        return F.when(k == 0, s).otherwise(F.struct(gt.alias("gt"), s["dp"].alias("dp"), s["gq"].alias("gq"), s["ref"].alias("ref"), own.alias("alts")))

    columns = {r: sample(r) for r in roles_of(sites)} | {"alts": F.when(k == 0, F.col("alts")).otherwise(F.array(F.get("alts", k - 1)))}
    if keep_index:
        columns |= {"alt_of": k, "n_alts": F.size("alts")}
    return rows.withColumns(columns).drop("_k")


def reindexed(value: Column, number: str, alt: Column, n_alts: Column) -> Column:
    """A FORMAT value of the given Number for one ALT of a decomposed record."""
    parts = F.split(value, ",")
    at = lambda i: F.get(parts, i.cast("int"))
    if number == "A":
        new = F.when(F.size(parts) == n_alts, at(alt - 1)).otherwise(F.lit("."))
    elif number == "R":
        new = F.when(F.size(parts) == n_alts + 1, F.concat_ws(",", at(F.lit(0)), at(alt))).otherwise(F.lit("."))
    elif number == "G":
        het = alt * (alt + 1) / 2
        hom = het + alt
        new = F.when(F.size(parts) > hom, F.concat_ws(",", at(F.lit(0)), at(het), at(hom))).otherwise(F.lit("."))
    else:
        return value
    return F.when(value.isin("", "."), value).otherwise(new)


def remapped_gt(gt: Column, alt: Column) -> Column:
    """Genotype text for one ALT: its number becomes 1, others 0; separators and missing alleles stay."""
    tokens = F.regexp_extract_all(gt, F.lit(r"(\d+|[^\d])"), F.lit(1))
    number = lambda t: F.when(t.rlike(r"^\d+$"), F.when(t.cast("int") == alt, F.lit("1")).otherwise(F.lit("0"))).otherwise(t)
    return F.array_join(F.transform(tokens, number), "")


def without_per_allele(info: Column, per_allele: list[str]) -> Column:
    """INFO of a decomposed record: entries counted by allele or genotype no longer hold."""
    return F.map_filter(info, lambda k, _: ~k.isin(*per_allele)) if per_allele else info


def active_filters(annotations: set[str], has_gq: bool, a: Analysis, h: HardFilter) -> list[str]:
    """What a run will filter by, a line each, given the INFO annotations that the file declares."""
    named = ["QD", "MQ", "FS", "SOR", *([] if h.light else ["MQRankSum", "ReadPosRankSum"])]
    out = [f"hard filter: {'light, without rank sums' if h.light else 'strict'}", "tested: " + ", ".join(["FILTER", "QUAL", *(x for x in named if x in annotations)])]
    if not annotations & set(named):
        out.append("no annotations to test: FILTER, QUAL and depth decide")
    if a.min_gq > 0:
        out.append(f"parents' GQ: at least {a.min_gq}" if has_gq else f"GQ of at least {a.min_gq} asked for, but the file has none")
    out.append(f"records of several ALTs: {'split' if a.split_multiallelic else 'kept whole'}")
    out.append(f"reads of other ALTs: at most {alleles.OTHER_SHARE:.0%} of depth")
    if any((*a.bulks_max_depth, *a.parents_max_depth)):
        out.append("depth at most (0: any): " + ", ".join(f"{r} {n}" for r, n in zip(("hb", "lb", "hp", "lp"), (*a.bulks_max_depth, *a.parents_max_depth), strict=True)))
    return out


def passes_hard(h: HardFilter) -> Column:
    """The hard filter. Absent annotations pass; an absent QUAL doesn't."""
    at_least = lambda c, x: F.coalesce(F.col(c) >= x, F.lit(True))
    at_most = lambda c, x: F.coalesce(F.col(c) <= x, F.lit(True))
    qual = F.col("qual").cast("double")
    snp = (qual >= h.snp_qual) & at_least("QD", h.snp_qd) & at_least("MQ", h.snp_mq) & at_most("FS", h.snp_fs) & at_most("SOR", h.snp_sor)
    indel = (qual >= h.indel_qual) & at_least("QD", h.indel_qd) & at_most("FS", h.indel_fs) & at_most("SOR", h.indel_sor)
    if not h.light:
        snp = snp & at_least("MQRankSum", h.snp_mq_rank_sum) & at_least("ReadPosRankSum", h.snp_read_pos_rank_sum)
        indel = indel & at_least("ReadPosRankSum", h.indel_read_pos_rank_sum)
    fine = F.col("filter").isNull() | F.col("filter").isin("", ".", "PASS")
    return fine & F.coalesce(F.when(alleles.is_snp(F.col("ref"), F.col("alts")), snp).otherwise(indel), F.lit(False))


def segregates(mode: str, a: Analysis, target: Column, view=None) -> Column:
    """Whether a record fits the mode's design with this ALT; ``view`` gives a role's reads."""
    design, fine = MODES[mode], F.lit(True)
    view = view or (lambda role: alleles.reads(F.col(role), target))
    for role in design["roles"]:
        s, side = view(role), 0 if role[0] == "h" else 1
        if role[1] == "p":
            fine = fine & alleles.deep_enough(s, a.parents_depth[side], a.parents_max_depth[side], a.min_gq)
            if design["parents"] == "psig":
                fine = fine & alleles.clear_signal(s, target)
        else:
            fine = fine & alleles.clear_signal(s, target) & alleles.deep_enough(s, a.bulks_depth[side], a.bulks_max_depth[side])
    if design["informative"]:
        fine = fine & (alleles.parent_allele(view("hp"), target) != alleles.parent_allele(view("lp"), target))
    return F.coalesce(fine, F.lit(False))


def target_alt(mode: str, a: Analysis) -> Column:
    """The first real ALT that fits, 0 if none."""
    fit = F.filter(F.sequence(F.lit(1), F.size("alts")), lambda k: alleles.is_real(F.get("alts", k - 1)) & segregates(mode, a, k))
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(0))


def measure(rows: DataFrame, mode: str) -> DataFrame:
    """Split records with the number of their only real ALT (``_target``, 0 without one) and each role's reads of it.

    The values come out of a generator: a projection would be inlined again
    into each place that uses them.
    """
    real = F.when(F.size("alts") == 1, F.when(alleles.is_real(F.get("alts", F.lit(0))), 1).otherwise(0)).otherwise(F.array_position(F.transform("alts", alleles.is_real), True).cast("int"))
    rows = rows.select("*", F.inline(F.array(F.struct(real.alias("_target")))))
    parts = []
    for role in MODES[mode]["roles"]:
        r = alleles.reads(F.col(role), F.greatest(F.col("_target"), F.lit(1)))
        parts += [r.here.alias(f"_{role}_here"), r.every.alias(f"_{role}_every"), r.depth.alias(f"_{role}_depth")]
    return rows.select("*", F.inline(F.array(F.struct(*parts))))


def _entering(sites: DataFrame, mode: str, a: Analysis) -> tuple[DataFrame, Column | None]:
    """Records that enter the filter; for split ones, measured, whether they fit."""
    entering = sites.where(has_alt(F.col("alts")))
    if not a.split_multiallelic:
        return entering, None
    target = F.col("_target")
    return measure(decompose(entering, keep_index=True), mode), (target > 0) & segregates(mode, a, target, alleles.measured)


def judged(sites: DataFrame, mode: str, a: Analysis, h: HardFilter) -> DataFrame:
    """All records that enter the filter, with ``target_alt`` (0: rejected)."""
    rows, fits = _entering(sites, mode, a)
    found = target_alt(mode, a) if fits is None else F.when(fits, F.col("_target")).otherwise(F.lit(0))
    return rows.withColumn("target_alt", F.when(passes_hard(h), found).otherwise(F.lit(0)))


def passed(sites: DataFrame, mode: str, a: Analysis, h: HardFilter) -> DataFrame:
    """The records that pass, with ``target_alt``."""
    rows, fits = _entering(sites, mode, a)
    if fits is None:
        return judged(sites, mode, a, h).where("target_alt > 0")
    return rows.where(passes_hard(h) & fits).withColumn("target_alt", F.col("_target"))
