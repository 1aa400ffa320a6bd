"""Settings, design table and population parameters."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields
from statistics import NormalDist

#: For each mode its roles in sample order, the two-bulk flag, and the filters each role must pass
#: (pdep: depth and genotype quality; psig: those and a usable signal; bulk: signal and depth). ``informative`` modes need two parents that differ.
MODES: dict[str, dict] = {
    "2p2b": {"roles": ("hp", "lp", "hb", "lb"), "parents": "pdep", "informative": True},
    "2phb": {"roles": ("hp", "lp", "hb"), "parents": "pdep", "informative": True},
    "2plb": {"roles": ("hp", "lp", "lb"), "parents": "pdep", "informative": True},
    "hp2b": {"roles": ("hp", "hb", "lb"), "parents": "psig", "informative": False},
    "lp2b": {"roles": ("lp", "hb", "lb"), "parents": "psig", "informative": False},
    "hphb": {"roles": ("hp", "hb"), "parents": "psig", "informative": False},
    "hplb": {"roles": ("hp", "lb"), "parents": "psig", "informative": False},
    "lphb": {"roles": ("lp", "hb"), "parents": "psig", "informative": False},
    "lplb": {"roles": ("lp", "lb"), "parents": "psig", "informative": False},
    "2b": {"roles": ("hb", "lb"), "parents": "psig", "informative": False},
}
TWO_BULK = tuple(m for m, x in MODES.items() if {"hb", "lb"} <= set(x["roles"]))
ONE_BULK = tuple(m for m in MODES if m not in TWO_BULK)


@dataclass(frozen=True)
class HardFilter:
    """Bounds of the hard filter; ``light`` leaves out the rank-sum ones."""

    # fixed values: the defaults

    snp_qual: float = 30.0
    snp_qd: float = 2.0
    snp_mq: float = 40.0
    snp_fs: float = 60.0
    snp_sor: float = 3.0
    snp_mq_rank_sum: float = -12.5
    snp_read_pos_rank_sum: float = -8.0
    indel_qual: float = 30.0
    indel_qd: float = 2.0
    indel_fs: float = 200.0
    indel_sor: float = 10.0
    indel_read_pos_rank_sum: float = -20.0
    light: bool = False


@dataclass(frozen=True)
class Analysis:
    """Settings of an analysis; sizes and depths are high, low."""

    parents_depth: tuple[int, int] = (5, 5)
    bulks_depth: tuple[int, int] = (40, 40)
    parents_max_depth: tuple[int, int] = (0, 0)
    bulks_max_depth: tuple[int, int] = (0, 0)
    min_gq: int = 0
    split_multiallelic: bool = True
    bulk_sizes: tuple[int, int] = (20, 20)
    one_bulk_size: int = 0
    window_size: int = 2_000_000
    merge_distance: int = 0
    brm_alpha: float = 0.05
    population: str = "F2"
    rep: int = 1000
    seed: int = 1

    @property
    def sigma(self) -> float:
        return self.window_size / 2

    @property
    def gap(self) -> int:
        """The distance over which intervals merge: as set, else half the window."""
        return self.merge_distance if self.merge_distance > 0 else max(self.window_size // 2, 0)

    @property
    def u_alpha(self) -> float:
        return inverse_normal(1 - self.brm_alpha / 2)


def mode_of(high_parent: str | None, low_parent: str | None, high_bulk: str | None, low_bulk: str | None) -> str:
    """The mode that the named samples make; "" and "None" are absent."""
    named = {r for r, s in zip(("hp", "lp", "hb", "lb"), (high_parent, low_parent, high_bulk, low_bulk), strict=True) if s not in (None, "", "None")}
    if not named & {"hb", "lb"}:
        raise ValueError("at least one bulk is needed")
    for mode, x in MODES.items():
        if set(x["roles"]) == named:
            return mode
    raise ValueError("two bulks, or a bulk and a parent, are needed")


def run_type(variant: str | None = None, bams: tuple = (), reads: tuple = ()) -> str:
    """Which kind of input a run has; mixtures are errors, and read files can't be analysed."""
    given = [k for k, v in (("vcf", variant), ("bams", bams), ("reads", reads)) if v]
    if len(given) != 1:
        raise ValueError("give one kind of input: variants, alignments or reads")
    if given[0] != "vcf":
        raise NotImplementedError("call variants first: only VCF is analysed")
    return given[0]


def _backcross(population: str) -> tuple[int, bool, bool] | None:
    """(generations, selfed, towards the high parent) of names such as BC2H, BC1F2L."""
    m = re.fullmatch(r"BC(\d+)(F2)?([HL])", population)
    return (int(m[1]), bool(m[2]), m[3] == "H") if m and int(m[1]) >= 1 else None


def clean_population(population: str) -> str:
    return re.sub(r"\s", "", population or "").upper()


def expected_af(population: str) -> float:
    """The allele frequency expected without selection."""
    p = clean_population(population)
    if p in ("F2", "F3", "F4", "RIL"):
        return 0.5
    if b := _backcross(p):
        high = 1 - 0.5 ** (b[0] + 1)
        return high if b[2] else 1 - high
    raise ValueError(f"unknown population {population!r}")


def variance_scale(population: str) -> float:
    """How far a population's genotypes lower the sampling variance; 1 for unknown ones."""
    p = clean_population(population)
    if p in (fixed := {"F2": 2.0, "F3": 4 / 3, "F4": 8 / 7, "RIL": 1.0}):
        return fixed[p]
    if b := _backcross(p):
        if b[1]:
            q = 0.5 ** (b[0] - 1)
            return (4 - q) / (3 - q)
        q = 0.5 ** b[0]
        return 2 * (1 - q / 2) / (1 - q)
    return 1.0


def inverse_normal(p: float) -> float:
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    return NormalDist().inv_cdf(p)


#: Settings of a run that are no part of ``Analysis`` or ``HardFilter``: input, samples (high, low) and outputs.
RUN = {"variant": "", "parents": "None,None", "bulks": "None,None", "gff": "", "out": "results"}


def _value(text: str, default, line: str):
    if isinstance(default, bool):
        return text.lower() in ("true", "yes", "1")
    if isinstance(default, tuple):
        parts = text.split(",")
        if len(parts) != 2:
            raise ValueError(f"two integers are needed: {line!r}")
        return tuple(int(x) for x in parts)
    return type(default)(text)


def read_config(text: str) -> tuple[Analysis, HardFilter, dict[str, str]]:
    """Settings from ``key: value`` lines; # begins a comment line; unknown keys and malformed lines are errors.

    Keys are the fields of ``Analysis``, those of ``HardFilter``, and those of ``RUN``.
    """
    kinds = (Analysis, HardFilter)
    found: list[dict] = [{}, {}]
    run = dict(RUN)
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, sep, value = (x.strip() for x in line.partition(":"))
        of = next((k for k, kind in enumerate(kinds) if key in {f.name for f in fields(kind)}), None)
        if not sep or of is None and key not in RUN:
            raise ValueError(f"not a setting: {line!r}")
        if of is None:
            run[key] = value
        else:
            found[of][key] = _value(value, next(f.default for f in fields(kinds[of]) if f.name == key), line)
    return Analysis(**found[0]), HardFilter(**found[1]), run


def config_template() -> str:
    """All settings with their defaults, in the form that ``read_config`` takes."""
    show = lambda v: ",".join(map(str, v)) if isinstance(v, tuple) else str(v)
    parts = [("input, samples, output", list(RUN.items())), *((kind.__doc__.splitlines()[0], [(f.name, f.default) for f in fields(kind)]) for kind in (Analysis, HardFilter))]
    return "".join(f"# {title}\n" + "".join(f"{k}: {show(v)}\n" for k, v in rows) for title, rows in parts)


def genotype_columns(mode: str, samples: dict[str, str]) -> tuple[list[str], list[str]]:
    """The samples of a design that carry the high phenotype, and those that carry the low one."""
    roles = MODES[mode]["roles"]
    return tuple([samples[r] for r in (f"{side}p", f"{side}b") if r in roles and samples.get(r)] for side in "hl")
