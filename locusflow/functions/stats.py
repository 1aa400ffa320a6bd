"""Statistics of allele counts as SQL text: one call parses what would be hundreds of Column calls; all in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10)


def number(x: float) -> str:
    return f"{x!r}D"


def round6(x: Column) -> Column:
    """Half away from zero at six places."""
    return F.round(x * 1e6) / 1e6


def round6_sql(x: str) -> str:
    return f"(round(({x}) * 1e6D) / 1e6D)"


def share(part: str, total: str) -> str:
    """part / total at six places; 0 of nothing."""
    return f"(CASE WHEN {total} > 0 THEN {round6_sql(f'{part} / {_safe(total)}')} ELSE 0D END)"


def _safe(n: str) -> str:
    return f"greatest({n}, 1D)"


def g_statistic(a: str, b: str, c: str, d: str) -> str:
    """G of a two by two table, half a count added to each cell."""
    a, b, c, d = (f"({x} + 0.5D)" for x in (a, b, c, d))
    total = f"({a} + {b} + {c} + {d})"
    cells = ((a, (a, b), (a, c)), (b, (a, b), (b, d)), (c, (c, d), (a, c)), (d, (c, d), (b, d)))
    return "2 * (" + " + ".join(f"{o} * ln({o} * {total} / (({r[0]} + {r[1]}) * ({k[0]} + {k[1]})))" for o, r, k in cells) + ")"


def _log_likelihood(k: str, n: str, p: str) -> str:
    p = f"least(greatest({p}, 1e-10D), {number(1 - 1e-10)})"
    return f"({k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def lod(h1: str, l1: str, h2: str, l2: str) -> str:
    """log10 odds of two frequencies against one common one; 0 if a bulk is empty."""
    n1, n2 = f"({h1} + {l1})", f"({h2} + {l2})"
    gain = f"{_log_likelihood(h1, n1, f'{h1} / {_safe(n1)}')} + {_log_likelihood(h2, n2, f'{h2} / {_safe(n2)}')}"
    common = f"({h1} + {h2}) / {_safe(f'{n1} + {n2}')}"
    null = f"{_log_likelihood(h1, n1, common)} + {_log_likelihood(h2, n2, common)}"
    return f"(CASE WHEN {n1} > 0 AND {n2} > 0 THEN ({gain} - ({null})) / {number(LN10)} ELSE 0D END)"


def log_gamma(x: str) -> str:
    """ln Gamma(x) for x > 0: Stirling's series eight places up, brought down by the recurrence."""
    z, x = f"({x} + 8)", f"({x})"
    product = " * ".join([x, *(f"({x} + {k})" for k in range(1, 8))])
    series = f"1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) + 1 / (1260 * power({z}, 5D)) - 1 / (1680 * power({z}, 7D))"
    return f"(({z} - 0.5D) * ln({z}) - {z} + {number(0.5 * math.log(2 * math.pi))} + {series} - ln({product}))"


def log_beta(a: str, b: str) -> str:
    return f"({log_gamma(a)} + {log_gamma(b)} - {log_gamma(f'{a} + {b}')})"


#: ln Beta(1/2, 1/2).
LOG_BETA_HALF = math.log(math.pi)


def bayes_factor(h1: str, l1: str, h2: str, l2: str) -> str:
    """log10 beta-binomial Bayes factor of two frequencies against one, Jeffreys priors."""
    half = lambda *x: f"({' + '.join(x)} + 0.5D)"
    return f"({log_beta(half(h1), half(l1))} + {log_beta(half(h2), half(l2))} - {log_beta(half(h1, h2), half(l1, l2))} - {number(LOG_BETA_HALF)}) / {number(LN10)}"


def one_bulk_g(s: str, f: str, p0: float) -> str:
    """G of one bulk against p0, no continuity correction."""
    if not 0 < p0 < 1:
        return "0D"
    n = f"({s} + {f})"
    cell = lambda o, p: f"(CASE WHEN {o} > 0 THEN {o} * ln({_safe(o)} / ({_safe(n)} * {number(p)})) ELSE 0D END)"
    return f"(CASE WHEN {n} > 0 THEN 2 * ({cell(s, p0)} + {cell(f, 1 - p0)}) ELSE 0D END)"


def one_bulk_lod(s: str, f: str, p0: float) -> str:
    n = f"({s} + {f})"
    return f"(CASE WHEN {n} > 0 THEN ({_log_likelihood(s, n, f'{s} / {_safe(n)}')} - {_log_likelihood(s, n, number(p0))}) / {number(LN10)} ELSE 0D END)"


def one_bulk_bayes_factor(s: str, f: str, p0: float) -> str:
    if not 0 < p0 < 1:
        return "0D"
    return f"({log_beta(f'({s} + 0.5D)', f'({f} + 0.5D)')} - {number(LOG_BETA_HALF)} - {s} * {number(math.log(p0))} - {f} * {number(math.log(1 - p0))}) / {number(LN10)}"
