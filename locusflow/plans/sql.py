"""DuckDB SQL of the queries, for the correctness gate."""

from __future__ import annotations

import math

from locusflow.config import MODES, TWO_BULK, Analysis, expected_af, variance_scale
from locusflow.sources.adapter import COLUMNS

R4 = "round(({0}) * 1e4) / 1e4"


def r4(x: str) -> str:
    return R4.format(x)


def r6(x: str) -> str:
    return f"(round(({x}) * 1e6) / 1e6)"


SITES = f"sites AS (SELECT {COLUMNS.strip().rstrip(',')} FROM lineitem)"
DEC = """dec AS (
SELECT chrom, pos, ref, string_split(alt, ',')[k] AS alt, flt, CAST(CAST(qual AS FLOAT) AS DOUBLE) AS qual,
  CAST(CAST(qd AS FLOAT) AS DOUBLE) AS qd, CAST(CAST(fs AS FLOAT) AS DOUBLE) AS fs, CAST(CAST(sor AS FLOAT) AS DOUBLE) AS sor, mq, mqrs, rprs,
  hb_ref, CASE k WHEN 1 THEN hb_alt ELSE stray END AS hb_alt, hb_ref + hb_alt + stray AS hb_dp,
  lb_ref, CASE k WHEN 1 THEN lb_alt ELSE stray END AS lb_alt, lb_ref + lb_alt + stray AS lb_dp,
  hp_ref, CASE k WHEN 1 THEN hp_alt ELSE 0 END AS hp_alt, hp_ref + hp_alt AS hp_dp, hp_gq,
  lp_ref, CASE k WHEN 1 THEN lp_alt ELSE 0 END AS lp_alt, lp_ref + lp_alt AS lp_dp, lp_gq
FROM sites, (VALUES (1), (2)) v(k) WHERE k = 1 OR alt LIKE '%,%')"""


def hard(light: bool) -> str:
    extra = "" if light else " AND coalesce(mqrs >= -12.5, true) AND coalesce(rprs >= -8, true)"
    indel = "" if light else " AND coalesce(rprs >= -20, true)"
    return f"""(flt = 'PASS' AND CASE WHEN length(alt) = length(ref)
  THEN qual >= 30 AND coalesce(qd >= 2, true) AND mq >= 40 AND fs <= 60 AND sor <= 3{extra}
  ELSE qual >= 30 AND coalesce(qd >= 2, true) AND fs <= 200 AND sor <= 10{indel} END)"""


def call(p: str) -> str:
    """A parent's confident allele on decomposed rows."""
    t = f"({p}_ref + {p}_alt)"
    return f"""(CASE WHEN {t} = 0 THEN NULL WHEN {p}_ref / {t} >= 0.85 OR ({p}_alt <= 1 AND {p}_ref > {p}_alt) THEN 0
  WHEN {p}_ref / {t} <= 0.15 OR ({p}_ref <= 1 AND {p}_alt > {p}_ref) THEN 1 END)"""


def fits(mode: str, a: Analysis) -> str:
    out = []
    for role in MODES[mode]["roles"]:
        side = 0 if role[0] == "h" else 1
        if role[1] == "p":
            out.append(f"{role}_dp >= {a.parents_depth[side]}")
            if a.min_gq:
                out.append(f"coalesce({role}_gq >= {a.min_gq}, true)")
        else:
            out.append(f"{role}_dp >= {a.bulks_depth[side]}")
    if MODES[mode]["informative"]:
        out.append(f"coalesce({call('hp')} <> {call('lp')}, false)")
    return " AND ".join(out)


def counts(mode: str, a: Analysis, light: bool) -> str:
    """The CTE ``counts`` of a mode's reads of the high allele and the other."""
    roles = MODES[mode]["roles"]
    if "hp" in roles:
        ref_high = "(hp_ref + hp_alt = 0 OR hp_ref >= hp_alt)"
    elif "lp" in roles:
        ref_high = "(lp_ref + lp_alt = 0 OR lp_ref < lp_alt)"
    else:
        ref_high = "true"
    columns = []
    for role, name in (("hb", "High"), ("lb", "Low")):
        if role in roles:
            columns += [f"CASE WHEN {ref_high} THEN {role}_ref ELSE {role}_alt END AS {name}H", f"CASE WHEN {ref_high} THEN {role}_alt ELSE {role}_ref END AS {name}L"]
    return f"{SITES}, {DEC}, counts AS (SELECT chrom, pos, ref, alt, {', '.join(columns)} FROM dec WHERE {hard(light)} AND {fits(mode, a)})"


def _ll(k: str, n: str, p: str) -> str:
    p = f"least(greatest({p}, 1e-10), 1 - 1e-10)"
    return f"(({k}) * ln({p}) + (({n}) - ({k})) * ln(1 - {p}))"


def _lb(a: str, b: str) -> str:
    return f"(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"


def _si(n: str) -> str:
    return f"(CASE WHEN {n}H + {n}L > 0 THEN {r6(f'CAST({n}H AS DOUBLE) / ({n}H + {n}L)')} ELSE 0.0 END)"


LN10 = repr(math.log(10))


def statistics(mode: str, population: str = "F2") -> dict[str, str]:
    roles = MODES[mode]["roles"]
    out = {f"{n}SI": _si(n) for r, n in (("hb", "High"), ("lb", "Low")) if r in roles}
    if mode in TWO_BULK:
        a, b, c, d = (f"({x} + 0.5::DOUBLE)" for x in ("HighH", "HighL", "LowH", "LowL"))
        t = f"({a} + {b} + {c} + {d})"
        cell = lambda o, row, col: f"{o} * ln({o} * {t} / (({row[0]} + {row[1]}) * ({col[0]} + {col[1]})))"
        g = f"2 * ({cell(a, (a, b), (a, c))} + {cell(b, (a, b), (b, d))} + {cell(c, (c, d), (a, c))} + {cell(d, (c, d), (b, d))})"
        n1, n2 = "(HighH + HighL)", "(LowH + LowL)"
        p0 = f"(CAST(HighH + LowH AS DOUBLE) / ({n1} + {n2}))"
        lod = f"({_ll('HighH', n1, f'CAST(HighH AS DOUBLE) / {n1}')} + {_ll('LowH', n2, f'CAST(LowH AS DOUBLE) / {n2}')} - {_ll('HighH', n1, p0)} - {_ll('LowH', n2, p0)}) / {LN10}"
        bf = f"({_lb('(HighH + 0.5::DOUBLE)', '(HighL + 0.5::DOUBLE)')} + {_lb('(LowH + 0.5::DOUBLE)', '(LowL + 0.5::DOUBLE)')} - {_lb('(HighH + LowH + 0.5::DOUBLE)', '(HighL + LowL + 0.5::DOUBLE)')} - ln(pi())) / {LN10}"
        delta = f"({out['HighSI']} - {out['LowSI']})"
        out |= {"DeltaSI": r6(delta), "Gstat": r6(g), "ED4": r6(f"{delta} * {delta} * {delta} * {delta}"), "LOD": f"(CASE WHEN {n1} > 0 AND {n2} > 0 THEN {r6(lod)} ELSE 0.0 END)", "BBLogBF": r6(bf)}
        out["Depth"] = f"(CASE WHEN {n1} = 0 THEN {n2} ELSE least({n1}, {n2}) END)"
    else:
        n = "High" if "hb" in roles else "Low"
        p0, s, f, t = expected_af(population), f"{n}H", f"{n}L", f"({n}H + {n}L)"
        cell = lambda o, p: f"(CASE WHEN {o} > 0 THEN {o} * ln({o} / ({t} * {p!r}::DOUBLE)) ELSE 0 END)"
        out |= {
            "P0": f"{p0!r}::DOUBLE", "AFDev": r6(f"{out[f'{n}SI']} - {p0!r}::DOUBLE"), "Gstat1": r6(f"2 * ({cell(s, p0)} + {cell(f, 1 - p0)})"),
            "LOD1": r6(f"({_ll(s, t, f'CAST({s} AS DOUBLE) / {t}')} - {_ll(s, t, f'{p0!r}::DOUBLE')}) / {LN10}"),
            "BBLogBF1": r6(f"({_lb(f'({s} + 0.5::DOUBLE)', f'({f} + 0.5::DOUBLE)')} - ln(pi()) - {s} * ln({p0!r}::DOUBLE) - {f} * ln({1 - p0!r}::DOUBLE)) / {LN10}"), "Depth": t,
        }
    return out


def stats_cte(mode: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in statistics(mode).items())} FROM {source})"


def smoothed(mode: str, columns: list[str], a: Analysis, light: bool = True, least: int = 5) -> str:
    """CTEs up to ``smoothed``."""
    s, c = a.sigma, 3 * a.sigma
    w = f"greatest(b.Depth, 1) * exp(-0.5 * ((b.pos - a.pos) / {s!r}::DOUBLE) * ((b.pos - a.pos) / {s!r}::DOUBLE))"
    sums = ", ".join(f"sum(w * {x}) / sum(w) AS Sm_{x}" for x in columns)
    values = ", ".join(f"b.{x}" for x in columns)
    return f"""{counts(mode, a, light)}, {stats_cte(mode, 'counts', 'raw')},
told AS (SELECT *, row_number() OVER () AS rid FROM raw),
lefts AS (SELECT rid, chrom, pos, ref, alt, Depth, unnest([floor(pos / {c!r}::DOUBLE) - 1, floor(pos / {c!r}::DOUBLE), floor(pos / {c!r}::DOUBLE) + 1]) AS bin FROM told),
rights AS (SELECT *, floor(pos / {c!r}::DOUBLE) AS bin FROM raw),
pairs AS (SELECT a.rid, a.chrom, a.pos, a.ref, a.alt, a.Depth, {w} AS w, {values} FROM lefts a JOIN rights b ON a.chrom = b.chrom AND a.bin = b.bin AND abs(b.pos - a.pos) <= {c!r}),
smoothed AS (SELECT chrom, pos, ref, alt, Depth, count(*) AS n_contrib, {sums} FROM pairs GROUP BY rid, chrom, pos, ref, alt, Depth HAVING count(*) >= {least})"""


def scored(mode: str, columns: list[str], composite: tuple[str, ...], a: Analysis) -> str:
    """CTEs up to ``scored``: Z scores and composites."""
    med = ", ".join(f"median(Sm_{x}) AS m_{x}, stddev_pop(Sm_{x}) AS s_{x}, avg(Sm_{x}) AS a_{x}" for x in columns)
    mad = ", ".join(f"median(abs(Sm_{x} - m_{x})) * 1.4826 AS d_{x}" for x in columns)
    z = ", ".join(f"{r6(f'CASE WHEN d_{x} > 0 THEN (Sm_{x} - m_{x}) / d_{x} WHEN s_{x} > 0 THEN (Sm_{x} - a_{x}) / s_{x} ELSE 0 END')} AS Z_{x}" for x in columns)
    one, two, three = composite
    return f"""{smoothed(mode, columns, a)}, centre AS (SELECT {med} FROM smoothed), spread AS (SELECT {mad} FROM smoothed, centre),
zs AS (SELECT smoothed.*, {z} FROM smoothed, centre, spread),
scored AS (SELECT *, {r6(f'(abs(Z_{one}) + Z_{two} + Z_{three}) / sqrt(3.0::DOUBLE)')} AS CompositeZ, {r6('greatest(' + ', '.join(f'abs(Z_{x})' for x in columns) + ')')} AS MaxAbsZ FROM zs)"""


def brm_ctes(mode: str, a: Analysis) -> str:
    """CTEs brm_sites, brm_blocks and brm_merged on ``smoothed``."""
    scale, d = variance_scale(a.population), "greatest(Depth, 1)::DOUBLE"
    pool = lambda v, n: f"({v} / ({scale!r}::DOUBLE * {n}) * (1 - 1 / {d}) + {v} / {d})"
    if mode in TWO_BULK:
        v, dev = "(af * (1 - af))", "Sm_DeltaSI"
        af = "least(greatest((Sm_HighSI + Sm_LowSI) / 2, 0.05::DOUBLE), 0.95::DOUBLE)"
        var = f"{pool(v, a.bulk_sizes[0])} + {pool(v, a.bulk_sizes[1])}"
    else:
        p0 = min(max(expected_af(a.population), 0.05), 0.95)
        af, dev, var = "0", "Sm_AFDev", pool(f"{p0 * (1 - p0)!r}::DOUBLE", a.one_bulk_size or a.bulk_sizes[0])
    return f"""afs AS (SELECT *, {af} AS af FROM smoothed),
brm_sites AS (SELECT chrom, pos, ref, alt, Depth, {dev} AS deviation, {a.u_alpha!r}::DOUBLE * sqrt({var}) AS threshold, abs({dev}) >= {a.u_alpha!r}::DOUBLE * sqrt({var}) AS significant FROM afs),
brm_near AS (SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS after, coalesce(lag(significant) OVER w, false) AS was FROM brm_sites WINDOW w AS (PARTITION BY chrom ORDER BY pos, ref, alt, Depth)),
brm_runs AS (SELECT *, sum(CASE WHEN was THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos, ref, alt, Depth) AS run FROM brm_near WHERE significant),
brm_best AS (SELECT *, row_number() OVER (PARTITION BY chrom, run ORDER BY round(abs(deviation), 9) DESC, pos, ref, alt, Depth) AS k FROM brm_runs),
brm_blocks AS (SELECT chrom, min(coalesce((before + pos) // 2, pos)) AS start, greatest(max(coalesce((pos + after) // 2, pos)), min(coalesce((before + pos) // 2, pos))) AS stop,
  max(CASE WHEN k = 1 THEN pos END) AS peak_pos, max(CASE WHEN k = 1 THEN deviation END) AS peak, max(CASE WHEN k = 1 THEN threshold END) AS threshold FROM brm_best GROUP BY chrom, run),
brm_turn AS (SELECT *, coalesce(sign(peak) <> lag(sign(peak)) OVER (PARTITION BY chrom ORDER BY start, stop DESC), false)::INT AS turn FROM brm_blocks),
brm_side AS (SELECT *, sum(turn) OVER (PARTITION BY chrom ORDER BY start, stop DESC) AS side FROM brm_turn),
brm_new AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY chrom, side ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {a.gap}, true)::INT AS fresh FROM brm_side),
brm_grp AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom, side ORDER BY start, stop DESC ROWS UNBOUNDED PRECEDING) AS g FROM brm_new),
brm_rank AS (SELECT *, row_number() OVER (PARTITION BY chrom, side, g ORDER BY abs(peak) DESC, start) AS k FROM brm_grp),
brm_merged AS (SELECT chrom, min(start) AS start, max(stop) AS stop, max(CASE WHEN k = 1 THEN peak_pos END) AS peak_pos, max(CASE WHEN k = 1 THEN peak END) AS peak, max(CASE WHEN k = 1 THEN threshold END) AS threshold FROM brm_rank GROUP BY chrom, side, g)"""


def peaks(name: str, source: str, value: str, threshold: str, tail: str = "upper") -> str:
    """CTEs that end in ``name``: peaks beyond a threshold."""
    s = 1 if tail == "upper" else -1
    return f"""{name}_a AS (SELECT chrom, pos, ref, alt, Depth, {value} AS y, ({threshold})::DOUBLE AS t, {s} * ({value} - ({threshold})) AS d FROM {source}),
{name}_b AS (SELECT *, lag(pos) OVER w AS pos0, lag(d) OVER w AS d0, lead(pos) OVER w AS pos2, lead(d) OVER w AS d2, lead(y) OVER w AS y2, lead(t) OVER w AS t2, lead(ref) OVER w AS ref2, lead(alt) OVER w AS alt2, lead(Depth) OVER w AS Depth2 FROM {name}_a WINDOW w AS (PARTITION BY chrom ORDER BY pos, ref, alt, Depth)),
{name}_c AS (SELECT *, sum(CASE WHEN d0 > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos, ref, alt, Depth) AS region FROM {name}_b WHERE d > 0 AND (pos0 IS NOT NULL OR pos2 IS NOT NULL)),
{name}_d AS (SELECT chrom, region, pos, ref, alt, Depth, y, t FROM {name}_c UNION ALL SELECT chrom, region, pos2, ref2, alt2, Depth2, y2, t2 FROM {name}_c WHERE d2 <= 0),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY chrom, region ORDER BY round({s} * y, 9) DESC, pos, ref, alt, Depth) AS k FROM {name}_d),
{name}_f AS (SELECT chrom, region, min(CASE WHEN d0 <= 0 THEN pos0 + d0 / (d0 - d) * (pos - pos0) WHEN pos0 IS NULL THEN pos END) AS start,
  max(CASE WHEN d2 <= 0 THEN pos + d / (d - d2) * (pos2 - pos) WHEN pos2 IS NULL THEN pos END) AS "end" FROM {name}_c GROUP BY chrom, region),
{name} AS (SELECT f.chrom, f.start, f."end", e.pos AS peak_pos, e.y AS peak_value, e.t AS threshold FROM {name}_f f JOIN {name}_e e ON f.chrom = e.chrom AND f.region = e.region AND e.k = 1)"""


def fallback(name: str, source: str, value: str, p99: str, p95: str, tail: str) -> str:
    return f"""{peaks(name + '_hi', source, value, p99, tail)}, {peaks(name + '_lo', source, value, p95, tail)},
{name} AS (SELECT *, 'p99' AS level FROM {name}_hi UNION ALL SELECT *, 'p95' AS level FROM {name}_lo WHERE chrom NOT IN (SELECT chrom FROM {name}_hi))"""


def grouped(name: str, source: str, gap: int, stop: str = '"end"') -> str:
    """CTE ``name``: ``source`` with the group (g) of each interval."""
    return f"""{name}_n AS (SELECT *, coalesce(round(start) > max(round({stop})) OVER (PARTITION BY chrom ORDER BY start, {stop} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}, true)::INT AS fresh FROM {source}),
{name} AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, {stop} DESC ROWS UNBOUNDED PRECEDING) AS g FROM {name}_n)"""
