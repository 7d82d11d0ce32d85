"""From ranks to a portfolio, as chains of SQL steps over a filled daily panel: monthly points, forward targets, ranks, feature gate, top-N information ratios, expanding
statistics, priors, scores, selection by score, weighted vote, walk-forward and its summary.

A month's point is the first trading day on or after its last day. A target at a point is the return to the point ``horizon`` months on, the same less the core's (alpha), and
alpha over the deviation of the daily alphas between the two points (forward IR; five days at least, floor 1e-8). Instruments take part from HISTORY days after their first price.

Ties are broken by the smaller instrument (or feature name) throughout. ``positional`` priors average the statistics rows by position, as if row k
were date k, which reaches 12 dates ahead; ``as_of`` priors use only earlier dates.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from gridloom.functions.sql import SPARK, Dialect
from gridloom.sources.panels import ctes, panel

#: Feature name to expression over the monthly columns r, a, p.
FEATURES = {"mom_1": "r", "mom_3": "m3", "mom_6": "m6", "mom_12": "m12", "vol_6": "v6", "rev_1": "-r", "dist_6": "x6"}
N_MAX = 10
#: Features that a selection keeps at most.
MOST_FEATURES = 10
#: Calendar days of history before a target counts: 378 trading days and half as many again.
HISTORY = 567
SKIP_DATES = 12
#: Least absolute correlation with the dated mean IR, for plain and for filtered features.
GATE = {"bases": 0.0, "filtered": 0.1}
FLOOR = "1e-8"


def pct_rank(value: str, over: str = "dt") -> str:
    """Average rank over the number of values that aren't null."""
    keys = over
    return (
        f"CASE WHEN {value} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY CASE WHEN {value} IS NULL THEN 1 ELSE 0 END, {value}) + (count({value}) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0e0)"
        f" / NULLIF(count({value}) OVER (PARTITION BY {keys}), 0) END"
    )


def normal_cdf(x: str) -> str:
    """Abramowitz and Stegun 7.1.26; error under 1.5e-7."""
    z = f"(abs({x}) / sqrt(2.0e0))"
    t = f"(1 / (1 + 0.3275911e0 * {z}))"
    tail = f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-{z} * {z}))"
    return f"CASE WHEN {x} >= 0 THEN 1 - 0.5e0 * {tail} ELSE 0.5e0 * {tail} END"


def horizon_of(spec: int | str) -> tuple[int, str]:
    """Months for a number, days for text such as 21d; ValueError for anything else."""
    if isinstance(spec, int) and not isinstance(spec, bool):
        return spec, "month"
    days = re.fullmatch(r"(\d+)d", spec) if isinstance(spec, str) else None
    if not days:
        raise ValueError(f"a horizon is a number of months or text such as 21d, not {spec!r}")
    return int(days[1]), "days"


def horizon_label(spec: int | str) -> str:
    return "{}{}".format(*horizon_of(spec))


def _long(d: Dialect, features: Mapping[str, str]) -> str:
    """Features as rows: one pass over the panel in Spark."""
    if d.spark:
        pairs = ", ".join(f"'{n}', round({x}, 9)" for n, x in features.items())
        return f"SELECT inst, dt, stack({len(features)}, {pairs}) AS (feature, value) FROM monthly"
    return " UNION ALL ".join(f"SELECT inst, dt, '{n}' AS feature, round({x}, 9) AS value FROM monthly" for n, x in features.items())


def steps(d: Dialect, features: Mapping[str, str] = FEATURES, horizon: int = 1) -> dict[str, str]:
    """Named steps in order; each may read those before it."""
    back = "OVER (PARTITION BY inst ORDER BY dt)"
    age = "datediff(dt, first_dt)" if d.spark else "date_diff('day', first_dt, dt)"
    months = " UNION ALL ".join(f"SELECT {j} AS j" for j in range(1, horizon + 1))
    s = {
        "marks": "SELECT dt, CASE WHEN dt = CAST(last_day(dt) AS DATE) OR (before < CAST(last_day(before) AS DATE) AND CAST(last_day(before) AS DATE) <= dt) THEN 1 ELSE 0 END AS is_point FROM (SELECT dt, lag(dt) OVER (ORDER BY dt) AS before FROM (SELECT DISTINCT dt FROM panel) a) b",
        "periods": "SELECT dt, is_point, CAST(coalesce(sum(is_point) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS k FROM marks",
        "days": f"SELECT inst, dt, core, p, cp, is_point, k, {d.div('p', d.lag('p'))} - ({d.div('cp', d.lag('cp'))}) AS da, min(CASE WHEN p IS NOT NULL THEN dt END) OVER (PARTITION BY inst) AS first_dt FROM panel JOIN periods USING (dt)",
        "vols": f"SELECT inst, k - j AS k, count(*) + 1 AS n_days, CASE WHEN count(*) = count(da) THEN stddev_pop(da) END AS vol FROM days, ({months}) m WHERE k >= j GROUP BY inst, k - j",
        "points": "SELECT inst, dt, core, p, cp, k, first_dt FROM days WHERE is_point = 1",
        "rets": f"SELECT *, {d.div('p', d.lag('p'))} - 1 AS r, {d.div('p', d.lag('p', 3))} - 1 AS m3, {d.div('p', d.lag('p', 6))} - 1 AS m6, {d.div('p', d.lag('p', 12))} - 1 AS m12, {d.div('p', d.mean('p', 6))} - 1 AS x6 FROM points",
        "alphas": "SELECT *, r - max(CASE WHEN inst = core THEN r END) OVER (PARTITION BY dt) AS a FROM rets",
        "monthly": f"SELECT inst, dt, core, p, r, a, m3, m6, m12, x6, {d.std('r', 6)} AS v6 FROM alphas",
        "targets": f"SELECT q.inst, q.dt, fr AS forward_return, fc AS core_return, fr - fc AS forward_alpha, (fr - fc) / greatest(CASE WHEN n_days >= 5 THEN coalesce(vol, {FLOOR}) ELSE {FLOOR} END, {FLOOR}) AS forward_ir "
        f"FROM (SELECT *, {d.div(f'lead(p, {horizon}) {back}', 'p')} - 1 AS fr, {d.div(f'lead(cp, {horizon}) {back}', 'cp')} - 1 AS fc FROM points) q JOIN vols v ON v.inst = q.inst AND v.k = q.k WHERE q.inst <> q.core AND fr - fc IS NOT NULL AND {age} >= {HISTORY}",
        "feats": _long(d, features),
        "ranks": f"SELECT inst, dt, feature, {pct_rank('value', 'feature, dt')} AS pct_rank FROM feats",
        "dated_ir": "SELECT dt, avg(forward_ir) AS mean_ir FROM targets GROUP BY dt",
        "gate": "SELECT feature, count(value + mean_ir) AS n, count(DISTINCT CASE WHEN value IS NOT NULL AND mean_ir IS NOT NULL THEN dt END) AS n_dates, "
        "CASE WHEN stddev_pop(CASE WHEN mean_ir IS NOT NULL THEN value END) > 1e-12 AND stddev_pop(CASE WHEN value IS NOT NULL THEN mean_ir END) > 1e-12 THEN covar_pop(value, mean_ir) / (stddev_pop(CASE WHEN mean_ir IS NOT NULL THEN value END) * stddev_pop(CASE WHEN value IS NOT NULL THEN mean_ir END)) END AS corr "
        "FROM feats JOIN dated_ir USING (dt) GROUP BY feature",
        "ordered": "SELECT r.feature, r.dt, r.inst, r.pct_rank, t.forward_ir, t.forward_alpha, row_number() OVER (PARTITION BY r.feature, r.dt ORDER BY r.pct_rank DESC, r.inst) AS rn, count(*) OVER (PARTITION BY r.feature, r.dt) AS n_ranked "
        "FROM ranks r JOIN (SELECT DISTINCT inst FROM targets) u ON r.inst = u.inst LEFT JOIN targets t ON t.inst = r.inst AND t.dt = r.dt WHERE r.pct_rank IS NOT NULL",
        "feature_ir": f"SELECT feature, dt, CAST(rn AS BIGINT) AS n, avg(forward_ir) OVER (PARTITION BY feature, dt ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ir FROM ordered WHERE n_ranked >= {N_MAX} AND rn <= {N_MAX}",
        "feature_alpha": "SELECT feature, dt, count(*) AS n, avg(forward_alpha) AS alpha FROM (SELECT *, row_number() OVER (PARTITION BY feature, dt ORDER BY pct_rank DESC, inst) AS k FROM ordered WHERE forward_alpha IS NOT NULL) q WHERE k <= 3 GROUP BY feature, dt",
        "calendar": "SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM targets) q",
        "cells": "SELECT f.feature, n.n, c.dt, c.i, x.ir FROM (SELECT DISTINCT feature FROM feature_ir) f CROSS JOIN (SELECT DISTINCT n FROM feature_ir WHERE n IN (3, 4)) n CROSS JOIN calendar c LEFT JOIN feature_ir x ON x.feature = f.feature AND x.n = n.n AND x.dt = c.dt",
        "stats": f"SELECT * FROM (SELECT feature, n, dt, i, avg(ir) OVER w AS ir_mean, stddev_pop(ir) OVER w AS ir_std, avg(CASE WHEN ir > 0 THEN 1.0e0 WHEN ir IS NOT NULL THEN 0.0e0 END) OVER w AS hit_rate FROM cells WINDOW w AS (PARTITION BY feature, n ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) q WHERE i >= {SKIP_DATES}",
    }
    for mode, at in (("positional", f"i - {SKIP_DATES}"), ("as_of", "i")):
        s[f"placed_{mode}"] = f"SELECT c.feature, c.n, c.dt, c.i, s.ir_mean, s.ir_std FROM (SELECT feature, n, dt, i FROM cells) c LEFT JOIN (SELECT *, {at} AS at FROM stats) s ON s.feature = c.feature AND s.n = c.n AND s.at = c.i"
        s[f"raw_{mode}"] = f"SELECT feature, n, dt, i, avg(ir_mean) OVER w AS mu, avg(ir_std) OVER w AS sd, stddev_pop(ir_mean) OVER w AS wobble, count(ir_mean) OVER w AS n_obs FROM placed_{mode} WINDOW w AS (PARTITION BY feature, n ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        s[f"prior_{mode}"] = f"SELECT feature, n, dt, i, n_obs, coalesce(mu, 0.0e0) AS mu, (CASE WHEN coalesce(sd, 0) > 0 THEN sd ELSE 0.03e0 END) * (CASE WHEN n_obs >= 3 THEN 1 + least(1.0e0, wobble / (abs(mu) + 0.001e0)) ELSE 1.0e0 END) AS sigma FROM raw_{mode}"
    s["scores"] = f"SELECT feature, n, dt, i, mu, sigma, CASE WHEN sigma > 0 THEN mu / sigma ELSE 0.0e0 END AS expected_ir, {normal_cdf('mu / NULLIF(sigma, 0)')} AS p_positive FROM prior_as_of"
    s["chosen"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, dt ORDER BY round(expected_ir, 9) DESC, feature) AS k FROM scores WHERE i >= {SKIP_DATES}) q WHERE k <= {MOST_FEATURES}"
    s["votes"] = f"SELECT c.n, c.dt, r.inst, {d.div('sum(r.pct_rank * greatest(c.mu, 0.0e0))', 'sum(CASE WHEN r.pct_rank IS NOT NULL THEN greatest(c.mu, 0.0e0) END)')} AS vote FROM chosen c JOIN ranks r ON r.feature = c.feature AND r.dt = c.dt GROUP BY c.n, c.dt, r.inst"
    s["picked"] = "SELECT * FROM (SELECT v.n, v.dt, v.inst, v.vote, t.forward_alpha, row_number() OVER (PARTITION BY v.n, v.dt ORDER BY round(v.vote, 9) DESC, v.inst) AS k, count(*) OVER (PARTITION BY v.n, v.dt) AS n_valid FROM votes v JOIN targets t ON t.inst = v.inst AND t.dt = v.dt WHERE v.vote IS NOT NULL) q WHERE k <= n AND n_valid >= n"
    s["walk"] = "SELECT n, dt, avg(forward_alpha) AS avg_alpha, count(*) AS n_selected FROM picked GROUP BY n, dt"
    s["summary"] = (
        f"SELECT n, count(*) AS n_months, avg(avg_alpha) AS mean_alpha, stddev_samp(avg_alpha) AS std_alpha, avg(CASE WHEN avg_alpha > 0 THEN 1.0e0 ELSE 0.0e0 END) AS hit_rate, {d.div('avg(avg_alpha)', 'stddev_samp(avg_alpha)')} AS ir, "
        "exp(sum(CASE WHEN avg_alpha > -1 THEN ln(1 + avg_alpha) END)) - 1 AS total_return, exp(sum(CASE WHEN avg_alpha > -1 THEN ln(1 + avg_alpha) END) * 12 / count(*)) - 1 AS cagr, stddev_pop(avg_alpha) AS std_pop, "
        f"{d.div('stddev_pop(avg_alpha)', 'abs(avg(avg_alpha))')} AS cv, min(avg_alpha) AS worst, max(avg_alpha) AS best, sum(CASE WHEN avg_alpha < 0 THEN 1 ELSE 0 END) AS n_negative FROM walk GROUP BY n"
    )
    s["by_size"] = "SELECT n, avg(ir) AS mean_ir, median(ir) AS median_ir, stddev_pop(ir) AS std_ir, count(ir) AS n_cells FROM feature_ir GROUP BY n"
    s["by_place"] = "SELECT n, row_number() OVER (ORDER BY mean_ir DESC, n) AS place, 100 * (mean_ir - max(mean_ir) OVER ()) / NULLIF(abs(max(mean_ir) OVER ()), 0) AS versus_best FROM by_size"
    s["best_by"] = " UNION ALL ".join(
        f"SELECT '{c}' AS criterion, n FROM (SELECT n, row_number() OVER (ORDER BY CASE WHEN {c} IS NULL THEN 1 ELSE 0 END, {c} {way}, n) AS k FROM summary) {c}_order WHERE k = 1" for c, way in (("ir", "DESC"), ("cv", "ASC"))
    )
    s["best_by_date"] = "SELECT n, avg(best) AS mean_best FROM (SELECT n, dt, max(ir) AS best FROM feature_ir GROUP BY n, dt) q GROUP BY n"
    return s


def _reads(s: Mapping[str, str], name: str) -> list[str]:
    return [m for m in s if m != name and re.search(rf"(FROM|JOIN) {m}\b", s[name])]


def _needed(s: Mapping[str, str], last: str) -> list[str]:
    need, names = {last}, list(s)
    for n in reversed(names):
        if n in need:
            need |= set(_reads(s, n))
    return [n for n in names if n in need]


def query(d: Dialect, last: str, columns: str, where: str = "", features: Mapping[str, str] = FEATURES, horizon: int = 1) -> str:
    """SQL of the chain up to the step ``last``."""
    s = steps(d, features, horizon)
    chain = ", ".join(f"{n} AS ({s[n]})" for n in _needed(s, last))
    return f"WITH {ctes('daily', True, d)}, {chain} SELECT {columns} FROM {last} {where}"


def run(spark: SparkSession, sf_dir: str, last: str, columns: str, where: str = "", features: Mapping[str, str] = FEATURES, horizon: int = 1) -> DataFrame:
    """The same in Spark, step by step; a step that several others read is made once and kept."""
    s = steps(SPARK, features, horizon)
    need = _needed(s, last)
    readers = {n: sum(n in _reads(s, m) for m in need) for n in need}
    panel(spark, sf_dir, "daily", True).createOrReplaceTempView("panel")
    for n in need:
        df = spark.sql(s[n])
        (df.persist() if readers[n] > 1 else df).createOrReplaceTempView(n)
    return spark.sql(f"SELECT {columns} FROM {last} {where}")
