"""Queries of the strategy chain over the filled daily panel."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridloom.functions.sql import DUCK
from gridloom.operators import strategy
from gridloom.operators.ensemble import greedy_groups
from gridloom.registry import QUERIES, SQL
from gridloom.sources.panels import ctes


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{DUCK.out(n, digits)} AS {n}" for n in names)


#: Query name to (step, columns, condition).
PLANS = {
    "forward_targets": ("targets", f"inst, dt, {_rounded('forward_return', 'core_return', 'forward_alpha')}, round(forward_ir, 4) + 0.0e0 AS forward_ir", ""),
    "xs_percentile_rank": ("ranks", f"inst, dt, feature, {_rounded('pct_rank')}", ""),
    "feature_gate_corr": ("gate", f"feature, n, n_dates, {_rounded('corr')}, n_dates >= 2 AND n >= 2 AND NOT coalesce(abs(corr) < {strategy.GATE['bases']}, false) AS kept, n_dates >= 2 AND n >= 2 AND NOT coalesce(abs(corr) < {strategy.GATE['filtered']}, false) AS kept_filtered", ""),
    "feature_ir_topn": ("feature_ir", f"feature, dt, n, {_rounded('ir', digits=2)}", ""),
    "feature_alpha_topn": ("feature_alpha", f"feature, dt, n, {_rounded('alpha')}", ""),
    "expanding_ir_stats": ("stats", f"feature, n, dt, {_rounded('ir_mean', 'ir_std', 'hit_rate', digits=2)}", ""),
    "priors_compat": ("prior_positional", f"feature, n, dt, n_obs, {_rounded('mu', 'sigma', digits=2)}", ""),
    "priors_causal": ("prior_as_of", f"feature, n, dt, n_obs, {_rounded('mu', 'sigma', digits=2)}", ""),
    "belief_scores": ("scores", f"feature, n, dt, {_rounded('expected_ir', 'p_positive')}", ""),
    "top_scores_selection": ("chosen", f"feature, n, dt, CAST(k AS BIGINT) AS k, {_rounded('expected_ir')}", ""),
    "weighted_vote_topn": ("picked", f"n, dt, inst, CAST(k AS BIGINT) AS k, {_rounded('vote')}", ""),
    "walk_forward": ("walk", f"n, dt, n_selected, {_rounded('avg_alpha')}", ""),
    "backtest_summary": ("summary", f"n, n_months, CAST(n_negative AS BIGINT) AS n_negative, {_rounded('mean_alpha', 'std_alpha', 'hit_rate', 'ir')}, {DUCK.out('ln(1 + total_return)')} AS log_total_return, {DUCK.out('ln(1 + cagr)')} AS log_cagr", ""),
    "stability_metrics": ("summary", f"n, {_rounded('std_pop', 'cv', 'worst', 'best')}", ""),
    "ensemble_size_stats": ("by_size", f"n, n_cells, {_rounded('mean_ir', 'median_ir', 'std_ir', digits=2)}", ""),
    "ensemble_size_order": ("by_place", f"n, CAST(place AS BIGINT) AS place, {_rounded('versus_best', digits=4)}", ""),
    "best_by_criterion": ("best_by", "criterion, n", ""),
    "ensemble_best_by_date": ("best_by_date", f"n, {_rounded('mean_best', digits=2)}", ""),
}


def _plan(name: str):
    step, columns, where = PLANS[name]

    return lambda spark, sf_dir: strategy.run(spark, sf_dir, step, columns, where)


for _n, (_step, _columns, _where) in PLANS.items():
    QUERIES[_n] = _plan(_n)
    SQL[_n] = strategy.query(DUCK, _step, _columns, _where)

_TOP3 = (
    "SELECT dt, count(*) AS n, round(avg(forward_alpha), 6) + 0.0e0 AS mean_alpha FROM "
    "(SELECT o.dt, o.forward_alpha, row_number() OVER (PARTITION BY o.dt ORDER BY o.pct_rank DESC, o.inst) AS k FROM ordered o WHERE o.feature = 'mom_3' AND o.forward_alpha IS NOT NULL) q WHERE k <= 3 GROUP BY dt"
)


_ONE = {"mom_3": strategy.FEATURES["mom_3"]}


def min_slice_momentum_top3(spark: SparkSession, sf_dir: str):
    strategy.run(spark, sf_dir, "ordered", "*", features=_ONE).createOrReplaceTempView("ordered")
    return spark.sql(_TOP3)


_SQL = strategy.query(DUCK, "ordered", "*", features=_ONE)
QUERIES["min_slice_momentum_top3"] = min_slice_momentum_top3
SQL["min_slice_momentum_top3"] = _SQL[: _SQL.rindex(" SELECT * FROM ordered")] + " " + _TOP3


def _targets_sql(months: int) -> str:
    """Forward targets by their definition: month ends as of the next trading day, range joins, the deviation of the daily alphas between."""
    return f"""
WITH {ctes('daily', True)}, cal AS (SELECT DISTINCT dt FROM panel),
me AS (SELECT DISTINCT last_day(dt) AS me FROM cal),
st AS (SELECT DISTINCT (SELECT min(dt) FROM cal WHERE cal.dt >= me.me) AS t FROM me),
per AS (SELECT t AS t0, lead(t, {months}) OVER (ORDER BY t) AS t1 FROM st WHERE t IS NOT NULL),
ret AS (SELECT inst, dt, p / lag(p) OVER (PARTITION BY inst ORDER BY dt) - 1 AS r FROM panel),
alpha AS (SELECT ret.inst, ret.dt, ret.r - c.r AS a FROM ret JOIN ret c ON c.dt = ret.dt AND c.inst = (SELECT min(inst) FROM facts)),
vol AS (SELECT t0, inst, count(*) + 1 AS n, CASE WHEN count(*) = count(a) THEN stddev_pop(a) END AS v FROM per JOIN alpha ON alpha.dt > t0 AND alpha.dt <= t1 GROUP BY t0, inst),
born AS (SELECT inst, min(dt) AS d0 FROM facts GROUP BY inst),
t AS (SELECT x.inst, per.t0 AS dt, y.p / x.p - 1 AS fr, y.cp / x.cp - 1 AS fc, CASE WHEN n >= 5 THEN greatest(coalesce(v, 1e-8), 1e-8) ELSE 1e-8 END AS v
      FROM per JOIN panel x ON x.dt = per.t0 JOIN panel y ON y.dt = per.t1 AND y.inst = x.inst JOIN vol ON vol.t0 = per.t0 AND vol.inst = x.inst JOIN born ON born.inst = x.inst WHERE per.t0 - d0 >= 567 AND x.inst <> x.core)
SELECT inst, dt, round(fr, 6) + 0.0e0 AS forward_return, round(fc, 6) + 0.0e0 AS core_return, round(fr - fc, 6) + 0.0e0 AS forward_alpha, round((fr - fc) / v, 4) + 0.0e0 AS forward_ir FROM t WHERE fr - fc IS NOT NULL"""


SQL["forward_targets"] = _targets_sql(1)
for _months in (3, 6):
    QUERIES[f"forward_targets_{_months}m"] = lambda spark, sf_dir, k=_months: strategy.run(spark, sf_dir, *PLANS["forward_targets"], horizon=k)
    SQL[f"forward_targets_{_months}m"] = _targets_sql(_months)


def greedy_ensemble(spark: SparkSession, sf_dir: str):
    """The greedy choice walks over at most 30 features of one date: one small group a task row."""
    scores = strategy.run(spark, sf_dir, "scores", "feature, n, dt, mu, sigma, expected_ir, p_positive", f"WHERE i >= {strategy.SKIP_DATES}")
    return scores.groupBy("n", "dt").applyInPandas(greedy_groups, "n long, dt date, step int, feature string, utility double")


QUERIES["greedy_ensemble"] = greedy_ensemble

