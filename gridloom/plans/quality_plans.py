"""Data-quality reports over the daily panel, as SQL that both engines share."""

from __future__ import annotations

from gridloom.functions.sql import DUCK, SPARK
from gridloom.registry import QUERIES, SQL
from gridloom.sources import panels

_LIVE = "live AS (SELECT *, min(CASE WHEN p IS NOT NULL THEN dt END) OVER (PARTITION BY inst) AS first_dt FROM panel)"
_SEEN = "seen AS (SELECT inst, dt, p, lag(dt) OVER (PARTITION BY inst ORDER BY dt) AS before, lag(p) OVER (PARTITION BY inst ORDER BY dt) AS was FROM panel WHERE p IS NOT NULL)"


def _days(d, a, b):
    return f"datediff({a}, {b})" if d.spark else f"date_diff('day', {b}, {a})"


REPORTS = {
    "dq_missing": lambda d: f"{_LIVE} SELECT inst, count(*) AS n_days, count(p) AS n_prices, {d.out('100.0e0 * (count(*) - count(p)) / count(*)')} AS missing_pct, 100.0e0 * (count(*) - count(p)) / count(*) > 10 AS flagged FROM live WHERE dt >= first_dt GROUP BY inst",
    "dq_coverage_by_date": lambda d: f"{_LIVE} SELECT dt, count(p) AS n_prices, {d.out('1.0e0 * count(p) / count(*)')} AS coverage FROM live GROUP BY dt",
    "dq_outliers": lambda d: f"{_SEEN} SELECT inst, count(*) AS n, count(CASE WHEN abs(p / NULLIF(was, 0) - 1) > 0.1 THEN 1 END) AS n_outliers, {d.out('100.0e0 * sum(CASE WHEN abs(p / NULLIF(was, 0) - 1) > 0.1 THEN 1 ELSE 0 END) / count(*)')} AS pct FROM seen WHERE was IS NOT NULL GROUP BY inst",
    "dq_history": lambda d: f"back AS (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY dt DESC) AS j FROM panel) SELECT inst, {', '.join(f'sum(CASE WHEN j <= {2 * w} AND p IS NOT NULL THEN 1 ELSE 0 END) >= {w} AS enough_{w}' for w in (21, 63, 126, 252, 504, 756, 1260))} FROM back GROUP BY inst",
    "dq_price_levels": lambda d: "back AS (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY dt DESC) AS j FROM panel WHERE p IS NOT NULL) SELECT inst, p, p < 1 AS low, p > 1000 AS high FROM back WHERE j = 1",
    "dq_gap_stale": lambda d: f"{_SEEN}, g AS (SELECT inst, max({_days(d, 'dt', 'before')}) AS longest_gap, count(*) AS n, max(dt) AS last_dt FROM seen GROUP BY inst) SELECT inst, CAST(longest_gap AS BIGINT) AS longest_gap, n, longest_gap > 10 AS gappy, {_days(d, '(SELECT max(dt) FROM panel)', 'last_dt')} > 7 AS stale, n < 252 AS short, 1.0e0 * n / (SELECT count(DISTINCT dt) FROM panel) < 0.85 AS sparse FROM g",
    "dq_core_stats": lambda d: f"{_SEEN}, r AS (SELECT inst, p / NULLIF(was, 0) - 1 AS r FROM seen WHERE was IS NOT NULL) SELECT inst, {d.out('avg(r) * 252')} AS ann_return, {d.out('stddev_samp(r) * sqrt(252)')} AS volatility, {d.out(d.div('avg(r) * 252', 'stddev_samp(r) * sqrt(252)'))} AS sharpe FROM r GROUP BY inst",
    "dq_db_diff": lambda d: "o AS (SELECT inst, dt, p FROM panel WHERE p IS NOT NULL AND day(dt) <> 5), n AS (SELECT inst, dt, CASE WHEN day(dt) = 9 THEN p * 1.02e0 ELSE p END AS p FROM panel WHERE p IS NOT NULL AND day(dt) <> 6), j AS (SELECT coalesce(o.inst, n.inst) AS inst, o.p AS a, n.p AS b FROM o FULL JOIN n ON o.inst = n.inst AND o.dt = n.dt) "
    "SELECT inst, count(CASE WHEN b IS NULL THEN 1 END) AS only_old, count(CASE WHEN a IS NULL THEN 1 END) AS only_new, count(CASE WHEN abs(a - b) / a > 0.01 THEN 1 END) AS n_mismatch, round(max(abs(a - b)), 4) + 0.0e0 AS max_diff FROM j GROUP BY inst",
}


def _text(name, d):
    return f"WITH {panels.ctes('daily', False, d)}, {REPORTS[name](d)}"


def _add(name):
    def run(spark, sf_dir):
        panels.views(spark, sf_dir)
        return spark.sql(_text(name, SPARK))

    QUERIES[name], SQL[name] = run, _text(name, DUCK)


for _n in REPORTS:
    _add(_n)

_INTEGRITY = "SELECT (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS orphan_prices, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)) AS without_prices, (SELECT count(*) FROM lineitem WHERE l_extendedprice IS NULL) AS null_prices"


def dq_integrity(spark, sf_dir):
    panels.views(spark, sf_dir)
    return spark.sql(
        "SELECT (SELECT count(*) FROM lineitem LEFT ANTI JOIN supplier ON l_suppkey = s_suppkey) AS orphan_prices, (SELECT count(*) FROM supplier LEFT ANTI JOIN lineitem ON l_suppkey = s_suppkey) AS without_prices, (SELECT count(*) FROM lineitem WHERE l_extendedprice IS NULL) AS null_prices"
    )


QUERIES["dq_integrity"], SQL["dq_integrity"] = dq_integrity, _INTEGRITY
