"""Queries of allocation, simulation, portfolio metrics and parameter statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions.sql import DUCK, SPARK
from gridloom.operators import filters, portfolio, strategy
from gridloom.registry import QUERIES, SQL
from gridloom.sources import panels


def allocation_integer(spark, sf_dir):
    """The vote's selection of every month, in whole shares of 100,000."""
    picked = strategy.run(spark, sf_dir, "picked", "n, dt, inst")
    p = panels.panel(spark, sf_dir, "daily", True)
    core = p.where("inst = core").select("dt", F.col("inst").alias("core"), F.col("p").alias("core_p"))
    rows = picked.join(p.select("inst", "dt", "p"), ["inst", "dt"]).join(core, "dt")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        core, budget = pdf["core"].iloc[0], 100_000.0
        prices = {i: float(x) for i, x in zip(pdf["inst"], pdf["p"], strict=True)} | {core: float(pdf["core_p"].iloc[0])}
        targets = portfolio.core_satellite(core, list(pdf["inst"]))
        got = portfolio.allocate(prices, targets, budget)
        cost = {k: got[k] * prices[k] for k in got}
        spent = sum(cost.values())
        return pd.DataFrame([{"n": pdf["n"].iloc[0], "dt": pdf["dt"].iloc[0], "inst": k, "quantity": got[k], "price": prices[k], "total_cost": cost[k], "percentage": 100 * cost[k] / spent if spent else 0.0, "target": 100 * targets[k]} for k in sorted(got)])

    return rows.groupBy("n", "dt").applyInPandas(run, "n long, dt date, inst string, quantity long, price double, total_cost double, percentage double, target double")


QUERIES["allocation_integer"] = allocation_integer

_VALUE = "SELECT inst, dt, p, p / NULLIF(lag(p) OVER (PARTITION BY inst ORDER BY dt), 0) - 1 AS r, p / max(p) OVER (PARTITION BY inst ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd, row_number() OVER (PARTITION BY inst ORDER BY dt) AS i, row_number() OVER (PARTITION BY inst ORDER BY dt DESC) AS j FROM panel WHERE p IS NOT NULL"
_TOTALS = "SELECT inst, count(r) AS n, max(CASE WHEN j = 1 THEN p END) / max(CASE WHEN i = 1 THEN p END) - 1 AS total, stddev_samp(r) * sqrt(252) AS vol, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS down, min(dd) AS max_dd FROM v GROUP BY inst"


def _metrics(d):
    ann = "(power(1 + total, 252.0e0 / NULLIF(n, 0)) - 1)"
    parts = {"total_return": "total", "ann_return": ann, "volatility": "vol", "sharpe": d.div(ann, "vol"), "sortino": d.div(ann, "down"), "max_drawdown": "max_dd", "calmar": d.div(ann, "abs(max_dd)")}
    return f"WITH {panels.ctes('regional', True, d)}, v AS ({_VALUE}), t AS ({_TOTALS}) SELECT inst, n, {', '.join(f'{d.out(x)} AS {k}' for k, x in parts.items())} FROM t"


def portfolio_metrics(spark, sf_dir):
    panels.views(spark, sf_dir)
    return spark.sql(_metrics(SPARK))


QUERIES["portfolio_metrics"], SQL["portfolio_metrics"] = portfolio_metrics, _metrics(DUCK)


def _strategies(spark, sf_dir):
    p = panels.panel(spark, sf_dir, "regional", True).where("p IS NOT NULL")
    n = p.select("inst").distinct().count()
    equal = p.select(F.lit("equal").alias("strategy"), "inst", "dt", "p", F.lit(1.0 / n).alias("weight"))
    core = p.select(F.lit("core").alias("strategy"), "inst", "dt", "p", F.when(F.col("inst") == F.col("core"), 0.6).otherwise(0.4 / max(1, n - 1)).alias("weight"))
    return equal.unionByName(core)


def _simulated(**options):
    def run(spark, sf_dir):
        return portfolio.simulate_groups(_strategies(spark, sf_dir), **options).withColumn("value", F.round("value", 6)).withColumn("cash", F.round("cash", 6))

    return run


QUERIES["sim_standard_rebalance"] = _simulated()
QUERIES["sim_smart_cashflow"] = _simulated(monthly=500.0, smart=True)

#: Buy and hold of equal parts, where units never change.
_HOLD = "f AS (SELECT inst, min(dt) AS d0 FROM panel WHERE p IS NOT NULL GROUP BY inst), s AS (SELECT max(d0) AS d0 FROM f), u AS (SELECT panel.inst, 10000.0e0 / (SELECT count(*) FROM f) / p AS units FROM panel, s WHERE dt = d0)"
SQL["sim_buy_and_hold"] = f"WITH {panels.ctes('regional', True)}, {_HOLD} SELECT 'equal' AS strategy, dt, round(sum(units * p), 6) + 0.0e0 AS value FROM panel JOIN u USING (inst), s WHERE dt >= d0 GROUP BY dt"


def sim_buy_and_hold(spark, sf_dir):
    out = portfolio.simulate_groups(_strategies(spark, sf_dir).where("strategy = 'equal'"), trigger=portfolio.every(9999))
    return out.select("strategy", "dt", F.round("value", 6).alias("value"))


QUERIES["sim_buy_and_hold"] = sim_buy_and_hold

_GRID = [(n, p, k) for n, (p, k) in filters.dpo_grid().items()]
_PARSE = ("dpo_([0-9]+)d", "shift_([0-9.]+)")


def feature_name_parse(spark, sf_dir):
    """Period and divisor of every name of the full grid, with its shift."""
    df = spark.createDataFrame(_GRID, "name string, period int, shift int")
    return df.select("name", F.regexp_extract("name", _PARSE[0], 1).cast("int").alias("parsed_period"), F.regexp_extract("name", _PARSE[1], 1).cast("double").alias("parsed_divisor"), "shift")


def param_histogram(spark, sf_dir):
    """Use of each period by names that share its shift parity, with unused ones at zero."""
    df = feature_name_parse(spark, sf_dir)
    used = df.where("shift % 7 = 3").groupBy("parsed_period").agg(F.count("*").alias("n"))
    return df.select("parsed_period").distinct().join(used, "parsed_period", "left").select("parsed_period", F.coalesce("n", F.lit(0)).alias("n"))


_VALUES = ", ".join(f"('{n}', {p}, {k})" for n, p, k in _GRID)
_PARSED = f"SELECT name, CAST(regexp_extract(name, '{_PARSE[0]}', 1) AS INTEGER) AS parsed_period, CAST(regexp_extract(name, '{_PARSE[1]}', 1) AS DOUBLE) AS parsed_divisor, shift FROM (VALUES {_VALUES}) t(name, period, shift)"
QUERIES["feature_name_parse"], SQL["feature_name_parse"] = feature_name_parse, _PARSED
QUERIES["param_histogram"] = param_histogram
SQL["param_histogram"] = f"WITH d AS ({_PARSED}) SELECT a.parsed_period, count(b.name) AS n FROM (SELECT DISTINCT parsed_period FROM d) a LEFT JOIN d b ON a.parsed_period = b.parsed_period AND b.shift % 7 = 3 GROUP BY 1"
