"""Integer allocation, portfolio simulation and metrics. Each runs over one strategy's or one month's small ordered series, as a grouped function."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame

CORE_SHARE = 0.6
MOST_STEPS = 1000


def allocate(prices: Mapping[str, float], targets: Mapping[str, float], budget: float) -> dict[str, int]:
    """Whole shares: floors of the targets' shares of the budget, then one share at a time, the affordable one that leaves the least sum of squared
    deviations of the percentages of what is allocated so far, until none is affordable. ValueError for a missing price."""
    missing = [k for k in targets if not (prices.get(k) or 0) > 0]
    if missing:
        raise ValueError(f"no price for {missing}")
    names = sorted(targets)
    n = {k: math.floor(budget * targets[k] / prices[k]) for k in names}
    for _ in range(MOST_STEPS):
        left = budget - sum(n[k] * prices[k] for k in names)
        can = [k for k in names if prices[k] <= left]
        if not can:
            break

        def off(extra: str) -> float:
            worth = {k: (n[k] + (k == extra)) * prices[k] for k in names}
            total = sum(worth.values())
            return sum((worth[k] / total - targets[k]) ** 2 for k in names)

        n[min(can, key=lambda k: (off(k), k))] += 1
    return n


def core_satellite(core: str, satellites: list[str], core_share: float = CORE_SHARE) -> dict[str, float]:
    return {core: core_share} | {s: (1 - core_share) / len(satellites) for s in satellites}


def every(months: int) -> Callable[[pd.Timestamp, pd.Timestamp], bool]:
    """Rebalance trigger: so many months since the last."""
    return lambda last, now: (now.year - last.year) * 12 + now.month - last.month >= months


def simulate(prices: pd.DataFrame, weights: Mapping, *, initial: float = 10_000.0, monthly: float = 0.0, trigger: Callable = every(3), smart: bool = False) -> pd.DataFrame:
    """prices: dates by instrument. Value, cash and whether it rebalanced, for every date. ``smart``: with cash coming in, drop what left the weights, trim
    what is over its weight, buy what is under in the order of weight until the cash is spent, spread the rest."""
    total = sum(weights.values())
    if not 0.99 <= total <= 1.01:
        raise ValueError(f"weights sum to {total}")
    units, cash, last, rows = dict.fromkeys(weights, 0.0), 0.0, None, []
    month = None
    for dt, row in prices.iterrows():
        p = {k: float(row[k]) for k in weights}
        came = last is None or (monthly > 0 and (dt.year, dt.month) != month)
        if came:
            cash += initial if last is None else monthly
        month = (dt.year, dt.month)
        due = last is None or trigger(last, dt)
        if due:
            value = cash + sum(units[k] * p[k] for k in units)
            if smart:
                for k in units:
                    over = units[k] * p[k] - value * weights[k]
                    if over > 0:
                        units[k] -= over / p[k]
                        cash += over
                for k in sorted(weights, key=lambda k: (-weights[k], k)):
                    under = min(cash, max(0.0, value * weights[k] - units[k] * p[k]))
                    units[k] += under / p[k]
                    cash -= under
                if cash > 0.01:
                    for k in weights:
                        units[k] += cash * weights[k] / total / p[k]
                    cash = 0.0
            else:
                units = {k: value * weights[k] / p[k] for k in weights}
                cash = value - sum(units[k] * p[k] for k in units)
            last = dt
        elif came and smart:
            for k in weights:
                units[k] += cash * weights[k] / total / p[k]
            cash = 0.0
        rows.append((dt, cash + sum(units[k] * p[k] for k in units), cash, bool(due)))
    return pd.DataFrame(rows, columns=["dt", "value", "cash", "rebalanced"])


def simulate_groups(panel: DataFrame, **options) -> DataFrame:
    """panel(strategy, inst, dt, p, weight) to (strategy, dt, value, cash, rebalanced); each strategy is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["dt"] = pd.to_datetime(pdf["dt"])
        prices = pdf.pivot(index="dt", columns="inst", values="p").sort_index().ffill().dropna()
        out = simulate(prices, dict(pdf.drop_duplicates("inst").set_index("inst")["weight"]), **options)
        out.insert(0, "strategy", pdf["strategy"].iloc[0])
        out["dt"] = out["dt"].dt.date
        return out

    return panel.groupBy("strategy").applyInPandas(run, "strategy string, dt date, value double, cash double, rebalanced boolean")
