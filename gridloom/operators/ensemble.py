"""Greedy ensemble selection over the scores of one date, and its utility."""

from __future__ import annotations

import math

import pandas as pd

CANDIDATES = 30
LEAST_SIZE = 8
MOST = 10
GAIN = 0.001


def utility(mu: list[float], p: list[float], sigma: list[float]) -> float:
    """Mean of mu times the geometric mean of the clipped probabilities, over the root mean square of sigma; minus infinity for an empty or riskless set."""
    n = len(mu)
    if not n:
        return -math.inf
    risk = math.sqrt(sum(s * s for s in sigma) / n)
    if risk <= 0:
        return -math.inf
    return sum(mu) / n * math.exp(sum(math.log(min(max(x, 0.01), 0.99)) for x in p) / n) / risk


def greedy(features: list[str], mu: list[float], sigma: list[float], ir: list[float], p: list[float]) -> list[tuple[str, float]]:
    """Chosen features with the utility after each. Starts with the best by (ir, mu), then adds the one of most utility while the set is small or the gain
    exceeds GAIN; equal utilities go to the higher ir, then the smaller name."""
    order = sorted(range(len(features)), key=lambda i: (-ir[i], -mu[i], features[i]))[:CANDIDATES]
    if not order:
        return []
    chosen, rest = [order[0]], order[1:]
    value = lambda ids: utility([mu[i] for i in ids], [p[i] for i in ids], [sigma[i] for i in ids])
    now = value(chosen)
    out = [(features[chosen[0]], now)]
    while rest and len(chosen) < MOST:
        best = max(rest, key=lambda i: (value([*chosen, i]), ir[i], [-ord(c) for c in features[i]]))
        new = value([*chosen, best])
        if len(chosen) >= LEAST_SIZE and (new == now or new - now <= GAIN):
            break
        chosen.append(best)
        rest.remove(best)
        now = new
        out.append((features[best], now))
    return out


def greedy_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """One (n, dt) group of scores."""
    out = greedy(pdf["feature"].tolist(), pdf["mu"].tolist(), pdf["sigma"].tolist(), pdf["expected_ir"].tolist(), pdf["p_positive"].fillna(0.5).tolist())
    return pd.DataFrame({"n": pdf["n"].iloc[0], "dt": pdf["dt"].iloc[0], "step": range(1, len(out) + 1), "feature": [f for f, _ in out], "utility": [u for _, u in out]})
