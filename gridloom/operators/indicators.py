"""Twenty-five cross-sectional indicators of a value on its date, named by what they hold. leq: values at most as large, as a share."""

from __future__ import annotations

from gridloom.functions.sql import Dialect


def stages(d: Dialect, x: str = "p") -> list[dict]:
    xs = d.XS
    low = {
        "n": f"count({x}) OVER {xs}", "mu": f"avg({x}) OVER {xs}", "sd": f"stddev_pop({x}) OVER {xs}", "lo": f"min({x}) OVER {xs}", "hi": f"max({x}) OVER {xs}",
        "med": d.quantile(x, 0.5, xs), "q25": d.quantile(x, 0.25, xs), "q75": d.quantile(x, 0.75, xs), "q80": d.quantile(x, 0.8, xs), "q90": d.quantile(x, 0.9, xs),
        "leq": f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY dt ORDER BY CASE WHEN {x} IS NULL THEN 1 ELSE 0 END, {x}) + count(*) OVER (PARTITION BY dt, {x}) - 1) * 1.0e0 END",
    }
    mid = {"dev": f"avg(abs({x} - med)) OVER {xs}", "above": f"avg(CASE WHEN {x} > med THEN 1.0e0 WHEN {x} IS NOT NULL THEN 0.0e0 END) OVER {xs}", "mass": f"sum(exp({x} - hi)) OVER {xs}", "z": f"CASE WHEN sd > 1e-10 THEN ({x} - mu) / sd ELSE 0.0e0 END", "iqr": "q75 - q25"}
    flag = lambda c: f"CASE WHEN {c} THEN 1.0e0 ELSE 0.0e0 END"
    out = {
        "raw": x, "zscore": "z", "rank_share": "leq / n", "rank_share_2": "leq / n", "above_median": flag(f"{x} > med"), "top_20": flag(f"{x} >= q80"), "top_10": flag(f"{x} >= q90"), "less_median": f"{x} - med", "less_mean": f"{x} - mu", "less_p90": f"{x} - q90",
        "share_of_max": f"CASE WHEN hi > 1e-10 THEN {x} / hi ELSE 1.0e0 END", "abs_less_mean": f"abs({x} - mu)", "abs_share_of_mean": f"CASE WHEN abs(mu) > 1e-10 THEN abs({x}) / abs(mu) ELSE 1.0e0 END", "min_max": f"CASE WHEN hi - lo > 1e-10 THEN ({x} - lo) / (hi - lo) ELSE 0.5e0 END", "percentile": "100 * leq / n", "zscore_clipped": d.clip("z", "-3.0e0", "3.0e0"),
        "robust_deviation": f"CASE WHEN dev > 1e-10 THEN abs({x} - med) / dev ELSE 0.0e0 END", "iqr_position": f"CASE WHEN iqr > 1e-10 THEN ({x} - q25) / iqr ELSE 0.5e0 END", "softmax": f"exp({x} - hi) / mass", "log_to_mean": f"CASE WHEN {x} > 1e-10 AND mu > 1e-10 THEN ln({x} / mu) ELSE 0.0e0 END", "breadth": "above", "min_max_2": f"CASE WHEN hi - lo > 1e-10 THEN ({x} - lo) / (hi - lo) ELSE 0.5e0 END",
        "decile": "10 * leq / n", "quartile": "least(floor(4 * leq / n), 3) * 1.0e0", "not_above": "leq / n",
    }
    return [low, mid, {f"x_{k}": f"CASE WHEN n >= 2 AND {x} IS NOT NULL THEN {v} END" for k, v in out.items()}]


NAMES = [n for n in stages(Dialect(True))[2]]
