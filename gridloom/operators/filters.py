"""Smoothing filters by name: recursive ones (exponential averages, Kalman, Butterworth), finite kernels, order statistics.

Recursive filters are left folds over an instrument's ordered values: ``recursive`` and ``oscillators`` are grouped numpy passes over whole series, per instrument, with a state of constant size.
Finite kernels are array expressions over the last w rows and stay in the JVM. ``orientation`` says on which end a weighted
kernel puts its largest weight: ``recent``, or ``reference`` (the oldest), which is what an unreversed convolution does.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.sql import Dialect

# finite kernels ------------------------------------------------------------------------------------------------------


def wma_weights(w: int, orientation: str = "recent") -> list[float]:
    """Linear weights, oldest row first."""
    up = [2 * (k + 1) / (w * (w + 1)) for k in range(w)]
    return up if orientation == "recent" else up[::-1]


def gauss_weights(w: int, orientation: str = "recent") -> list[float]:
    raw = [math.exp(-0.5 * ((k - (w - 1)) / (w / 4)) ** 2) for k in range(w)]
    up = [x / sum(raw) for x in raw]
    return up if orientation == "recent" else up[::-1]


def savgol_weights(w: int, order: int = 2) -> list[float]:
    """End-point weights of a least-squares polynomial over w rows (even w: w + 1), oldest first."""
    w += 1 - w % 2
    x = np.vander(np.arange(-(w - 1), 1.0), order + 1, increasing=True)
    return np.linalg.pinv(x)[0].tolist()


def kernel(d: Dialect, x: str, weights: list[float]) -> list[dict]:
    """Weighted sum of the last rows; needs them all."""
    return d.zipped(d.rolled(x, len(weights)), weights)


def sma(d: Dialect, x: str, w: int) -> str:
    """Mean of what is there among the last w rows, from row w + 1 on; null where the input is."""
    return f"CASE WHEN {x} IS NOT NULL AND row_number() OVER (PARTITION BY inst ORDER BY dt) > {w} THEN avg({x}) OVER {d.ts(w)} END"


def fir(d: Dialect) -> list[dict]:
    half, root = 5, 3
    first = {f"sma_{w}": sma(d, "p", w) for w in (10, 21)} | {f"v_{w}": d.rolled("p", w) for w in (root, half, 10, 21, 51)}
    second = {f"wma_{o}_10": d.zipped("v_10", wma_weights(10, o)) for o in ("recent", "reference")} | {"wma_5": d.zipped("v_5", wma_weights(5))}
    second |= {f"gauss_{o}_21": d.zipped("v_21", gauss_weights(21, o)) for o in ("recent", "reference")} | {"savgol_51": d.zipped("v_51", savgol_weights(50)), "savgol_21": d.zipped("v_21", savgol_weights(21))}
    third = {"hull_in": "2 * wma_5 - wma_recent_10", "trima_21": sma(d, "sma_21", 10), "trima_10": sma(d, "sma_10", 5)}
    return [first, second, third, {"vh": d.rolled("hull_in", 3)}, {"hull_10": d.zipped("vh", wma_weights(3))}]


def median(d: Dialect) -> list[dict]:
    return [{f"median_{w}": f"CASE WHEN p IS NOT NULL AND row_number() OVER (PARTITION BY inst ORDER BY dt) >= {w} THEN {d.quantile('p', 0.5, d.ts(w))} END" for w in (5, 21)}]


# recursive filters over whole series ------------------------------------------------------------------------------------


def _filled(x: np.ndarray) -> np.ndarray:
    s = pd.Series(x).ffill().bfill()
    return s.to_numpy(dtype=float)


def _masked(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.nan, y)


def ema(x: np.ndarray, span: float, alpha: float | None = None) -> np.ndarray:
    """y0 = x0, y = y + a (x - y); gaps filled first and masked after."""
    a = 2 / (span + 1) if alpha is None else alpha
    f = _filled(x)
    y = np.empty_like(f)
    now = f[0] if len(f) else np.nan
    for i, v in enumerate(f):
        now = now + a * (v - now)
        y[i] = now
    return _masked(y, x)


def ewm(x: np.ndarray, span: float) -> np.ndarray:
    """Adjusted exponential mean with a numerator and a denominator; missing values only age the weights."""
    q, num, den = 1 - 2 / (span + 1), 0.0, 0.0
    y = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        num, den = num * q, den * q
        if not np.isnan(v):
            num, den = num + v, den + 1
        if den > 0:
            y[i] = num / den
    return y


def dema(x, span):
    e = ema(x, span)
    return 2 * e - ema(e, span)


def tema(x, span):
    e1 = ema(x, span)
    e2 = ema(e1, span)
    return 3 * e1 - 3 * e2 + ema(e2, span)


def zlema(x, span):
    k = max(1, (span - 1) // 2)
    back = np.concatenate([np.full(min(k, len(x)), np.nan), x[:-k] if k < len(x) else []])
    return ema(np.where(np.isnan(back), x, 2 * x - back), span)


def kalman_steady(x, q=0.01, r=1.0):
    """Fixed gain of the steady state, from a zero state."""
    p = (math.sqrt(q * q + 4 * q * r) + q) / 2
    gain, now = p / (p + r), 0.0
    y = np.empty(len(x))
    for i, v in enumerate(_filled(x)):
        now += gain * (v - now)
        y[i] = now
    return _masked(y, x)


def kalman(x, q=0.01, r=1.0):
    """Scalar predict and update; gaps only predict."""
    y, state, p = np.full(len(x), np.nan), None, 1.0
    for i, v in enumerate(x):
        p += q
        if not np.isnan(v):
            if state is None:
                state = v
            gain = p / (p + r)
            state, p = state + gain * (v - state), (1 - gain) * p
        if state is not None:
            y[i] = state
    return y


def butterworth(x, cutoff=21):
    """Order 2 low pass at 1/cutoff of the Nyquist rate by the bilinear transform, from a zero state; the first ``cutoff`` rows are null."""
    c = 1 / math.tan(math.pi / (2 * cutoff))
    n = 1 + math.sqrt(2) * c + c * c
    b0, b1, a1, a2 = 1 / n, 2 / n, 2 * (1 - c * c) / n, (1 - math.sqrt(2) * c + c * c) / n
    x1 = x2 = y1 = y2 = 0.0
    y = np.empty(len(x))
    for i, v in enumerate(_filled(x)):
        out = b0 * v + b1 * x1 + b0 * x2 - a1 * y1 - a2 * y2
        x1, x2, y1, y2 = v, x1, out, y1
        y[i] = out
    y[:cutoff] = np.nan
    return _masked(y, x)


def kama(x, period=21, fast=2, slow=30):
    """Adaptive average: the smoothing constant follows the share of net in total movement; starts at the period-th valid value. The past value is the nearest one there,
    period to period + 9 rows back (none: the average stands still); only moves between two neighbouring values count."""
    lo, hi = 2 / (slow + 1), 2 / (fast + 1)
    at = np.flatnonzero(~np.isnan(x))
    y = np.full(len(x), np.nan)
    if len(at) < period:
        return y
    moves = pd.Series(np.abs(np.diff(x, prepend=np.nan))).rolling(period, min_periods=0).sum().to_numpy()
    now = y[at[period - 1]] = x[at[period - 1]]
    for i in at[period:]:
        before = x[max(0, i - period - 9) : i - period + 1]
        before = before[~np.isnan(before)]
        if len(before):
            ratio = min(abs(x[i] - before[-1]) / moves[i], 1.0) if moves[i] > 1e-10 else 0.0
            now += (ratio * (hi - lo) + lo) ** 2 * (x[i] - now)
        y[i] = now
    return y


def regime_switch(x, fast=10, slow=50):
    """The fast average where the deviation of the last 21 absolute moves exceeds that of the last 84, else the slow; a gap anywhere before leaves the slow one."""
    r = pd.Series(x).diff().abs()
    ratio = (r.rolling(21).std(ddof=0) / (r.rolling(84).std(ddof=0) + 1e-10)).to_numpy()
    broken = np.cumsum(np.isnan(x)) > 0
    return np.where((ratio > 1) & ~broken, ema(x, fast), ema(x, slow))


def rolled_mean(x, span):
    """Mean of what is there among the last rows, from row span + 1 on."""
    y = pd.Series(x).rolling(span, min_periods=1).mean().to_numpy(copy=True)
    y[:span] = np.nan
    return _masked(y, x)


def weighted(x, weights):
    w = np.asarray(weights)
    y = np.full(len(x), np.nan)
    if len(x) >= len(w):
        y[len(w) - 1 :] = np.lib.stride_tricks.sliding_window_view(x, len(w)) @ w
    return y


def hull(x, span, orientation="recent"):
    half, root = max(2, span // 2), max(2, math.isqrt(span))
    return weighted(2 * weighted(x, wma_weights(half, orientation)) - weighted(x, wma_weights(span, orientation)), wma_weights(root, orientation))


def trima(x, span):
    return rolled_mean(rolled_mean(x, span), max(2, span // 2))


def gauss(x, span, orientation="recent"):
    """Half of the rows must be there; missing ones count as 0."""
    y = weighted(np.nan_to_num(x), gauss_weights(span, orientation))
    share = pd.Series(~np.isnan(x)).astype(float).rolling(span).mean().to_numpy()
    return _masked(np.where(share >= 0.5, y, np.nan), x)


def moving_median(x, span):
    y = pd.Series(x).rolling(span, min_periods=1).median().to_numpy(copy=True)
    y[: span - 1] = np.nan
    return _masked(y, x)


def savgol(x, span, order=2):
    return _savgol(np.asarray(x, dtype=float), np.array(savgol_weights(span, order)))


def _both(name: str, f: Callable, **more) -> dict:
    return {f"{name}_{w}d": (f, {"span": w} | more) for w in (21, 63)}


#: Filter name to (function of one series, arguments). ``raw`` is the identity.
FILTERS: dict[str, tuple[Callable, dict]] = (
    {"raw": (lambda x: x, {}), "regime_10_50": (regime_switch, {}), "butter_21d": (butterworth, {"cutoff": 21}), "butter_63d": (butterworth, {"cutoff": 63})}
    | {"kalman_fast": (kalman_steady, {"q": 1e-4, "r": 1e-2}), "kalman_slow": (kalman_steady, {"q": 1e-5, "r": 1e-2}), "kalman_full": (kalman, {}), "kama_21d": (kama, {"period": 21}), "adaptive_ema": (ema, {"span": 63})}
    | _both("ema", ema) | _both("dema", dema) | _both("tema", tema) | _both("zlema", zlema) | _both("hull", hull) | _both("trima", trima) | _both("gauss", gauss)
    | _both("median", moving_median) | _both("savgol", savgol, order=3) | _both("sma", rolled_mean)
)


def available() -> list[str]:
    return sorted(FILTERS)


def get(name: str) -> tuple[Callable, dict]:
    """KeyError for an unknown name."""
    return FILTERS[name]


def describe() -> dict[str, dict]:
    """Name to the function's name and its arguments."""
    return {n: {"function": f.__name__, **kw} for n, (f, kw) in FILTERS.items()}


def smoothed(panel: DataFrame, signals: list[str], names: list[str], done: DataFrame | None = None) -> DataFrame:
    """(inst, dt, signal, value) for every pair of a signal column and a filter, named ``{signal}__{filter}``; those in done(signal) are left out."""
    skip = {r[0] for r in done.select("signal").distinct().collect()} if done is not None else set()
    pairs = [(c, n) for c in signals for n in names if f"{c}__{n}" not in skip]
    kind = panel.schema["inst"].dataType.simpleString()
    chosen = {n: get(n) for n in names}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        parts = [pd.DataFrame({"inst": pdf["inst"], "dt": pdf["dt"], "signal": f"{c}__{n}", "value": chosen[n][0](pdf[c].to_numpy(dtype=float), **chosen[n][1])}) for c, n in pairs]
        return pd.concat(parts) if parts else pd.DataFrame({"inst": pdf["inst"][:0], "dt": pdf["dt"][:0], "signal": [], "value": []})

    out = panel.select("inst", "dt", *signals).groupBy("inst").applyInPandas(run, f"inst {kind}, dt date, signal string, value double")
    return out.selectExpr("inst", "dt", "signal", "nanvl(value, NULL) AS value")


def recursive(panel: DataFrame, names: list[str], value: str = "p") -> DataFrame:
    """panel(inst, dt, value) with a column for each named filter; one ordered pass over each instrument's series."""
    kind = panel.schema["inst"].dataType.simpleString()
    chosen = {n: get(n) for n in names}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        x = pdf[value].to_numpy(dtype=float)
        return pd.DataFrame({"inst": pdf["inst"], "dt": pdf["dt"]} | {n: f(x, **kw) for n, (f, kw) in chosen.items()})

    out = panel.select("inst", "dt", value).groupBy("inst").applyInPandas(run, f"inst {kind}, dt date, " + ", ".join(f"{n} double" for n in names))
    return out.selectExpr("inst", "dt", *[f"nanvl({n}, NULL) AS {n}" for n in names])


# oscillators on exponential averages --------------------------------------------------------------------------------------


def _average(x: np.ndarray, span: float = 0, alpha: float | None = None, least: int = 0) -> np.ndarray:
    """Not adjusted exponential mean from the first value on; null until ``least`` values are seen."""
    a = 2 / (span + 1) if alpha is None else alpha
    return pd.Series(x).ewm(alpha=a, adjust=False, min_periods=least).mean().to_numpy()


PAIRS = ((12, 26), (10, 20), (20, 40), (20, 50))


def macd_family(x: np.ndarray) -> dict[str, np.ndarray]:
    """MACD lines, signals (9) and histograms on not adjusted averages; PPO and APO on adjusted ones."""
    out = {}
    for f, s in PAIRS:
        line = _average(x, f, least=f) - _average(x, s, least=s)
        signal = _average(line, 9, least=9)
        fast, slow = ewm(x, f), ewm(x, s)
        with np.errstate(divide="ignore", invalid="ignore"):
            ppo = np.where(slow == 0, np.nan, 100 * (fast - slow) / slow)
        after = ewm(ppo, 9)
        out |= {f"macd_line_{f}_{s}": line, f"macd_signal_{f}_{s}": signal, f"macd_hist_{f}_{s}": line - signal, f"ppo_{f}_{s}": ppo, f"ppo_signal_{f}_{s}": after, f"ppo_hist_{f}_{s}": ppo - after, f"apo_{f}_{s}": fast - slow}
    with np.errstate(divide="ignore", invalid="ignore"):
        out["macd_normalized"] = np.where(x == 0, np.nan, 100 * out["macd_line_12_26"] / x)
    return out


def oscillator_family(x: np.ndarray) -> dict[str, np.ndarray]:
    """RSI (14, Wilder), TSI (25, 13) and TRIX (15) with their signals."""
    move = np.diff(x, prepend=np.nan)
    gain, loss = (_average(np.where(np.nan_to_num(v) > 0, v, 0.0), alpha=1 / 14, least=14) for v in (move, -move))
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
        twice = [_average(_average(v, 25, least=25), 13, least=13) for v in (move, np.abs(move))]
        tsi = np.where(twice[1] == 0, np.nan, 100 * twice[0] / twice[1])
        third = ewm(ewm(ewm(x, 15), 15), 15)
        before = np.concatenate([[np.nan], third[:-1]])
        trix = np.where(before == 0, np.nan, 100 * (third / before - 1))
    return {"rsi_14": np.where(np.isnan(gain), np.nan, rsi), "rsi_reversion": np.where(np.isnan(gain), np.nan, 50 - rsi), "tsi": tsi, "tsi_signal": ewm(tsi, 7), "trix": trix, "trix_signal": ewm(trix, 9)}


def oscillators(panel: DataFrame, family: Callable[[np.ndarray], dict[str, np.ndarray]], value: str = "p") -> DataFrame:
    """(inst, dt, a column for each member of the family); one ordered pass over each instrument's whole series."""
    kind = panel.schema["inst"].dataType.simpleString()
    names = list(family(np.array([1.0, 2.0])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        return pd.DataFrame({"inst": pdf["inst"], "dt": pdf["dt"]} | family(pdf[value].to_numpy(dtype=float)))

    out = panel.select("inst", "dt", value).groupBy("inst").applyInPandas(run, f"inst {kind}, dt date, " + ", ".join(f"{n} double" for n in names))
    return out.selectExpr("inst", "dt", *[f"nanvl({n}, NULL) AS {n}" for n in names])


# grids -----------------------------------------------------------------------------------------------------------------


def dpo_grid(periods=range(10, 101, 2), divisors=None) -> dict[str, tuple[int, int]]:
    """Name to (period, shift). Divisors run from 1 to 3 by repeated steps of 0.2 in floating point, as the grid is defined."""
    divisors = np.arange(1.0, 3.1, 0.2) if divisors is None else divisors
    return {f"dpo_{p}d__tema__shift_{d:.1f}": (p, max(1, int(p / d))) for p in periods for d in divisors}


def dpo_tema(panel: DataFrame, grid: dict[str, tuple[int, int]], mode: str = "lead", savgol: tuple[int, ...] = ()) -> DataFrame:
    """(inst, dt, signal, value): price shifted by the grid's shift (lead reads later prices, lag is causal) less the triple exponential average, and
    each of them smoothed by causal polynomials. A task row is one instrument and period: its average is computed once, and equal shifts once. The periods
    are a table as small as the grid's definition."""
    kind = panel.schema["inst"].dataType.simpleString()
    names: dict[int, list[tuple[str, int]]] = {}
    for name, (p, k) in grid.items():
        names.setdefault(p, []).append((name, k))
    periods = panel.sparkSession.createDataFrame([(p,) for p in names], "period int")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        x, p = pdf["p"].to_numpy(dtype=float), int(key[1])
        smooth = tema(x, p)
        done: dict[tuple, np.ndarray] = {}
        parts = []

        def add(name, key, make):
            if key not in done:
                done[key] = make()
            parts.append(pd.DataFrame({"inst": pdf["inst"], "dt": pdf["dt"], "signal": name, "value": done[key]}))

        for name, k in names[p]:
            moved = pd.Series(x).shift(-k if mode == "lead" else k).to_numpy()
            add(name, (k,), lambda m=moved: m - smooth)
            for w in savgol:
                weights = np.array(savgol_weights(w))
                add(f"{name}__savgol_{w}d_polyorder_2", (k, len(weights)), lambda s=done[k,], c=weights: _savgol(s, c))
        return pd.concat(parts)

    each = panel.select("inst", "dt", "p").crossJoin(F.broadcast(periods)).groupBy("inst", "period")
    return each.applyInPandas(run, f"inst {kind}, dt date, signal string, value double").selectExpr("inst", "dt", "signal", "nanvl(value, NULL) AS value")


def _savgol(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w, f = len(weights), pd.Series(x).ffill().to_numpy()
    y = np.full(len(x), np.nan)
    if len(x) > w:
        y[w - 1 :] = np.lib.stride_tricks.sliding_window_view(f, w) @ weights
    y[:w] = np.nan
    return _masked(y, x)


#: Query name to (program, hidden prefixes) for the array kernels.
FAMILIES = {
    "fir_filters": (fir, ("v_", "hull_in", "vh", "wma_5")),
    "rolling_median": (median, ()),
}
