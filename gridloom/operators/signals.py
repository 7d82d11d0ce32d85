"""The signal catalogue: families of named expressions over a panel (inst, dt, p, core, cp).

``base`` makes the shared columns: r (return, no fill), rpad and cpad (filled prices), b (the core's return), a (r - b), rx, px and ax
(cross-section means and r - rx). Each family is a Program over them. Oscillators use high = low = close = price; every formula is the public textbook one.
"""

from __future__ import annotations

from gridloom.functions.sql import Dialect

WINDOWS = (21, 63, 126, 252)
YEAR = 252


def base(d: Dialect) -> list[dict]:
    return [
        {"pf": d.last("p"), "cf": d.last("cp"), "pl": d.lag("p")},
        {"r": f"{d.div('p', 'pl')} - 1"},
        {"b": f"max(CASE WHEN inst = core THEN r END) OVER {d.XS}", "rx": f"avg(r) OVER {d.XS}", "px": f"avg(p) OVER {d.XS}"},
        {"a": "r - b", "ax": "r - rx"},
    ]


def _ret(d: Dialect, x: str, k: int) -> str:
    return f"{d.div(x, d.lag(x, k))} - 1"


def _rs(d: Dialect) -> list[dict]:
    """Momentum m{w}, core momentum c{w}, relative strength rs_{w} and against the cross-section rsu_{w}."""
    return [
        {f"m{w}": _ret(d, "pf", w) for w in WINDOWS} | {f"c{w}": _ret(d, "cf", w) for w in WINDOWS},
        {f"rs_{w}": d.div(f"m{w}", f"c{w}") for w in WINDOWS} | {f"rsu_{w}": d.div(f"m{w}", f"avg(m{w}) OVER {d.XS}") for w in WINDOWS},
    ]


def returns(d):
    return [{"etf_return": "r", "alpha": "a", "alpha_vs_univ": "ax", "ret_pad": _ret(d, "pf", 1), "price_ratio": d.div("p", "cp"), "price_ratio_vs_univ": d.div("p", "px")}, {"log_ratio": d.ln("price_ratio"), "log_ratio_vs_univ": d.ln("price_ratio_vs_univ")}]


def cumulative(d):
    return [{f"cum_return_{w}": d.sum("r", w) for w in WINDOWS} | {f"cum_alpha_core_{w}": d.sum("a", w) for w in WINDOWS} | {f"cum_alpha_univ_{w}": d.sum("ax", w) for w in WINDOWS}]


def momentum(d):
    skip = {63: (21, 42), 126: (21, 42, 63), 252: (21, 42, 63)}
    first = {f"momentum_{w}": _ret(d, "pf", w) for w in WINDOWS} | {f"skip_mom_{t}_{s}": f"{d.div(d.lag('pf', s), d.lag('pf', t))} - 1" for t, ss in skip.items() for s in ss}
    return [first | {"roc_10": f"({_ret(d, 'pf', 10)}) * 100", "roc_20": f"({_ret(d, 'pf', 20)}) * 100", "mom_12_1": f"{d.div(d.lag('pf', 21), d.lag('pf', 252))} - 1"}]


def relative_strength(d):
    return [
        *_rs(d),
        {"mom_accel": f"rs_63 - {d.lag('rs_63', 21)}", "signal_agreement": "rs_21 * rs_252", "momentum_accel_6m": f"rs_126 - {d.lag('rs_126', 21)}", "momentum_accel_6m_3m": f"rs_126 - {d.lag('rs_126', 63)}",
         "momentum_accel_12m": f"rs_252 - {d.lag('rs_252', 21)}", "momentum_accel_12m_3m": f"rs_252 - {d.lag('rs_252', 63)}"}
        | {f"disagreement_{x}_{y}": f"rs_{x} - rs_{y}" for i, x in enumerate(WINDOWS) for y in WINDOWS[i + 1 :]} | {f"sector_rotation_rev_{w}": f"-rs_{w}" for w in WINDOWS},
    ]


def proximity(d):
    return [{"high_52w_proximity": d.div("p", d.max("p", 252)), "low_52w_proximity": d.div("p", d.min("p", 252))}]


def beta(d):
    return [{f"beta_{w}": d.div(d.cov("r", "b", w), d.both("var_samp(b)", "r", "b", w)) for w in WINDOWS}, {f"idio_return_{w}": f"r - beta_{w} * b" for w in WINDOWS}]


def volatility(d):
    return [{f"vol_{w}": f"({d.std('r', w)}) * sqrt({YEAR})" for w in WINDOWS} | {f"cvol_{w}": f"({d.std('b', w)}) * sqrt({YEAR})" for w in WINDOWS}, {f"rel_vol_{w}": d.div(f"vol_{w}", f"cvol_{w}") for w in WINDOWS}]


def _drawdown(d):
    return [
        {"peak": f"CASE WHEN p IS NOT NULL THEN max(p) OVER {d.ts()} END", "cpeak": f"CASE WHEN cp IS NOT NULL THEN max(cp) OVER {d.ts()} END", "row_no": f"row_number() OVER (PARTITION BY inst ORDER BY dt)"},
        {"drawdown": d.div("p - peak", "peak"), "core_dd": d.div("cp - cpeak", "cpeak"), "top": "CASE WHEN p >= peak THEN row_no END"},
        {"rel_drawdown": "drawdown - core_dd", "drawdown_duration": f"row_no - coalesce({d.last('top')}, 0)"},
    ]


def drawdown(d):
    return [*_drawdown(d), {f"recovery_rate_{w}": d.div("drawdown - " + d.lag("drawdown", w), "drawdown_duration + 1") for w in WINDOWS}]


def sharpe(d):
    return [{f"sharpe_{w}": f"{d.div(d.mean('r', w), d.std('r', w))} * sqrt({YEAR})" for w in WINDOWS} | {f"info_ratio_{w}": f"{d.div(d.mean('a', w), d.std('a', w))} * sqrt({YEAR})" for w in WINDOWS}]


def downside(d):
    return [
        {"down": "CASE WHEN r IS NULL THEN NULL WHEN r < 0 THEN r * r ELSE 0.0e0 END"},
        {f"downside_dev_{w}": f"sqrt({d.mean('down', w)}) * sqrt({YEAR})" for w in WINDOWS} | {f"mean_{w}": f"({d.mean('r', w)}) * {YEAR}" for w in WINDOWS},
        {f"sortino_{w}": f"CASE WHEN downside_dev_{w} >= 1e-10 THEN {d.clip(d.div(f'mean_{w}', f'downside_dev_{w}'), -100.0, 100.0)} END" for w in WINDOWS},
    ]


def risk_adjusted(d):
    parts = {"gain": "CASE WHEN r IS NULL THEN NULL WHEN r > 0 THEN r ELSE 0.0e0 END", "loss": "CASE WHEN r IS NULL THEN NULL WHEN r < 0 THEN -r ELSE 0.0e0 END", "won": "CASE WHEN r > 0 THEN 1.0e0 ELSE 0.0e0 END", "win": "CASE WHEN r > 0 THEN r END", "lost": "CASE WHEN r < 0 THEN -r END"}
    mid = {}
    for w in WINDOWS:
        mid |= {f"bt_{w}": d.div(d.cov("r", "b", w), d.both("var_samp(b)", "r", "b", w)), f"mu_{w}": f"({d.mean('r', w)}) * {YEAR}", f"g_{w}": d.sum("gain", w), f"l_{w}": d.sum("loss", w), f"s_{w}": d.sum("r", w), f"win_rate_{w}": d.mean("won", w),
                f"aw_{w}": f"CASE WHEN count(r) OVER {d.ts(w)} = {w} THEN avg(win) OVER {d.ts(w)} END", f"al_{w}": f"avg(lost) OVER {d.ts(w)}"}
    out = {}
    for w in WINDOWS:
        out |= {f"treynor_{w}": d.clip(d.div(f"mu_{w}", f"abs(bt_{w}) + 0.1e0"), -100.0, 100.0), f"omega_{w}": d.clip(d.div(f"g_{w}", f"l_{w}"), 0.0, 100.0), f"gain_pain_{w}": d.clip(d.div(f"s_{w}", f"l_{w}"), -100.0, 100.0),
                f"payoff_{w}": d.clip(d.div(f"aw_{w}", f"al_{w}"), 0.0, 100.0), f"profit_factor_{w}": d.clip(d.div(f"g_{w}", f"l_{w}"), 0.0, 100.0)}
    return [parts, mid, out]


def beta_adjusted(d):
    return [*_rs(d), {f"bt_{w}": d.div(d.cov("r", "b", w), d.both("var_samp(b)", "r", "b", w)) for w in WINDOWS}, {f"beta_adj_rs_{w}_{n}": d.clip(d.div("rs_252", f"abs(bt_{w}) + {v}e0"), -100.0, 100.0) for w in WINDOWS for n, v in (("30", 0.3), ("50", 0.5), ("100", 1.0))}]


def tails(d):
    first = {f"v_{w}": d.rolled("r", w) for w in WINDOWS}
    second = {f"s_{w}": d.sorted(f"v_{w}") for w in WINDOWS}

    def quantile(w, q):
        """Linear between the neighbouring order statistics."""
        low = int((w - 1) * q)
        return f"({d.item(f's_{w}', low + 1)} + ({d.item(f's_{w}', low + 2)} - {d.item(f's_{w}', low + 1)}) * {(w - 1) * q - low!r}e0)"

    worst = {f"cvar_95_{w}": f"{d.total(d.head(f's_{w}', n := int((w - 1) * 0.05) + 1))} / {n}.0e0" for w in WINDOWS}
    return [first, second, worst | {f"tail_ratio_{w}": d.clip(d.div(f"abs({quantile(w, 0.95)})", f"abs({quantile(w, 0.05)})"), 0.0, 100.0) for w in WINDOWS}]


def path_risk(d):
    """Ulcer index, Calmar, recovery factor: folds over a window's returns with the state (wealth, peak, sum of squared drawdowns, worst)."""
    grown = f"({{1}} * (1 + x))"
    peak = f"greatest({{2}}, {grown})"
    fall = f"(({grown} - {peak}) / {peak})"
    # A float state of four fields: a[0..3] in Spark, a[1..4] in DuckDB.
    state = d.states("1", "1", "0", "0")
    step = d.states(grown, peak, f"{{3}} + {fall} * {fall}", f"least({{4}}, {fall})") if d.spark else f"[{grown}, {peak}, {{3}} + {fall} * {fall}, least({{4}}, {fall})]"
    ws = WINDOWS
    if d.spark:
        made = {f"f_{w}": d.fold(f"v_{w}", state, step) for w in ws}
    else:
        made = {f"f_{w}": f"list_reduce(list_transform(v_{w}, lambda y: [y]), lambda a, y: {step.replace('(1 + x)', '(1 + y[1])').replace('{1}', 'a[1]').replace('{2}', 'a[2]').replace('{3}', 'a[3]').replace('{4}', 'a[4]')}, {state})" for w in ws}
    out = {}
    for w in ws:
        f = lambda k, w=w: d.item(f"f_{w}", k)
        out |= {f"ulcer_index_{w}": f"sqrt({f(3)} / {w - 1})", f"calmar_{w}": d.clip(d.div(f"power({f(1)}, {YEAR / w!r}) - 1", f"abs({f(4)})"), -100.0, 100.0), f"recovery_factor_{w}": d.clip(f"abs(sr_{w}) / greatest(abs({f(4)}), 0.001e0)", 0.0, 100.0)}
    return [{f"v_{w}": d.rolled("r", w) for w in ws} | {f"sr_{w}": d.sum("r", w) for w in ws}, made, out, {f"ulcer_perf_{w}": d.clip(f"(sr_{w} / {w} * {YEAR}) / (ulcer_index_{w} + 0.01e0)", -100.0, 100.0) for w in ws}]


def capture(d):
    first, out = {}, {}
    for side, sign in (("up", ">"), ("down", "<")):
        first |= {f"{side}_g": f"CASE WHEN b {sign} 0 AND r > -1 THEN ln(1 + r) END", f"{side}_h": f"CASE WHEN b {sign} 0 AND r IS NOT NULL THEN ln(1 + b) END"}
        for w in WINDOWS:
            n = f"count({side}_h) OVER {d.ts(w)}"
            own, core = (f"exp(sum({side}_{c}) OVER {d.ts(w)} * {YEAR}.0e0 / NULLIF({n}, 0)) - 1" for c in "gh")
            out[f"{side}_capture_{w}"] = f"CASE WHEN {n} >= 5 AND abs({core}) >= 0.001e0 THEN {d.clip(d.div(own, core), -5.0, 5.0)} END"
    return [first, out, {f"capture_spread_{w}": f"up_capture_{w} - down_capture_{w}" for w in WINDOWS}]


def stability(d):
    """R squared of the cumulated log return on time: invariant to the window's own offset, so one cumulative sum serves all windows."""
    x = [{"lr": "CASE WHEN r IS NOT NULL THEN ln(1 + greatest(r, -0.99e0)) END", "row_no": "CAST(row_number() OVER (PARTITION BY inst ORDER BY dt) AS DOUBLE)"}, {"cum": f"CASE WHEN lr IS NOT NULL THEN sum(lr) OVER {d.ts()} END"}]
    return [*x, {f"stability_{w}": f"CASE WHEN count(lr) OVER {d.ts(w)} = {w} AND var_pop(cum) OVER {d.ts(w)} > 1e-10 THEN power(covar_pop(cum, row_no) OVER {d.ts(w)}, 2) / (var_pop(cum) OVER {d.ts(w)} * var_pop(row_no) OVER {d.ts(w)}) END" for w in WINDOWS}]


def moments(d):
    """Bias-corrected skewness and excess kurtosis from central moments about the window's mean."""
    ws = WINDOWS[:3]
    mean = {f"v_{w}": d.rolled("r", w) for w in ws} | {f"m_{w}": d.mean("r", w) for w in ws} | {f"q_{w}": d.stdp("r", w) for w in ws}
    cube = {}
    for w in ws:
        for k in (3, 4):
            power = "*".join(["(x - m)"] * k)
            cube[f"c{k}_{w}"] = f"{d.total(d.mapped(f'v_{w}', power.replace('m)', f'm_{w})')))} / {w}"
    out = {}
    for w in ws:
        out[f"skewness_{w}"] = f"CASE WHEN q_{w} > 1e-10 THEN c3_{w} / power(q_{w}, 3) * sqrt({w}.0e0 * {w - 1}) / {w - 2} END"
        out[f"kurtosis_{w}"] = f"CASE WHEN q_{w} > 1e-10 THEN {(w - 1) / ((w - 2) * (w - 3))!r} * ({w + 1} * (c4_{w} / power(q_{w}, 4) - 3) + 6) END"
    return [mean, cube, out]


def correlations(d):
    lags = {f"r{k}": d.lag("r", k) for k in (1, 5)}
    out = {f"corr_core_{w}": d.corr("r", "b", w) for w in WINDOWS} | {"market_corr": d.corr("r", "rx", 63)}
    for k in (1, 5):
        for w in WINDOWS:
            n = d.ts(w - k)
            sx, sy = f"stddev_pop(r) OVER {n}", f"stddev_pop(r{k}) OVER {n}"
            out[f"autocorr_lag{k}_{w}"] = f"CASE WHEN count(r) OVER {d.ts(w)} = {w} AND {sx} > 1e-10 AND {sy} > 1e-10 THEN covar_pop(r, r{k}) OVER {n} / NULLIF({sx} * {sy}, 0) END"
    return [lags, out, {"diversification": "-corr_core_63"}]


def hurst(d):
    lags, ws = (2, 5, 10, 20), (63, 126, 252)
    diff = {f"d{k}": f"r - {d.lag('r', k)}" for k in lags}
    out = {}
    for w in ws:
        for k in lags:
            out[f"h_{w}_{k}"] = f"CASE WHEN count(r) OVER {d.ts(w)} = {w} THEN {d.ln(f'stddev_pop(d{k}) OVER {d.ts(w - k)}')} END"
    import math

    xs = [math.log(k) for k in lags]
    mx = sum(xs) / len(xs)
    sxx = sum((x - mx) ** 2 for x in xs)
    return [diff, out, {f"hurst_{w}": " + ".join(f"h_{w}_{k} * ({(x - mx) / sxx!r})" for k, x in zip(lags, xs, strict=True)) for w in ws}]


def entropy(d):
    """Ten equal bins over the window's range, on density; a constant window has width 1."""
    ws = (63, 126)
    first = {f"v_{w}": d.rolled("r", w) for w in ws} | {f"lo_{w}": d.min("r", w) for w in ws} | {f"hi_{w}": d.max("r", w) for w in ws}
    out = {}
    for w in ws:
        width = f"(CASE WHEN hi_{w} > lo_{w} THEN (hi_{w} - lo_{w}) ELSE 1.0e0 END / 10)"
        low = f"(CASE WHEN hi_{w} > lo_{w} THEN lo_{w} ELSE lo_{w} - 0.5e0 END)"
        terms = []
        for k in range(10):
            inside = f"least(floor((x - {low}) / {width}), 9) = {k}"
            n = d.total(d.mapped(f"v_{w}", f"CASE WHEN {inside} THEN 1.0e0 ELSE 0.0e0 END"))
            density = f"({n} / {w} / {width})"
            terms.append(f"CASE WHEN {density} > 0 THEN -{density} * ln({density}) ELSE 0.0e0 END")
        out[f"entropy_{w}"] = f"CASE WHEN v_{w} IS NOT NULL THEN {' + '.join(terms)} END"
    return [first, out]


def trend(d):
    ma = {f"ma_{k}": d.mean("p", k) for k in (20, 50, 100, 200)}
    out = {f"price_vs_ma{k}": f"{d.div('p', f'ma_{k}')} - 1" for k in (20, 50, 100, 200)} | {f"dist_ma_{k}d": d.div(f"-(p - ma_{k})", f"ma_{k}") for k in (20, 50, 100, 200)}
    return [ma, out | {"ma_cross_20_50": f"{d.div('ma_20', 'ma_50')} - 1", "ma_cross_50_200": f"{d.div('ma_50', 'ma_200')} - 1"}]


def zscores(d):
    first = {"ratio": d.div("p", "cp"), "a252": d.std("a", 252)} | {f"price_zscore_{w}": d.div(f"-(p - {d.mean('p', w)})", d.std("p", w)) for w in WINDOWS}
    second = {f"alpha_zscore_{w}": d.div(f"-({d.sum('a', w)})", f"a252 * sqrt({w})") for w in WINDOWS} | {f"rs_zscore_{w}": d.div(f"-(rs_{w} - {d.mean(f'rs_{w}', 63)})", d.std(f"rs_{w}", 63)) for w in WINDOWS}
    return [*_rs(d), first, second | {"ratio_zscore": d.div(f"-(ratio - {d.mean('ratio', 63)})", d.std("ratio", 63))}]


def bands(d):
    first = {"m20": d.mean("p", 20), "s20": d.stdp("p", 20), "lo": d.min("p", 20), "hi": d.max("p", 20), "v20": d.rolled("p", 20)}
    second = {"mad": f"{d.total(d.mapped('v20', 'abs(x - m20)'))} / 20", "bb_reversion": f"1 - {d.div('p - (m20 - 2 * s20)', '4 * s20')}", "donchian_pos": d.clip(d.div("p - lo", "hi - lo"), 0.0, 1.0)}
    return [first, second, {"cci": "CASE WHEN mad > 1e-9 THEN (p - m20) / (0.015e0 * mad) / 100 END", "donchian_reversion": "1 - donchian_pos"}, {"cci_reversion": "-cci"}]


def oscillators(d):
    first = {"lo": d.min("p", 14), "hi": d.max("p", 14), "row_no": "CAST(row_number() OVER (PARTITION BY inst ORDER BY dt) AS DOUBLE)", "bp": "CASE WHEN p IS NOT NULL AND pl IS NOT NULL THEN p - least(p, pl) END", "tr": "CASE WHEN p IS NOT NULL AND pl IS NOT NULL THEN greatest(p, pl) - least(p, pl) END"}
    roc = {f"roc{n}": _ret(d, "p", n) for n in (10, 15, 20, 30)}
    second = {"k14": f"100 * {d.div('p - lo', 'hi - lo')}", "williams_r": f"-100 * {d.div('hi - p', 'hi - lo')}", "top": d.full(f"max({d.pair('p', 'row_no')})", "p", 26), "bottom": d.full(f"min({d.pair('p', '-row_no')})", "p", 26)}
    second |= {f"u{n}": d.div(d.sum("bp", n), d.sum("tr", n)) for n in (7, 14, 28)} | {f"k{n}_{m}": d.mean(f"roc{n}", m) for n, m in ((10, 10), (15, 10), (20, 10), (30, 15))}
    third = {"stochastic": "(k14 - 50) / 50", "stoch_reversion": "50 - k14", "williams_r_reversion": "williams_r + 50", "aroon_up": "100 * (25 - (row_no - top.y)) / 25", "aroon_down": "100 * (25 - (row_no + bottom.y)) / 25", "ultimate_osc": "100 * (4 * u7 + 2 * u14 + u28) / 7", "kst": "100 * (k10_10 + 2 * k15_10 + 3 * k20_10 + 4 * k30_15)"}
    return [first | roc, second, third, {"aroon_osc": "aroon_up - aroon_down", "ultimate_osc_reversion": "50 - ultimate_osc", "kst_signal": d.mean("kst", 9)}]


def reversion(d):
    first = {f"ca_{w}": d.sum("a", w) for w in WINDOWS}
    return [*_drawdown(d), first | {"dd_reversion": "-drawdown"}, {f"alpha_dd_reversion_{w}": f"CASE WHEN ca_{w} IS NOT NULL THEN max(ca_{w}) OVER {d.ts()} - ca_{w} END" for w in WINDOWS}]


def crowding(d):
    share = f"avg(CASE WHEN m63 > 0 THEN 1.0e0 ELSE 0.0e0 END) OVER {d.XS}"
    return [*_rs(d), {"up_share": share, "return_dispersion_63d": f"stddev_samp(r) OVER {d.XS}", "dispersion_regime": f"{d.quantile('r', 0.8, d.XS)} - {d.quantile('r', 0.2, d.XS)}"}, {"crowding": "abs(up_share - 0.5e0) * 2", "herding_direction": "CASE WHEN up_share > 0.5 THEN 1.0e0 ELSE -1.0e0 END"}]


def regimes(d):
    first = {"cv": d.std("b", 63), "cma": d.mean("cp", 200), "cpk": f"max(cp) OVER {d.ts()}", "ma50": f"{d.div('p', d.mean('p', 50))} - 1"}
    second = {"vol_regime": d.div(f"cv - {d.mean('cv', 252)}", d.std("cv", 252)), "trend_regime": f"{d.div('cp', 'cma')} - 1", "drawdown_regime": d.div("cp - cpk", "cpk"), "z_ma": d.div(f"ma50 - {d.mean('ma50', 63)}", d.std("ma50", 63)), "z_rs": d.div(f"rs_63 - {d.mean('rs_63', 63)}", d.std("rs_63", 63)), "pz": d.div(f"-(p - {d.mean('p', 63)})", d.std("p", 63))}
    return [*_rs(d), first, second, {"trend_momentum_divergence": "z_ma - z_rs", "trend_boosted_momentum": f"m63 * (1 + {d.clip('trend_regime', -1.0, 1.0)})", "vol_boosted_reversion": f"pz * (1 + {d.clip('vol_regime', -1.0, 1.0)})"}]


def seasonality(d):
    turn = "2 * pi() * month(dt) / 12"
    return [{"month_favorable": "CASE WHEN month(dt) IN (1, 4, 11, 12) THEN 1.0e0 ELSE 0.0e0 END", "month_sin": f"sin({turn})", "month_cos": f"cos({turn})"} | {f"month_{m}": f"CASE WHEN month(dt) = {m} THEN 1.0e0 ELSE 0.0e0 END" for m in range(1, 13)}]


def dpo(d, mode: str = "lead", period: int = 20):
    """Detrended price: the price period // 2 + 1 rows on (``lead``, as usually charted, reads later prices) or back (``lag``, causal), less the moving average."""
    k = period // 2 + 1
    return [{f"dpo_{mode}_{period}": f"{(d.lead if mode == 'lead' else d.lag)('p', k)} - {d.mean('p', period)}"}]


def dpos(d):
    return [{n: x for p in (20, 50, 60, 70) for n, x in dpo(d, "lead", p)[0].items()}, {n: x for p in (20, 50, 60, 70) for n, x in dpo(d, "lag", p)[0].items()}]


#: Query name to (program, prefixes of the columns that it makes but doesn't return).
FAMILIES = {
    "returns_ratios": (returns, ()),
    "cumulative_returns": (cumulative, ()),
    "momentum": (momentum, ()),
    "relative_strength": (relative_strength, ("m2", "m6", "m1", "c2", "c6", "c1")),
    "proximity_52w": (proximity, ()),
    "beta_idio": (beta, ()),
    "vol_relvol": (volatility, ("cvol",)),
    "drawdown_family": (drawdown, ("peak", "cpeak", "row_no", "core_dd", "top")),
    "sharpe_info_ratio": (sharpe, ()),
    "sortino_downside": (downside, ("down#", "mean_")),
    "treynor_omega_payoff": (risk_adjusted, ("gain#", "loss", "won", "win#", "lost", "bt_", "mu_", "g_", "l_", "s_", "aw_", "al_")),
    "beta_adjusted_rs": (beta_adjusted, ("m", "c", "rs", "bt_")),
    "cvar_tail_ratio": (tails, ("v_", "s_")),
    "ulcer_calmar_recovery": (path_risk, ("v_", "sr_", "f_")),
    "capture_ratios": (capture, ("up_g", "up_h", "down_g", "down_h")),
    "stability_r2": (stability, ("lr", "row_no", "cum")),
    "skew_kurt": (moments, ("v_", "m_", "q_", "c3", "c4")),
    "corr_autocorr": (correlations, ("r1", "r5")),
    "hurst": (hurst, ("d2", "d5", "d10", "d20", "h_")),
    "entropy": (entropy, ("v_", "lo_", "hi_")),
    "trend_ma": (trend, ("ma_2#", "ma_20#", "ma_50#", "ma_100#", "ma_200#")),
    "price_zscores": (zscores, ("m2", "m6", "m1", "c", "rs_21", "rs_63", "rs_126", "rs_252", "rsu", "ratio#", "a252")),
    "bands_cci": (bands, ("m20", "s20", "lo", "hi", "v20", "mad")),
    "stoch_aroon_uo_kst": (oscillators, ("lo", "hi", "row_no", "bp", "tr", "roc", "k14", "top", "bottom", "u7", "u14", "u28", "k10", "k15", "k20", "k30")),
    "alpha_dd_reversion": (reversion, ("peak", "cpeak", "row_no", "core_dd", "top", "rel_", "drawdown", "ca_")),
    "crowding_dispersion": (crowding, ("m", "c1", "c2", "c6", "rs", "up_share")),
    "regimes": (regimes, ("m", "c", "rs", "z_", "pz")),
    "seasonality": (seasonality, ()),
    "dpo_compat_and_causal": (dpos, ()),
}


def names(program, hidden: tuple[str, ...], d: Dialect) -> list[str]:
    """What a family returns: the columns of its stages without the hidden ones (a trailing # hides that very name)."""
    made = [n for s in program(d) for n in s]
    exact, starts = {h[:-1] for h in hidden if h.endswith("#")}, tuple(h for h in hidden if not h.endswith("#"))
    return [n for n in dict.fromkeys(made) if n not in exact and not (starts and n.startswith(starts))]
