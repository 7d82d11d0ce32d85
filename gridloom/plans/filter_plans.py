"""Queries of the filters and the cross-sectional indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.program import apply, finish, text
from gridloom.functions.sql import DUCK, SPARK
from gridloom.operators import filters, indicators, signals
from gridloom.registry import QUERIES, SQL
from gridloom.sources import panels

KEYS = ("inst", "dt")
#: Prices and medians of an odd number of prices: no arithmetic that could differ.
EXACT = ("x_raw", "median_5", "median_21")


def _family(name):
    program, hidden = filters.FAMILIES[name]
    shown = signals.names(program, hidden, SPARK)
    QUERIES[name] = lambda spark, sf_dir: finish(apply(panels.panel(spark, sf_dir, "regional", True), program(SPARK)), KEYS, shown, 4, EXACT)
    SQL[name] = text(panels.ctes("regional", True), program(DUCK), KEYS, signals.names(program, hidden, DUCK), 4, EXACT)


for _n in filters.FAMILIES:
    _family(_n)


def xs_indicators_25(spark, sf_dir):
    return finish(apply(panels.panel(spark, sf_dir, "monthly"), indicators.stages(SPARK)), KEYS, indicators.NAMES, 4, EXACT)


QUERIES["xs_indicators_25"] = xs_indicators_25
SQL["xs_indicators_25"] = text(panels.ctes("monthly"), indicators.stages(DUCK), KEYS, indicators.NAMES, 4, EXACT)


def _recursive(name, chosen, digits=6):
    def run(spark, sf_dir):
        out = filters.recursive(panels.panel(spark, sf_dir, "regional"), chosen)
        return out.select("inst", "dt", *[c if c == "raw" else F.round(c, digits).alias(c) for c in chosen])

    QUERIES[name] = run


_recursive("ema_dema_tema_zlema", ["ema_21d", "dema_21d", "tema_21d", "zlema_21d", "ema_63d", "dema_63d", "tema_63d", "zlema_63d", "adaptive_ema"])
_recursive("kalman_butterworth", ["kalman_fast", "kalman_slow", "kalman_full", "butter_21d", "butter_63d"], 4)
_recursive("kama_regime", ["kama_21d", "regime_10_50", "raw"], 4)
_recursive("registry_finite", ["hull_21d", "hull_63d", "trima_21d", "trima_63d", "gauss_21d", "gauss_63d", "median_21d", "median_63d", "savgol_21d", "savgol_63d", "sma_21d", "sma_63d"])

#: EMA(21) over the filled panel by a recursive query, row by row.
_EMA = "r0 AS (SELECT inst, dt, p, row_number() OVER (PARTITION BY inst ORDER BY dt) AS i FROM panel WHERE p IS NOT NULL), walk AS (SELECT inst, dt, i, p AS e FROM r0 WHERE i = 1 UNION ALL SELECT r0.inst, r0.dt, r0.i, walk.e + (2.0e0 / 22) * (r0.p - walk.e) FROM walk JOIN r0 ON r0.inst = walk.inst AND r0.i = walk.i + 1)"


def ema_recursive(spark, sf_dir):
    out = filters.recursive(panels.panel(spark, sf_dir, "regional", True).where("p IS NOT NULL"), ["ema_21d"])
    return out.select("inst", "dt", F.round("ema_21d", 6).alias("ema_21d"))


QUERIES["ema_recursive"] = ema_recursive
SQL["ema_recursive"] = f"WITH RECURSIVE {panels.ctes('regional', True)}, {_EMA} SELECT inst, dt, round(e, 6) + 0.0e0 AS ema_21d FROM walk"

_BACK = "OVER (PARTITION BY inst ORDER BY dt)"
#: The prices that are there, with the one before.
_PRICES = f"rows0 AS (SELECT inst, dt, p, lag(p) {_BACK} AS b, row_number() {_BACK} AS i FROM panel WHERE p IS NOT NULL)"
#: All dates: the price p, the filled price f, and the prices 10 and 31 rows back.
_DATES = (
    "rows0 AS (SELECT inst, dt, p, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY inst ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(p IGNORE NULLS) OVER (PARTITION BY inst ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f, "
    f"lag(p, 10) {_BACK} AS z21, lag(p, 31) {_BACK} AS z63, row_number() {_BACK} AS i FROM panel)"
)


def _walked(states: dict[str, tuple[str, str]], columns: dict[str, str], digits: int = 4, rows: str = _PRICES, filled: bool = True) -> str:
    """A recursive query over each instrument's rows, one by one. states: name to (value at row 1, value at a later row from w (the row before) and r (this row)); columns: over the states, p and i."""
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, (x, _) in states.items())
    later = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, (_, x) in states.items())
    walk = f"walk AS (SELECT inst, dt, i, p, {first} FROM rows0 r WHERE i = 1 UNION ALL SELECT r.inst, r.dt, r.i, r.p, {later} FROM walk w JOIN rows0 r ON r.inst = w.inst AND r.i = w.i + 1)"
    return f"WITH RECURSIVE {panels.ctes('regional', filled)}, {rows}, {walk} SELECT inst, dt, {', '.join(f'{x} AS {n}' if x == 'p' else f'round({x}, {digits}) + 0.0e0 AS {n}' for n, x in columns.items())} FROM walk"


def _step(n: str, x: str, a: str) -> str:
    return f"w.{n} + {a} * ({x} - w.{n})"


def _macd_sql() -> str:
    """By definition: averages y + a (x - y), and sums of q^k x over sums of q^k."""
    states, columns = {}, {}
    spans = sorted({s for p in filters.PAIRS for s in p})
    for s in spans:
        a, q = f"(2.0e0 / {s + 1})", f"(1 - 2.0e0 / {s + 1})"
        states |= {f"e{s}": ("p", _step(f"e{s}", "r.p", a)), f"n{s}": ("p", f"w.n{s} * {q} + r.p"), f"d{s}": ("1", f"w.d{s} * {q} + 1")}
    for f, s in filters.PAIRS:
        line = f"({states[f'e{f}'][1]} - ({states[f'e{s}'][1]}))"
        fast, slow = (f"(({states[f'n{k}'][1]}) / ({states[f'd{k}'][1]}))" for k in (f, s))
        ppo = f"(100 * ({fast} - {slow}) / {slow})"
        q = "(1 - 2.0e0 / 10)"
        states |= {f"g{f}_{s}": ("NULL", f"CASE WHEN r.i < {s} THEN NULL WHEN r.i = {s} THEN {line} ELSE {_step(f'g{f}_{s}', line, '0.2e0')} END"), f"pn{f}_{s}": ("0", f"w.pn{f}_{s} * {q} + {ppo}"), f"pd{f}_{s}": ("1", f"w.pd{f}_{s} * {q} + 1")}
        line, signal = f"CASE WHEN i >= {s} THEN e{f} - e{s} END", f"CASE WHEN i >= {s + 8} THEN g{f}_{s} END"
        fast, slow = f"(n{f} / d{f})", f"(n{s} / d{s})"
        ppo, after = f"(100 * ({fast} - {slow}) / {slow})", f"(pn{f}_{s} / pd{f}_{s})"
        columns |= {f"macd_line_{f}_{s}": line, f"macd_signal_{f}_{s}": signal, f"macd_hist_{f}_{s}": f"({line}) - ({signal})", f"ppo_{f}_{s}": ppo, f"ppo_signal_{f}_{s}": after, f"ppo_hist_{f}_{s}": f"{ppo} - {after}", f"apo_{f}_{s}": f"{fast} - {slow}"}
    return _walked(states, columns | {"macd_normalized": f"100 * ({columns['macd_line_12_26']}) / p"})


def _oscillator_sql() -> str:
    up, down, move, size = "greatest(r.p - r.b, 0)", "greatest(r.b - r.p, 0)", "(r.p - r.b)", "abs(r.p - r.b)"
    states = {"gain": ("0", _step("gain", up, "(1.0e0 / 14)")), "loss": ("0", _step("loss", down, "(1.0e0 / 14)"))}
    for n, x in (("m", move), ("z", size)):
        states[f"{n}1"] = ("NULL", f"CASE WHEN r.i = 2 THEN {x} ELSE {_step(f'{n}1', x, '(2.0e0 / 26)')} END")
        one = f"({states[f'{n}1'][1]})"
        states[f"{n}2"] = ("NULL", f"CASE WHEN r.i < 26 THEN NULL WHEN r.i = 26 THEN {one} ELSE {_step(f'{n}2', one, '(2.0e0 / 14)')} END")
    tsi = f"(100 * ({states['m2'][1]}) / ({states['z2'][1]}))"
    states |= {"sn": ("0", f"CASE WHEN r.i < 38 THEN 0 ELSE w.sn * 0.75e0 + {tsi} END"), "sd": ("0", "CASE WHEN r.i < 38 THEN 0 ELSE w.sd * 0.75e0 + 1 END")}
    q = "(1 - 2.0e0 / 16)"
    x = "r.p"
    for k in (1, 2, 3):
        states |= {f"tn{k}": ("p", f"w.tn{k} * {q} + {x}"), f"td{k}": ("1", f"w.td{k} * {q} + 1")}
        x = f"(({states[f'tn{k}'][1]}) / ({states[f'td{k}'][1]}))"
    trix = f"(100 * ({x} / (w.tn3 / w.td3) - 1))"
    states |= {"t": ("NULL", trix), "xn": ("0", f"w.xn * 0.8e0 + {trix}"), "xd": ("0", "w.xd * 0.8e0 + 1")}
    rsi = "CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END"
    columns = {"rsi_14": f"CASE WHEN i >= 14 THEN {rsi} END", "rsi_reversion": f"CASE WHEN i >= 14 THEN 50 - ({rsi}) END", "tsi": "CASE WHEN i >= 38 THEN 100 * m2 / z2 END", "tsi_signal": "CASE WHEN i >= 38 THEN sn / sd END", "trix": "t", "trix_signal": "xn / nullif(xd, 0)"}
    return _walked(states, columns)


def _oscillators(name, family, sql):
    def run(spark, sf_dir):
        out = filters.oscillators(panels.panel(spark, sf_dir, "regional", True).where("p IS NOT NULL"), family)
        return out.selectExpr("inst", "dt", *[f"{SPARK.out(c, 4)} AS {c}" for c in out.columns[2:]])

    QUERIES[name], SQL[name] = run, sql


_oscillators("macd_ppo_apo", filters.macd_family, _macd_sql())
_oscillators("rsi_tsi_trix", filters.oscillator_family, _oscillator_sql())


def _chained(states: dict, s: int, x: str, first: str, depth: int) -> None:
    """Adds averages e{s}_1 to e{s}_depth, each of the one before, which stands still (h) where there is no price."""
    for k in range(1, depth + 1):
        states[f"e{s}_{k}"] = (first, _step(f"e{s}_{k}", x, f"(2.0e0 / {s + 1})"))
        states[f"h{s}_{k}"] = (first, f"CASE WHEN r.p IS NULL THEN w.h{s}_{k} ELSE {states[f'e{s}_{k}'][1]} END")
        x = f"({states[f'h{s}_{k}'][1]})"


def _there(x: str) -> str:
    return f"CASE WHEN p IS NOT NULL THEN {x} END"


def _averages_sql() -> str:
    states, columns = {}, {}
    for s in (21, 63):
        _chained(states, s, "r.f", "f", 3)
        states[f"v{s}"] = ("f", f"coalesce(CASE WHEN r.z{s} IS NULL THEN r.p ELSE 2 * r.p - r.z{s} END, w.v{s})")
        states[f"z{s}"] = ("f", _step(f"z{s}", f"({states[f'v{s}'][1]})", f"(2.0e0 / {s + 1})"))
        columns |= {f"ema_{s}d": _there(f"e{s}_1"), f"dema_{s}d": _there(f"2 * e{s}_1 - e{s}_2"), f"tema_{s}d": _there(f"3 * e{s}_1 - 3 * e{s}_2 + e{s}_3"), f"zlema_{s}d": _there(f"z{s}")}
    return _walked(states, columns | {"adaptive_ema": _there("e63_1")}, 6, _DATES, False)


def _low_pass_sql() -> str:
    """Kalman averages from their update equations, the low pass from its transfer function 1 / (s^2 + sqrt(2) s + 1) with s = c (1 - z) / (1 + z), c = cot(pi / (2 cutoff))."""
    states, columns = {}, {}
    for n, q, r in (("fast", "1e-4", "1e-2"), ("slow", "1e-5", "1e-2")):
        p = f"((sqrt({q} * {q} + 4 * {q} * {r}) + {q}) / 2)"
        gain = f"({p} / ({p} + {r}))"
        states[n] = (f"{gain} * f", _step(n, "r.f", gain))
        columns[f"kalman_{n}"] = _there(n)
    ahead = "(w.err + 1e-2)"
    gain = f"({ahead} / ({ahead} + 1e0))"
    states["level"] = ("p", f"CASE WHEN r.p IS NULL THEN w.level WHEN w.level IS NULL THEN r.p ELSE w.level + {gain} * (r.p - w.level) END")
    states["err"] = ("CASE WHEN p IS NULL THEN 1.01e0 ELSE (1 - 1.01e0 / 2.01e0) * 1.01e0 END", f"CASE WHEN r.p IS NULL THEN {ahead} ELSE (1 - {gain}) * {ahead} END")
    columns["kalman_full"] = "level"
    states |= {"xa": ("f", "r.f"), "xb": ("0", "w.xa")}
    for s in (21, 63):
        c = f"(1 / tan(pi() / (2 * {s})))"
        n = f"(1 + sqrt(2.0e0) * {c} + {c} * {c})"
        states[f"y{s}"] = (f"f / {n}", f"(r.f + 2 * w.xa + w.xb - 2 * (1 - {c} * {c}) * w.y{s} - (1 - sqrt(2.0e0) * {c} + {c} * {c}) * w.o{s}) / {n}")
        states[f"o{s}"] = ("0", f"w.y{s}")
        columns[f"butter_{s}d"] = f"CASE WHEN i > {s} AND p IS NOT NULL THEN y{s} END"
    return _walked(states, columns, 4, _DATES, False)


def _adaptive_sql() -> str:
    near = ", ".join(f"lag(p, {k}) {_BACK}" for k in range(21, 31))
    last = "(PARTITION BY inst ORDER BY dt ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    moved = f"moved AS (SELECT *, abs(p - lag(p) {_BACK}) AS d, coalesce({near}) AS past, count(p) OVER {last.format('UNBOUNDED')} AS c FROM dates)"
    rows = f"{_DATES.replace('rows0 AS', 'dates AS')}, {moved}, rows0 AS (SELECT *, coalesce(sum(d) OVER {last.format(20)}, 0) AS total, CASE WHEN i > 84 AND c = i THEN stddev_pop(d) OVER {last.format(20)} / (stddev_pop(d) OVER {last.format(83)} + 1e-10) END AS heat FROM moved)"
    share = "(CASE WHEN r.total > 1e-10 THEN least(abs(r.p - r.past) / r.total, 1e0) ELSE 0e0 END * (2e0 / 3 - 2e0 / 31) + 2e0 / 31)"
    states = {"k": ("NULL", f"CASE WHEN r.p IS NULL OR (r.c > 21 AND r.past IS NULL) THEN w.k WHEN r.c < 21 THEN NULL WHEN r.c = 21 THEN r.p ELSE w.k + {share} * {share} * (r.p - w.k) END")}
    states |= {f"e{s}": ("f", _step(f"e{s}", "r.f", f"(2.0e0 / {s + 1})")) for s in (10, 50)}
    return _walked(states | {"heat": ("NULL", "r.heat")}, {"kama_21d": _there("k"), "regime_10_50": _there("CASE WHEN heat > 1 THEN e10 ELSE e50 END"), "raw": "p"}, 4, rows, False)


SQL["kama_regime"] = _adaptive_sql()
SQL["ema_dema_tema_zlema"] = _averages_sql()
SQL["kalman_butterworth"] = _low_pass_sql()

_GRID = filters.dpo_grid()
#: The filtered grid's query: 9 of the 506 names, since all with 21 windows are 11 thousand signals a price.
_SMALL = filters.dpo_grid(range(10, 31, 10), (1.0, 1.2, 2.0))


def _dpo(mode, grid=_GRID, savgol=()):
    def run(spark, sf_dir):
        out = filters.dpo_tema(panels.panel(spark, sf_dir, "regional", True), grid, mode, savgol)
        return out.selectExpr("inst", "dt", "signal", f"{SPARK.out('value', 4)} AS value")

    return run


def _dpo_sql(forward: bool) -> str:
    """Triple averages of all periods by a recursive query, and the price of the row that the shift names."""
    names = ", ".join(f"('{n}', {p}, {k})" for n, (p, k) in _GRID.items())
    e1, e2, e3 = "w.e1 + w.a * (r.f - w.e1)", "w.e2 + w.a * ({} - w.e2)", "w.e3 + w.a * ({} - w.e3)"
    e2 = e2.format(f"({e1})")
    e3 = e3.format(f"({e2})")
    walk = f"walk AS (SELECT inst, dt, i, p, period, 2.0e0 / (period + 1) AS a, f AS e1, f AS e2, f AS e3 FROM rows0 r, (SELECT DISTINCT period FROM names) WHERE i = 1 UNION ALL SELECT r.inst, r.dt, r.i, r.p, w.period, w.a, {e1}, {e2}, {e3} FROM walk w JOIN rows0 r ON r.inst = w.inst AND r.i = w.i + 1)"
    value = DUCK.out("CASE WHEN walk.p IS NOT NULL THEN o.p - (3 * e1 - 3 * e2 + e3) END", 4)
    return f"WITH RECURSIVE {panels.ctes('regional', True)}, {_DATES}, names(signal, period, shift) AS (VALUES {names}), {walk} SELECT walk.inst, walk.dt, signal, {value} AS value FROM walk JOIN names USING (period) LEFT JOIN rows0 o ON o.inst = walk.inst AND o.i = walk.i {'+' if forward else '-'} shift"


QUERIES["dpo_grid_compat"], SQL["dpo_grid_compat"] = _dpo("lead"), _dpo_sql(True)
QUERIES["dpo_grid_causal"], SQL["dpo_grid_causal"] = _dpo("lag"), _dpo_sql(False)
QUERIES["dpo_savgol_grid"] = _dpo("lead", _SMALL, (50, 51))
