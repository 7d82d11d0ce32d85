"""Panel operators against plain loops, and every query with SQL against DuckDB on the small tables."""

import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from gridloom import registry
from gridloom.functions.program import apply
from gridloom.functions.sql import SPARK
from gridloom.operators import ensemble, filters, indicators, portfolio, relational, signals, strategy
from gridloom.sources import panels, store

SF = "/root/testdata/sf0.001"
#: A query of each kind for the quick check; the driver runs all.
QUICK = ("min_slice_momentum_top3", "sig_returns_ratios", "sig_drawdown_family", "sig_capture_ratios", "sig_stoch_aroon_uo_kst", "fir_filters", "forward_targets", "walk_forward", "macd_ppo_apo", "rsi_tsi_trix", "xs_indicators_25", "asof_backward_weights", "asof_weights_or_first", "feature_gate_corr", "upsert_coalesce", "dq_gap_stale", "portfolio_metrics", "ffill_bfill", "replace_facts", "ema_dema_tema_zlema", "kalman_butterworth", "kama_regime", "ensemble_size_stats", "ensemble_size_order", "best_by_criterion")


def same(a, b):
    """Equal, or within a unit of the last digit that queries round to."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-4)
    return str(a) == str(b)


def place(row):
    return [(v is None, "" if isinstance(v, float) else str(v)) for v in row], [v for v in row if isinstance(v, float)]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in panels.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in cols]
    a = sorted((list(r) for r in got.select(*cols).collect()), key=place)
    b = sorted(([r[i] for i in order] for r in want.fetchall()), key=place)
    assert len(a) == len(b)
    assert all(same(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2020-01-01", periods=140).date
    frames = []
    for i in range(3):
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days))))
        if i == 2:
            p[[0, 1, 50, 139]] = np.nan
        frames.append(pd.DataFrame({"inst": i, "dt": days, "p": p}))
    pdf = pd.concat(frames)
    pdf["core"] = 0
    pdf["cp"] = pdf["dt"].map(frames[0].set_index("dt")["p"])
    return pdf, spark.createDataFrame(pdf.astype({"p": object, "cp": object}).where(pdf.notna(), None), "inst long, dt date, p double, core long, cp double")


def run(df, program, names):
    out = apply(df, [*signals.base(SPARK), *program(SPARK)]).select("inst", "dt", *names).toPandas()
    return out.sort_values(["inst", "dt"])


def test_kernels_against_pandas(walk):
    pdf, df = walk
    one = run(df, signals.sharpe, ["sharpe_21"])
    two = run(df, signals.beta, ["beta_21"])
    three = run(df, signals.moments, ["skewness_21", "kurtosis_21"])
    four = run(df, signals.tails, ["cvar_95_63", "tail_ratio_21"])
    core = pdf[pdf.inst == 0].p.pct_change(fill_method=None).to_numpy()
    for i, g in pdf.groupby("inst"):
        r = g.p.pct_change(fill_method=None).reset_index(drop=True)
        b = pd.Series(core)
        pick = lambda o, c, i=i: o[o.inst == i][c].to_numpy(dtype=float)
        assert np.allclose(pick(one, "sharpe_21"), r.rolling(21).mean() / r.rolling(21).std() * math.sqrt(252), equal_nan=True)
        if i != 2:
            assert np.allclose(pick(two, "beta_21"), r.rolling(21).cov(b) / b.rolling(21).var(), equal_nan=True)
        assert np.allclose(pick(three, "skewness_21"), r.rolling(21).skew(), equal_nan=True, atol=1e-8)
        assert np.allclose(pick(three, "kurtosis_21"), r.rolling(21).kurt(), equal_nan=True, atol=1e-7)
        assert np.allclose(pick(four, "cvar_95_63"), r.rolling(63).apply(lambda w: np.sort(w)[:4].mean()), equal_nan=True)


def test_path_risk_against_a_loop(walk):
    pdf, df = walk
    got = run(df, signals.path_risk, ["ulcer_index_21", "calmar_21", "recovery_factor_21"])
    r = pdf[pdf.inst == 1].p.pct_change(fill_method=None).to_numpy()
    mine = got[got.inst == 1].reset_index(drop=True)
    for t in range(21, 140, 17):
        wealth = peak = 1.0
        ss = worst = 0.0
        for x in r[t - 20 : t + 1]:
            wealth *= 1 + x
            peak = max(peak, wealth)
            fall = (wealth - peak) / peak
            ss, worst = ss + fall * fall, min(worst, fall)
        assert math.isclose(mine["ulcer_index_21"][t], math.sqrt(ss / 20), rel_tol=1e-9)
        assert math.isclose(mine["recovery_factor_21"][t], min(100, abs(r[t - 20 : t + 1].sum()) / max(abs(worst), 0.001)), rel_tol=1e-9)


def test_causal_signals_ignore_the_future(walk, spark):
    pdf, df = walk
    cut = pdf.dt.sort_values().iloc[300]
    short = df.where(df.dt <= cut)
    name = ["dpo_lag_20"]
    a, b = run(df, signals.dpos, name), run(short, signals.dpos, name)
    assert np.allclose(a[a.dt <= cut][name].to_numpy(dtype=float), b[name].to_numpy(dtype=float), equal_nan=True)
    a, b = run(df, signals.dpos, ["dpo_lead_20"]), run(short, signals.dpos, ["dpo_lead_20"])
    assert a[a.dt <= cut]["dpo_lead_20"].notna().sum() > b["dpo_lead_20"].notna().sum()


def test_recursive_filters():
    x = np.array([1.0, 2.0, np.nan, 4.0, 3.0, 5.0])
    assert np.allclose(filters.ewm(x, 3), pd.Series(x).ewm(span=3).mean())
    full = np.arange(1.0, 41.0)
    assert np.allclose(filters.ema(full, 5), pd.Series(full).ewm(span=5, adjust=False).mean())
    assert np.isnan(filters.ema(x, 3)[2]) and np.isnan(filters.tema(x, 3)[2])
    e = filters.ema(full, 5)
    assert np.allclose(filters.dema(full, 5), 2 * e - filters.ema(e, 5))
    const = np.full(400, 7.0)
    assert np.allclose(filters.butterworth(const, 21)[-50:], 7, atol=1e-6) and np.isnan(filters.butterworth(const, 21)[:21]).all()
    assert np.allclose(filters.kalman(const), 7) and np.allclose(filters.kama(const)[20:], 7) and np.isnan(filters.kama(const)[:20]).all()
    assert np.allclose(filters.kalman_steady(const, 0.1)[-20:], 7, atol=1e-3)
    assert filters.get("kalman_fast")[1] == {"q": 1e-4, "r": 1e-2} and filters.get("kalman_slow")[1] == {"q": 1e-5, "r": 1e-2}


def test_oscillators_against_pandas():
    x = pd.Series(100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.02, 300))))
    got = filters.macd_family(x.to_numpy())
    line = x.ewm(span=12, adjust=False, min_periods=12).mean() - x.ewm(span=26, adjust=False, min_periods=26).mean()
    assert np.allclose(got["macd_line_12_26"], line, equal_nan=True) and np.allclose(got["macd_signal_12_26"], line.ewm(span=9, adjust=False, min_periods=9).mean(), equal_nan=True)
    assert np.allclose(got["apo_20_50"], x.ewm(span=20).mean() - x.ewm(span=50).mean())
    ppo = 100 * (x.ewm(span=12).mean() / x.ewm(span=26).mean() - 1)
    assert np.allclose(got["ppo_signal_12_26"], ppo.ewm(span=9).mean())
    got = filters.oscillator_family(x.to_numpy())
    third = x.ewm(span=15).mean().ewm(span=15).mean().ewm(span=15).mean()
    assert np.allclose(got["trix"], third.pct_change() * 100, equal_nan=True) and np.isnan(got["rsi_14"][:13]).all() and (got["rsi_14"][13:] <= 100).all()
    assert np.isnan(got["tsi"][:37]).all() and not np.isnan(got["tsi"][37:]).any()


def test_path_risk_over_a_year():
    """All four windows are there."""
    for program, hidden in (signals.FAMILIES["ulcer_calmar_recovery"], signals.FAMILIES["cvar_tail_ratio"]):
        made = signals.names(program, hidden, SPARK)
        assert all(any(n.endswith(f"_{w}") for n in made) for w in signals.WINDOWS)
    assert {f"{n}_{w}" for n in ("ulcer_index", "calmar", "recovery_factor", "ulcer_perf") for w in signals.WINDOWS} <= set(signals.names(*signals.FAMILIES["ulcer_calmar_recovery"], SPARK))


def test_kernel_weights():
    for w, order in ((51, 2), (21, 3)):
        c = np.array(filters.savgol_weights(w, order))
        t = np.arange(w)
        for k in range(order + 1):
            assert math.isclose(c @ t**k, (w - 1) ** k, rel_tol=1e-8, abs_tol=1e-8)
    assert len(filters.savgol_weights(50)) == 51
    assert math.isclose(sum(filters.wma_weights(10)), 1) and filters.wma_weights(10)[-1] > filters.wma_weights(10, "reference")[-1]
    grid = filters.dpo_grid()
    assert len(grid) == 506 and len(set(grid.values())) == 482


def test_indicators_against_numpy(spark):
    x = [3.0, 1.0, 3.0, None, 2.0]
    df = spark.createDataFrame([(i, pd.Timestamp("2024-01-01").date(), v) for i, v in enumerate(x)], "inst long, dt date, p double")
    got = {r["inst"]: r for r in apply(df, indicators.stages(SPARK)).collect()}
    v = np.array([3.0, 1.0, 3.0, 2.0])
    assert got[3]["x_zscore"] is None and got[0]["x_rank_share"] == 1.0 and got[4]["x_rank_share"] == 0.5
    assert math.isclose(got[1]["x_zscore"], (1 - v.mean()) / v.std()) and math.isclose(got[0]["x_softmax"], 1 / np.exp(v - 3).sum())


def test_percentile_rank_is_the_average_rank(spark):
    x = [5.0, 1.0, 5.0, None, 3.0, 1.0, 1.0]
    spark.createDataFrame([(i, 1, v) for i, v in enumerate(x)], "i long, dt long, v double").createOrReplaceTempView("xs")
    got = [r[0] for r in spark.sql(f"SELECT {strategy.pct_rank('v')} AS q, i FROM xs ORDER BY i").collect()]
    want = pd.Series(x).rank(pct=True)
    assert all((a is None and math.isnan(b)) or math.isclose(a, b) for a, b in zip(got, want, strict=True))


def test_greedy_is_greedy():
    rng = np.random.default_rng(2)
    n = 20
    mu, sigma = rng.normal(0.02, 0.02, n).tolist(), rng.uniform(0.01, 0.05, n).tolist()
    ir = [m / s for m, s in zip(mu, sigma, strict=True)]
    p = [0.5 + 0.4 * math.tanh(x) for x in ir]
    names = [f"f{i:02d}" for i in range(n)]
    out = ensemble.greedy(names, mu, sigma, ir, p)
    assert out[0][0] == names[int(np.argmax(ir))] and ensemble.LEAST_SIZE <= len(out) <= ensemble.MOST
    for k in range(1, len(out)):
        ids = [names.index(f) for f, _ in out[:k]]
        rest = [i for i in range(n) if i not in ids]
        best = max(ensemble.utility([mu[j] for j in [*ids, i]], [p[j] for j in [*ids, i]], [sigma[j] for j in [*ids, i]]) for i in rest)
        assert math.isclose(out[k][1], best)


def test_allocation_spends_what_it_can():
    prices = {"c": 101.0, "a": 33.0, "b": 57.5}
    n = portfolio.allocate(prices, portfolio.core_satellite("c", ["a", "b"]), 1000.0)
    left = 1000 - sum(n[k] * prices[k] for k in n)
    assert 0 <= left < min(prices.values())
    total = sum(n[k] * prices[k] for k in n)
    again = portfolio.allocate({"a": 10.0, "b": 7.0}, {"a": 0.5, "b": 0.5}, 41.0)
    assert again == {"a": 2, "b": 3} and total > 900  # after two of each, one more b leaves percentages closer than one more a
    with pytest.raises(ValueError):
        portfolio.allocate({"a": 1.0}, {"a": 0.5, "b": 0.5}, 10)


def test_simulation_keeps_money():
    days = pd.date_range("2024-01-01", periods=200)
    rng = np.random.default_rng(0)
    prices = pd.DataFrame({k: 50 * np.exp(np.cumsum(rng.normal(0, 0.01, 200))) for k in "ab"}, index=days)
    flat = pd.DataFrame({"a": 10.0, "b": 20.0}, index=days)
    for smart in (False, True):
        out = portfolio.simulate(flat, {"a": 0.5, "b": 0.5}, monthly=100.0, smart=smart)
        assert math.isclose(out["value"].iloc[-1], 10_000 + 600, rel_tol=1e-9)
        assert out["rebalanced"].sum() == 3
        assert (portfolio.simulate(prices, {"a": 0.5, "b": 0.5}, smart=smart)["value"] > 0).all()
    with pytest.raises(ValueError):
        portfolio.simulate(flat, {"a": 0.5, "b": 0.2})


def test_upsert_and_facts(spark):
    dim = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "isin long, name string, size double")
    delta = spark.createDataFrame([(2, None, 5.0), (3, "c", None)], "isin long, name string, size double")
    assert sorted(map(tuple, relational.upsert(dim, delta, "isin").collect())) == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", None)]
    facts = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 9.0)], "isin long, dt long, price double")
    new = spark.createDataFrame([(1, 2, 7.0), (1, 3, None)], "isin long, dt long, price double")
    assert sorted(map(tuple, relational.replace_facts(facts, new, ["isin", "dt"]).collect())) == [(1, 1, 1.0), (1, 2, 7.0), (2, 1, 9.0)]
    assert sorted(map(tuple, relational.replace_facts(facts, new, ["isin", "dt"], replace=True).collect())) == [(1, 2, 7.0), (2, 1, 9.0)]
    assert relational.without_words(dim.unionByName(delta), "name", ("A",)).count() == 4
    funds = spark.createDataFrame([("World x2",), ("Geared gold",), ("Plain",), (None,)], "name string")
    assert [r[0] for r in relational.without_words(funds, "name").collect()] == ["Plain", None]


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("x", 1), ("x", 5), ("x", 9), ("y", 4)], "k string, t long")
    right = spark.createDataFrame([("x", 5, 50), ("x", 7, 70)], "k string, t long, v long")
    back = {(r["k"], r["t"]): r["asof_v"] for r in relational.asof(left, right, "t", "v", ["k"]).collect()}
    ahead = {(r["k"], r["t"]): r["asof_v"] for r in relational.asof(left, right, "t", "v", ["k"], "forward").collect()}
    assert back == {("x", 1): None, ("x", 5): 50, ("x", 9): 70, ("y", 4): None}
    assert ahead == {("x", 1): 50, ("x", 5): 50, ("x", 9): None, ("y", 4): None}


def test_store_resumes(spark, tmp_path):
    s = store.SignalStore(spark, str(tmp_path / "signals"))
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None)], "signal string, inst long, value double").selectExpr("*", "DATE '2024-01-01' AS dt")
    assert not s.exists()
    s.save(s.missing(rows))
    more = rows.unionByName(rows.selectExpr("'c' AS signal", "inst", "value", "dt"))
    s.save(s.missing(more))
    assert {r["signal"]: r["n"] for r in s.stats().collect()} == {"a": 1, "b": 0, "c": 1}
    assert s.load(["a"], start="2024-01-01").count() == 1 and s.load(end="2023-12-31").count() == 0
    df = spark.createDataFrame([(1, ["x", "y"])], "n long, names array<string>")
    store.write_report(df, str(tmp_path / "report"))
    assert store.read_report(spark, str(tmp_path / "report"), "n long, names string", ("names",)).first()["names"] == ["x", "y"]


def test_streaming_averages_match_the_batch(spark, tmp_path):
    from gridloom.streaming.filters import running_tema, windowed_means

    src = str(tmp_path / "in")
    rows = [(i % 2, i, 10.0 + i * 0.7 % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "inst long, i long, p double").selectExpr("inst", "timestamp_seconds(i * 3600) AS ts", "p")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = running_tema(stream, 5).writeStream.format("memory").queryName("tema").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("tema").orderBy("inst", "ts").toPandas()
    for k in (0, 1):
        x = np.array([p for i, _, p in rows if i == k])
        assert np.allclose(got[got.inst == k]["tema"], filters.tema(x, 5)) and np.allclose(got[got.inst == k]["ema"], filters.ema(x, 5))
    q = windowed_means(stream).writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").count() == 4


def test_kama_skips_gaps():
    """By definition, value by value, with gaps."""
    rng = np.random.default_rng(9)
    x = 50 + rng.normal(0, 1, 200).cumsum()
    x[rng.random(200) < 0.1] = np.nan
    want, seen, now = np.full(200, np.nan), 0, None
    for i, v in enumerate(x):
        if np.isnan(v):
            continue
        seen += 1
        if seen == 21:
            now = v
        elif seen > 21:
            past = [x[i - k] for k in range(21, 31) if i - k >= 0 and not np.isnan(x[i - k])]
            if past:
                total = sum(abs(x[j] - x[j - 1]) for j in range(i - 20, i + 1) if j > 0 and not np.isnan(x[j]) and not np.isnan(x[j - 1]))
                now += (min(abs(v - past[0]) / total, 1) * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (v - now)
        if now is not None:
            want[i] = now
    assert np.allclose(filters.kama(x), want, equal_nan=True)


def test_dpo_grid_is_the_definition(spark):
    rng = np.random.default_rng(10)
    p = 50 + rng.normal(0, 1, 120).cumsum()
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(k) for k in range(120)]
    panel = spark.createDataFrame([(1, d, float(x)) for d, x in zip(days, p, strict=True)], "inst long, dt date, p double")
    grid = {n: filters.dpo_grid()[n] for n in ("dpo_10d__tema__shift_1.0", "dpo_10d__tema__shift_3.0", "dpo_66d__tema__shift_2.2")}
    for mode, sign in (("lead", 1), ("lag", -1)):
        got = {(r["signal"], r["dt"]): r["value"] for r in filters.dpo_tema(panel, grid, mode, (11,)).collect()}
        assert len(got) == 2 * len(grid) * 120
        for name, (period, shift) in grid.items():
            t = filters.tema(p, period)
            for i in range(120):
                j = i + sign * shift
                want = p[j] - t[i] if 0 <= j < 120 else None
                assert got[name, days[i]] is None if want is None else math.isclose(got[name, days[i]], want, rel_tol=1e-9, abs_tol=1e-9)


def test_required_instrument_and_horizons(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None)], "isin string, fund_size double")
    assert relational.require(df, "isin", "a", "fund_size", 5.0) is df and relational.require(df, "isin", "b") is df
    for bad in (("c",), ("b", "fund_size"), ("a", "fund_size", 6.0)):
        with pytest.raises(ValueError):
            relational.require(df, "isin", *bad)
    assert strategy.horizon_of(3) == (3, "month") and strategy.horizon_label("21d") == "21days"
    for bad in ("3", "d", None, 1.5, True):
        with pytest.raises(ValueError):
            strategy.horizon_of(bad)
