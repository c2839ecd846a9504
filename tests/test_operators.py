"""Operators on small literal frames, against hand-checked values, loops and brute force."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basisflow.functions import core
from basisflow.operators import (audit, clean, episodes, features, hedge, metrics, pnl, recursion, report, roll, scenarios,
                                 splits, validate, windows)
from basisflow.plans.quantiles import exact_quantiles
from basisflow.sources import readers, sinks

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


# ---- costs and contracts ----
@pytest.mark.parametrize("prev,new,roll_day,want", [(0, 3, 0, 30.0), (3, 1, 0, 20.0), (1, 1, 1, 20.0), (0, 1, 1, 10.0), (2, 0, 1, 60.0)])
def test_cost_cases(spark, prev, new, roll_day, want):
    r = spark.range(1).select((pnl.trade_cost(F.lit(prev), F.lit(new)) + pnl.roll_cost(F.lit(prev), F.lit(roll_day))).alias("c")).first()
    assert r.c == want


def test_rounding_modes(spark):
    x = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (-1.5,)], "x double")
    rows = x.select(core.half_even(F.col("x")).alias("e"), core.half_away(F.col("x")).alias("a")).collect()
    assert [r.e for r in rows] == [0.0, 2.0, 0.0, -2.0]
    assert [r.a for r in rows] == [1.0, 2.0, -1.0, -2.0]


# ---- fill and roll ----
def test_forward_fill_limit(spark):
    v = [None, 1.0, None, None, 2.0, None]
    df = spark.createDataFrame([("s", day(i), x) for i, x in enumerate(v)], "series_id string, d date, v double")
    w = clean.series_window()
    got = [r.f for r in df.withColumn("f", clean.forward_fill(F.col("v"), w, 1)).orderBy("d").collect()]
    assert got == [None, 1.0, 1.0, None, 2.0, 2.0]


@pytest.mark.parametrize("seed", range(4))
def test_roll_series_equals_loop(spark, seed):
    rnd = random.Random(seed)
    n = 60
    c1 = [None if rnd.random() < 0.15 else round(rnd.uniform(-5, 60), 2) for _ in range(n)]
    c2 = [None if rnd.random() < 0.3 else round(rnd.uniform(1, 60), 2) for _ in range(n)]
    rolls = {i for i in range(n) if rnd.random() < 0.15}
    fut = spark.createDataFrame([("CL", day(i), c1[i], c2[i]) for i in range(n)], "instrument string, d date, cl1 double, cl2 double")
    table = spark.createDataFrame([("CL", day(i)) for i in rolls] or [("CL", day(-9))], "instrument string, roll_date date")
    got = [(r.f_mark, r.pnl_1c, r.roll_flag) for r in roll.series_roll(fut, table).orderBy("d").collect()]
    want, held = [], None
    for i in range(n):
        if c1[i] is None:
            want.append((None, None, 0))
            if i == 0:
                held = None
            continue
        if i == 0:
            held = c1[0]
            want.append((c1[0], None, 0))
            continue
        if held is None:
            held = c1[i]
        p = (c1[i] - held) * 1000
        mark = c2[i] if i in rolls and c2[i] is not None else c1[i]
        held = mark
        want.append((mark, p, int(i in rolls)))
    for (a, b, c), (x, y, z) in zip(got, want):
        assert a == x and c == z
        assert (b is None) == (y is None) or (b == 0 and y is None) or (y == 0 and b is None)
        if b is not None and y is not None:
            assert abs(b - y) < 1e-6


# ---- quantiles of any group size ----
def test_quantiles_with_ties_nulls_and_a_hot_group(spark):
    rng = np.random.default_rng(1)
    hot = np.round(rng.normal(size=60_000) * 100, 1)
    small = rng.normal(size=37)
    pdf = pd.concat([pd.DataFrame({"g": "hot", "x": hot}), pd.DataFrame({"g": "small", "x": small}),
                     pd.DataFrame({"g": [None] * 5, "x": [1.0, 1.0, 1.0, 2.0, np.nan]})])
    df = spark.createDataFrame(pdf, "g string, x double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", {"a": 0.05, "m": 0.5, "z": 0.999}, {"lo": (0.05, "below"), "hi": (0.95, "above")}).collect()}
    for g, x in (("hot", hot), ("small", small), (None, np.array([1.0, 1.0, 1.0, 2.0]))):
        q05, q95 = np.quantile(x, 0.05), np.quantile(x, 0.95)
        want = [q05, np.quantile(x, 0.5), np.quantile(x, 0.999), x[x <= q05].mean(), x[x >= q95].mean()]
        assert np.allclose([got[g].a, got[g].m, got[g].z, got[g].lo, got[g].hi], want, atol=1e-9)


def test_quantiles_without_keys(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    r = exact_quantiles(df, [], "x", {"q": 0.25}).first()
    assert r.q == 250.0


# ---- selections ----
@pytest.mark.parametrize("seed", range(5))
def test_feasible_monthly_is_optimal(spark, seed):
    rnd = random.Random(seed)
    rows = [("N", day(d), k, f"s{d}_{k}", float(rnd.randint(-50, 40))) for d in range(rnd.choice([2, 4, 6])) for k in range(1, 3)]
    uni = spark.createDataFrame(rows, "exposure_id string, start_date date, k int, scenario_id string, score_physical double")
    for best in (True, False):
        got = scenarios.feasible_monthly(uni, best, (3, 4)).collect()
        by_day = {}
        for r in rows:
            by_day.setdefault(r[1], []).append(r[4])
        sets = [c for n in (3, 4) for days in itertools.combinations(by_day, n) for c in itertools.product(*[by_day[d] for d in days])]
        if not sets:
            assert not got
            continue
        want = max(map(sum, sets)) if best else min(map(sum, sets))
        assert 3 <= len(got) <= 4 and len({r.start_date for r in got}) == len(got)
        assert sum(r.score_physical for r in got) == want


# ---- graph operators ----
@pytest.mark.parametrize("seed", range(3))
def test_prune_and_groups_on_random_graphs(spark, seed):
    rnd = random.Random(seed)
    f = [f"f{i:02d}" for i in range(14)]
    corr = {(a, b): rnd.uniform(0.7, 1) for a, b in itertools.combinations(f, 2) if rnd.random() < 0.12} or {("f00", "f01"): 0.9}
    pr = {x: float(rnd.randint(0, 6)) for x in f}
    edge = features.edges(spark.createDataFrame([(a, b, c) for (a, b), c in corr.items()], "feature_i string, feature_j string, corr double"), 0.7)
    kept, dropped = features.greedy_prune(edge, spark.createDataFrame(list(pr.items()), "feature string, priority double"))
    both = {**corr, **{(b, a): c for (a, b), c in corr.items()}}
    keep, drop = [], {}
    for x in sorted(f, key=lambda x: (-pr[x], x)):
        k = next((k for k in keep if (x, k) in both), None)
        if k is None:
            keep.append(x)
        else:
            drop[x] = k
    assert {r.feature for r in kept.collect()} == set(keep)
    assert {r.feature: r.kept_feature for r in dropped.collect()} == drop
    label = {x: x for x in f}
    for _ in f:
        for a, b in both:
            label[a] = min(label[a], label[b])
    want = {}
    for x in f:
        want.setdefault(label[x], set()).add(x)
    got = {}
    for r in features.connected_groups(edge).collect():
        got.setdefault(r.group_id, set()).add(r.feature)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


# ---- recursions ----
def test_ewma_matches_pandas_with_gaps():
    rng = np.random.default_rng(0)
    r = rng.normal(size=80)
    r[[0, 1, 7, 8, 9, 40]] = np.nan
    want = pd.Series(r).pow(2).ewm(alpha=0.06, adjust=False).mean().to_numpy()
    got = recursion.ewma_variance(r)
    ok = np.isfinite(r)
    assert np.allclose(got[ok], want[ok]) and np.isnan(got[~ok]).all()


def test_grid_fit_gate_and_scale():
    rng = np.random.default_rng(3)
    assert np.isnan(recursion.garch_grid_fit(rng.normal(size=700))).all()
    r = rng.normal(size=1500) * 0.02
    s = recursion.garch_grid_fit(r)
    assert 0.015 < np.nanmean(s) < 0.025


def test_dcc_sees_only_the_past():
    rng = np.random.default_rng(5)
    z1, z2 = rng.normal(size=400), rng.normal(size=400)
    a = recursion.dcc_path(z1, z2)
    z1[350:] *= 9
    assert np.allclose(a[1:351], recursion.dcc_path(z1, z2)[1:351])


def test_pacf_of_ar1(spark):
    rng = np.random.default_rng(2)
    x = [0.0]
    for e in rng.normal(size=2500):
        x.append(0.6 * x[-1] + e)
    df = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate(x)], "series_id string, d date, v double")
    a = audit.acf(df, "v", 5)
    got = {r.lag: r.pacf for r in audit.pacf(a).collect()}
    r = {q.lag: q.acf for q in a.collect()}
    assert abs(got[1] - r[1]) < 1e-12 and abs(got[2] - (r[2] - r[1] ** 2) / (1 - r[1] ** 2)) < 1e-9
    assert abs(got[1] - 0.6) < 0.06 and all(abs(got[k]) < 0.06 for k in (2, 3, 4, 5))


# ---- P&L ----
def _market(spark, n=400, seed=4, bump=None):
    rng = np.random.default_rng(seed)
    spot, fut = 50 + rng.normal(size=n).cumsum() * 0.5, 49 + rng.normal(size=n).cumsum() * 0.5
    if bump is not None:
        spot[bump:] += 7
        fut[bump:] *= 1.5
    uni = spark.createDataFrame([("N", day(i), float(s)) for i, s in enumerate(spot)], "exposure_id string, d date, spot double")
    ser = spark.createDataFrame([(day(i), float(f), 0.0, int(i % 21 == 20)) for i, f in enumerate(fut)], "d date, f_mark double, pnl_1c double, roll_flag int")
    return windows.market_calendar(uni, ser), spot, fut


STRATS = lambda: [hedge.nohedge(), hedge.naive(), hedge.ols_static(), hedge.ols_roll(60, 30)]


def test_pnl_against_a_plain_loop(spark):
    cal, spot, fut = _market(spark)
    t = spark.createDataFrame([("T1", "N", day(200), day(231), 755_500), ("T2", "N", day(220), day(220), 1_000_000)],
                              "scenario_id string, exposure_id string, start_date date, end_date date, volume_bbl long")
    keys = ["scenario_id", "exposure_id", "volume_bbl"]
    rows = pnl.trade_days(t, cal, windows.valid_days(cal), STRATS())
    got = {(r.scenario_id, r.strategy): r for r in pnl.summaries(rows, STRATS(), keys).collect()}
    assert len(got) == 8
    r = got["T1", "naive"]
    q, n = 755_500, -int(np.rint(755.5))
    roll_days = [i for i in range(201, 232) if i % 21 == 20]
    net = (spot[231] - spot[200]) * q + n * (fut[231] - fut[200]) * 1000 - abs(n) * 10 - len(roll_days) * abs(n) * 20
    assert abs(r.net_pnl_total - net) < 1e-4 and r.max_abs_contracts == abs(n) and r.n_days == 32
    for r in got.values():
        assert abs(r.net_pnl_total - (r.spot_pnl_total + r.fut_pnl_total - r.cost_trade_total - r.cost_roll_total)) < 1e-6
        assert r.mdd_equity <= 0
    assert got["T1", "nohedge"].fut_pnl_total == 0 and got["T2", "naive"].n_days == 1


def test_ratios_do_not_see_the_future(spark):
    t = spark.createDataFrame([("T1", "N", day(200), day(240), 1_000_000)],
                              "scenario_id string, exposure_id string, start_date date, end_date date, volume_bbl long")
    got = []
    for bump in (None, 225):
        cal, _, _ = _market(spark, bump=bump)
        rows = pnl.trade_days(t, cal, windows.valid_days(cal), STRATS()).where(F.col("d") < F.lit(day(225)))
        got.append([tuple(r) for r in rows.orderBy("pos").select("ols_static__h", "ols_roll__h").collect()])
    assert got[0] == got[1] and len(got[0]) == 25


def test_static_mode_and_short_side(spark):
    cal, _, _ = _market(spark)
    t = spark.createDataFrame([("T1", "N", day(200), day(230), 1_000_000)],
                              "scenario_id string, exposure_id string, start_date date, end_date date, volume_bbl long")
    frozen = pnl.trade_days(t, cal, windows.valid_days(cal), STRATS(), pnl.PnlConfig(dynamic=False))
    assert frozen.select("ols_roll__n").distinct().count() == 1
    short = pnl.trade_days(t, cal, windows.valid_days(cal), STRATS(), pnl.PnlConfig(side=-1))
    assert short.select("naive__n").distinct().first()[0] == 1000


def test_missing_days_shorten_the_window(spark):
    uni = spark.createDataFrame([("N", day(i), 10.0 + i if i not in (3, 4) else None) for i in range(10)], "exposure_id string, d date, spot double")
    ser = spark.createDataFrame([(day(i), 5.0 + i, 0.0, 0) for i in range(10)], "d date, f_mark double, pnl_1c double, roll_flag int")
    cal = windows.market_calendar(uni, ser)
    t = spark.createDataFrame([("a", "N", day(3), day(7)), ("b", "N", day(2), day(6)), ("c", "N", day(3), day(4)), ("d", "N", day(3), day(5))],
                              "scenario_id string, exposure_id string, start_date date, end_date date")
    got = {r.scenario_id: (r.window_rows, r.window_dropped_nan_rows) for r in windows.bounds(t, cal).collect()}
    assert got == {"a": (3, 2), "b": (3, 2)}
    first = windows.unfold(windows.bounds(t, cal).where("scenario_id = 'b'"), windows.valid_days(cal), ["d_spot"]).orderBy("pos").collect()
    assert [r.d_spot for r in first] == [1.0, 3.0, 1.0]


def test_effectiveness_of_no_hedge_is_zero(spark):
    df = spark.createDataFrame([("e", s, float(v)) for s in ("nohedge", "naive") for v in (1, 5, 9)], "e string, strategy string, x double")
    m = df.groupBy("e", "strategy").agg(*[F.var_samp("x").alias(f"var_{p}") for p in ("net", "gross", "spot")])
    got = metrics.add_effectiveness(m, ["e"])
    assert all(abs(r.he_net_vs_nohedge) < 1e-12 for r in got.collect())


# ---- report and contract ----
def test_contract_report():
    assert set(validate.ALIASES.values()) <= set(validate.REQUIRED)


def test_contract_renames_and_rejects(spark):
    base = {c: "x" for c in validate.TEXTS[:4]} | {c: 1.0 for c in validate.DOUBLES}
    df = spark.createDataFrame([tuple(base.values())], list(base)).withColumnRenamed("net_pnl_total", "pnl_total")
    d, rep = validate.conform(df)
    assert rep["renamed"] == {"pnl_total": "net_pnl_total"} and rep["defaulted"] == ["split", "window_id"]
    with pytest.raises(ValueError):
        validate.conform(df.drop("mdd_equity"))


def test_common_scenarios_keeps_disjoint_buckets(spark):
    rows = [("a", "s1", 1), ("a", "s2", 1), ("a", "s2", 2), ("b", "s1", 1), ("b", "s2", 2), ("c", "s1", 1)]
    df = spark.createDataFrame([(b, s, f"T{i}") for b, s, i in rows], "b string, strategy string, scenario_id string")
    got = sorted(tuple(r) for r in report.common_scenarios(df, ["b"]).select("b", "strategy", "scenario_id").collect())
    assert got == [("a", "s1", "T1"), ("a", "s2", "T1"), ("b", "s1", "T1"), ("b", "s2", "T2"), ("c", "s1", "T1")]


def test_safe_names():
    assert sinks.safe_names(["Date", "a b", "a-b", "__"]) == {"Date": "Date", "a b": "a_b", "a-b": "a_b_2", "__": "col"}


def test_date_column():
    assert readers.date_column(["x", "TradeDate"]) == "TradeDate"
    with pytest.raises(ValueError):
        readers.date_column(["x"])


def test_csv_falls_back_to_latin1(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("Date,Größe\n2020-01-02,1.5\nbad,2\n".encode("latin-1"))
    df = readers.read_master(spark, str(p))
    assert df.columns == ["d", "Größe"] and df.count() == 1


def test_segments_are_half_open(spark):
    df = spark.createDataFrame([(day(i),) for i in range(1500)], "d date")
    w = splits.walk_forward_years(df, "d", 1, 1, 1, 1)
    seg = splits.segments(w)
    got = splits.assign(df, seg, "d").groupBy("window_id", "segment").agg(F.min("d").alias("a"), F.max("d").alias("b")).collect()
    assert {(r.window_id, r.segment): (r.a, r.b) for r in got}[1, "val"] == (dt.date(2021, 1, 1), dt.date(2021, 12, 31))


def test_numbered_positions(spark):
    df = spark.createDataFrame([(day(i % 7), i) for i in range(50)], "d date, i int")
    got = [r.i for r in episodes.numbered(df, "d", ["i"]).orderBy("position").collect()]
    assert got == [i for _, i in sorted((day(i % 7), i) for i in range(50))]


def test_oracle_label_parts(spark):
    df = spark.createDataFrame([("EXTREME_DAILY_BEST",), ("nan",), ("feasible-x worst",)], "s string")
    got = df.select(*[c.alias(n) for n, c in zip("abc", report.oracle_parts(F.col("s")))], *[c.alias(n) for n, c in zip("xyz", report.oracle_words(F.col("s")))]).collect()
    assert tuple(got[0]) == ("EXTREME", "DAILY", "BEST", "EXTREME", "DAILY", "BEST")
    assert tuple(got[1]) == (None, None, None, "unknown", "unknown", "unknown")
    assert tuple(got[2])[3:] == ("FEASIBLE", "unknown", "WORST")
