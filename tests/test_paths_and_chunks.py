"""Path strategies, recursions in chunks and sliding moments against loops."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basisflow.operators import hedge, paths, pnl, recursion, returns
from basisflow.plans import sliding

D0 = dt.date(2020, 1, 1)


def series(seed, n, gaps=True):
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.02, n)
    if gaps:
        x[r.random(n) < 0.2] = np.nan
        x[:7] = np.nan
    return x


def frame(spark, columns: dict, keys=("a",), order="pos"):
    n = len(next(iter(columns.values())))
    rows = [(k, i + 1, *[None if np.isnan(v[i]) else float(v[i]) for v in columns.values()]) for k in keys for i in range(n)]
    return spark.createDataFrame(rows, f"key string, {order} long, " + ", ".join(f"{c} double" for c in columns)).repartition(5)


def column(df, name, order="pos"):
    return np.array([np.nan if r[0] is None else r[0] for r in df.orderBy(order).select(name).collect()])


# ---- sliding moments ----
@pytest.mark.parametrize("window", [1, 2, 7, 20, 64])
def test_sliding_moments_equal_frames(spark, window):
    x, y = series(1, 60) + 5, series(2, 60) + 5
    x[30:45] = 3.7  # constant for longer than a short window
    df = frame(spark, {"x": x, "y": y})
    both = sliding.pair_moments(df, "key", "pos", [window, 11], "x", "y").where(F.col("window") == window)
    got = both.select("at", "m.n", sliding.correlation().alias("corr"), sliding.slope_of(True).alias("slope"), sliding.slope_of(False).alias("plain")).distinct().orderBy("at").collect()
    for i, r in enumerate(got):
        a, b = x[max(0, i - window + 1):i + 1], y[max(0, i - window + 1):i + 1]
        ok = np.isfinite(a) & np.isfinite(b)
        a, b = a[ok], b[ok]
        assert r.n == len(a)
        flat = len(a) < 2 or a.min() == a.max() or b.min() == b.max()
        assert (r["corr"] is None) == flat
        if not flat:
            assert r["corr"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
            assert r.slope == pytest.approx(np.polyfit(a, b, 1)[0], rel=1e-7, abs=1e-9)
        if len(a):
            assert r.plain == pytest.approx((a * b).sum() / (a * a).sum(), rel=1e-9)


def test_sliding_plan_has_no_wide_frame(spark):
    df = frame(spark, {"x": series(1, 9), "y": series(2, 9)})
    plan = returns.rolling_corr(df, "x", "y", "key", "pos", 252, "r")._jdf.queryExecution().executedPlan().toString()
    frames = set(re.findall(r"RowFrame, (unbounded|-?\d+)[^,]*, (current|-?\d+)", plan))
    assert all(a == b or a == "unbounded" for a, b in frames) and frames, frames
    assert plan.count("Exchange") == 2, plan  # the fixture's own and one by series


# ---- chunks ----
@pytest.mark.parametrize("rows", [13, 40, 1000])
def test_ewma_in_chunks_equals_the_loop(spark, rows):
    x = series(3, 300)
    x[100:140] = np.nan  # a whole chunk without a value
    df = frame(spark, {"r": x}, keys=("a", "b"))
    got = recursion.ewma_in_chunks(df, "key", "pos", "r", "v", rows=rows).where("key = 'b'")
    np.testing.assert_allclose(column(got, "v"), recursion.ewma_variance(x), rtol=1e-12)


def test_linear_features_in_chunks_equal_the_series_form(spark):
    x = {"rs": series(4, 400), "rf": series(5, 400), "basis_ret": series(6, 400)}
    df = frame(spark, x).withColumnRenamed("key", "exposure_id")
    want = recursion.volatility_features(df, order="pos")
    got = recursion.linear_features_in_chunks(df, order="pos", rows=45)
    for c in got.columns[2:]:
        np.testing.assert_allclose(column(got, c), column(want, c), rtol=1e-9, atol=1e-15, err_msg=c)


def test_floor_survives_the_chunks(spark):
    """Zero returns for long enough reach the floor, in the middle of one chunk and over several."""
    x = np.r_[series(7, 60, False), np.zeros(700), series(8, 40, False)]
    df = frame(spark, {"rs": x, "rf": x, "basis_ret": x}).withColumnRenamed("key", "exposure_id")
    got = column(recursion.linear_features_in_chunks(df, order="pos", rows=50), "igarch_spot_vol_lag1")
    np.testing.assert_allclose(got, np.sqrt(recursion.igarch(x)), rtol=1e-9)
    assert got[700] == pytest.approx(np.sqrt(recursion.FLOOR))


@pytest.mark.parametrize("n,window", [(250, 252), (250, 60), (4, 252)])
def test_dcc_in_chunks_equals_the_series_form(spark, n, window):
    z = {"z1": series(9, n) * 50, "z2": series(10, n) * 50}
    got = column(recursion.dcc_in_chunks(frame(spark, z), "key", "pos", window=window, rows=31), "rho_dcc")
    np.testing.assert_allclose(got, recursion.dcc_path(z["z1"], z["z2"], window=window), rtol=1e-9)


# ---- path strategies ----
def market(spark, n=60):
    r = np.random.default_rng(0)
    rows = [(e, i + 1, i + 1, 1, D0 + dt.timedelta(days=i), float(30 + r.normal()), float(31 + r.normal()), float(r.normal() * 100), int(i % 17 == 9), float(r.normal()))
            for e in ("X", "Y") for i in range(n)]
    cal = spark.createDataFrame(rows, "exposure_id string, pos long, idx long, valid int, d date, spot double, fut double, pnl_1c double, roll_flag int, h_feature double")
    w = Window.partitionBy("exposure_id").orderBy("pos")
    days = cal.withColumns({"d_spot": returns.diff0(F.col("spot"), w), "d_fut": returns.diff0(F.col("fut"), w),
                            "r_s": F.try_divide("spot", F.lag("spot").over(w)) - 1, "r_f": F.try_divide("fut", F.lag("fut").over(w)) - 1})
    trades = [(f"T{i}", "XY"[i % 2], D0 + dt.timedelta(days=int(s)), D0 + dt.timedelta(days=int(s + length)), 1000.0 * int(q))
              for i, (s, length, q) in enumerate(zip(r.integers(0, 30, 40), r.integers(1, 25, 40), r.integers(1, 900, 40)))]
    return cal, days, spark.createDataFrame(trades, "scenario_id string, exposure_id string, start_date date, end_date date, volume_bbl double")


def totals(spark, strategy, cfg=pnl.PnlConfig()):
    cal, days, trades = market(spark)
    rows = pnl.trade_days(trades, cal, days, [strategy], cfg)
    return sorted((r.scenario_id, round(r.net_pnl_total, 6), r.max_abs_contracts, round(r.turnover_h, 9)) for r in pnl.summaries(rows, [strategy], ["scenario_id"], cfg).collect())


@pytest.mark.parametrize("dynamic", [True, False])
def test_path_form_of_a_column_strategy_has_the_same_pnl(spark, dynamic):
    cfg = pnl.PnlConfig(dynamic=dynamic)
    column_form = hedge.by_day("s", lambda d: d, "h_feature")
    hedge.register("mine", lambda: paths.path_strategy("s", lambda t: t["h_feature"], ("h_feature",)))
    try:
        path_form = hedge.make_strategy("mine")
        assert "mine" in hedge.available_strategies()
        assert totals(spark, path_form, cfg) == totals(spark, column_form, cfg)
    finally:
        del hedge._FACTORIES["mine"]


def test_day_by_day_form_sees_no_later_day(spark):
    seen = paths.path_strategy("s", paths.day_by_day(lambda t, x: float(len(x["spot"]) == t + 1 and x["spot"][-1] > x["spot"][0])))
    whole = paths.path_strategy("s", paths.one_by_one(lambda x: (x["spot"] > x["spot"][0]).astype(float)))
    assert totals(spark, seen) == totals(spark, whole)


def test_missing_feature_and_wrong_length_are_errors(spark):
    cal, days, trades = market(spark)
    with pytest.raises(ValueError, match="absent"):
        pnl.trade_days(trades, cal, days, [paths.path_strategy("s", lambda t: t["absent"], ("absent",))])
    short = paths.path_strategy("s", lambda t: np.zeros(1))
    with pytest.raises(Exception, match="ratios for"):
        pnl.trade_days(trades, cal, days, [short]).count()


def test_not_finite_ratios_hold_nothing(spark):
    odd = paths.path_strategy("s", lambda t: np.where(t["spot"] > 30, np.nan, np.inf))
    assert totals(spark, odd) == totals(spark, hedge.constant("s", 0.0))


def test_window_correlation_equals_the_loop_per_trade():
    sizes = [1, 3, 40, 25, 0, 12]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    z1, z2 = series(1, starts[-1]) * 50, series(2, starts[-1]) * 50
    trades = paths.Trades({}, np.zeros(starts[-1]), starts)
    for window in (252, 9, 0):
        got = paths.window_correlation(trades, z1, z2, 0.02, 0.95, window)
        want = np.concatenate([recursion.dcc_path(z1[a:b], z2[a:b], 0.02, 0.95, window) for a, b in zip(starts, starts[1:])])
        np.testing.assert_allclose(got, want, rtol=1e-9)
