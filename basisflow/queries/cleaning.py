"""Queries of cleaning, returns, rolling statistics and calendar joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basisflow.functions.core import clip
from basisflow.operators import clean, pnl, returns, roll, windows
from basisflow.queries import base
from basisflow.queries.registry import query
from basisflow.queries.sqlbase import add_cte
from basisflow.sources import market

W = lambda: Window.partitionBy("series_id").orderBy("d")
SW = "WINDOW w AS (PARTITION BY series_id ORDER BY d)"


@query("P1_to_double", "event_id:i k:f4 event_type:f4",
       "SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, "
       "TRY_CAST(event_type AS DOUBLE) AS event_type FROM events")
def _(spark, sf):
    e = market.table(spark, sf, "events").select(
        "event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"), "event_type")
    return clean.to_double(e, ["k", "event_type"])


@query("P2_zero_to_missing", "series_id:s d:d price:f4",
       "SELECT series_id, d, nullif(price, 0) AS price FROM raw", "raw")
def _(spark, sf):
    return base.raw_panel(spark, sf).withColumn("price", clean.zero_to_missing(F.col("price")))


@query("P3_updated_flag", "series_id:s d:d updated:i",
       "SELECT series_id, d, CASE WHEN price IS NOT NULL AND price <> 0 THEN 1 ELSE 0 END AS updated FROM raw", "raw")
def _(spark, sf):
    return base.raw_panel(spark, sf).withColumn("updated", clean.updated_flag(F.col("price")))


@query("P4_tradable_flags", "d:d cl1_updated:i changed:i any_changed:i", """
    SELECT d, max(CASE WHEN series_id = 'A' THEN updated ELSE 0 END) AS cl1_updated,
           max(CASE WHEN series_id = 'A' THEN ch ELSE 0 END) AS changed, max(ch) AS any_changed
    FROM (SELECT *, CASE WHEN value IS NOT NULL AND (lag(value) OVER w IS NULL OR value <> lag(value) OVER w)
                         THEN 1 ELSE 0 END AS ch FROM filled WHERE series_id IN ('A', 'R', 'N') """ + SW + """)
    GROUP BY d""", "filled")
def _(spark, sf):
    f = base.filled(spark, sf).where(F.col("series_id").isin("A", "R", "N"))
    f = f.withColumn("ch", clean.changed_flag(F.col("value"), W()))
    front = F.col("series_id") == market.FRONT
    return f.groupBy("d").agg(
        F.max(F.when(front, F.col("updated")).otherwise(0)).alias("cl1_updated"),
        F.max(F.when(front, F.col("ch")).otherwise(0)).alias("changed"), F.max("ch").alias("any_changed"))


@query("P5_universe", "exposure_id:s d:d spot:f4 cl1:f4 cl2:f4 spot_updated:i cl1_updated:i tradable:i",
       "SELECT * FROM uni", "uni")
def _(spark, sf):
    return base.universe(spark, sf)


@query("P6_exposure_lookup", "asked:s exposure_id:s", """
    WITH known AS (SELECT DISTINCT series_id AS exposure_id, 'px_' || lower(series_id) AS price_column FROM panel),
         asked AS (SELECT DISTINCT trim(CASE o_orderkey % 5 WHEN 0 THEN lower(o_orderpriority)
                       WHEN 1 THEN ' ' || o_orderpriority WHEN 2 THEN 'px_' || lower(o_orderpriority)
                       WHEN 3 THEN 'PX_' || o_orderpriority ELSE 'zz' || o_orderstatus END) AS asked FROM orders)
    SELECT a.asked, coalesce(k1.exposure_id, k2.exposure_id, k3.exposure_id, k4.exposure_id) AS exposure_id
    FROM asked a LEFT JOIN known k1 ON k1.exposure_id = asked LEFT JOIN known k2 ON lower(k2.exposure_id) = lower(asked)
    LEFT JOIN known k3 ON k3.price_column = asked LEFT JOIN known k4 ON lower(k4.price_column) = lower(asked)""", "panel")
def _(spark, sf):
    known = base.panel(spark, sf).select(
        F.col("series_id").alias("exposure_id"), F.concat(F.lit("px_"), F.lower("series_id")).alias("price_column")).distinct()
    p, k = F.col("o_orderpriority"), F.col("o_orderkey") % 5
    asked = market.table(spark, sf, "orders").select(
        F.when(k == 0, F.lower(p)).when(k == 1, F.concat(F.lit(" "), p)).when(k == 2, F.concat(F.lit("px_"), F.lower(p)))
        .when(k == 3, F.concat(F.lit("PX_"), p)).otherwise(F.concat(F.lit("zz"), "o_orderstatus")).alias("asked"))
    return clean.exposure_lookup(asked, known)


@query("P19_price_events", "series_id:s d:d kind:s price:f4",
       "SELECT series_id, d, CASE WHEN price < 0 THEN 'negative' ELSE 'zero' END AS kind, price FROM raw WHERE price <= 0",
       "raw")
def _(spark, sf):
    p = F.col("price")
    return (base.raw_panel(spark, sf).where(p <= 0)
            .withColumn("kind", F.when(p < 0, "negative").otherwise("zero")))


@query("P20_missing_flags", "series_id:s d:d isnan_raw:i isnan_value:i",
       "SELECT series_id, d, CAST(raw IS NULL AS INT) AS isnan_raw, CAST(value IS NULL AS INT) AS isnan_value FROM filled",
       "filled")
def _(spark, sf):
    return clean.missing_flags(base.filled(spark, sf), ["raw", "value"])


@query("P24_clip", "trade_no:i h2:f6 h3:f6 n_capped:i", """
    SELECT trade_no, greatest(-2, least(2, x)) AS h2, greatest(-3, least(3, x)) AS h3,
           greatest(-500, least(500, -CAST(round_even(greatest(-3, least(3, x)) * volume_bbl / 1000, 0) AS BIGINT))) AS n_capped
    FROM (SELECT *, (trade_no % 1001 - 500) / 100.0::DOUBLE AS x FROM requests)""", "requests")
def _(spark, sf):
    t = market.trade_requests(spark, sf).withColumn("x", (F.col("trade_no") % 1001 - 500) / 100.0)
    n = pnl.contracts(F.col("x"), F.col("volume_bbl").cast("double"), pnl.PnlConfig(max_contracts=500))
    return t.select("trade_no", clip(F.col("x"), -2, 2).alias("h2"), clip(F.col("x"), -3, 3).alias("h3"), n.alias("n_capped"))


@query("W2_forward_fill_limited", "series_id:s d:d value:f4", """
    SELECT series_id, d, CASE WHEN rn - seen <= 1 THEN v END AS value
    FROM (SELECT *, last_value(core IGNORE NULLS) OVER u AS v,
                 last_value(CASE WHEN core IS NOT NULL THEN rn END IGNORE NULLS) OVER u AS seen
          FROM (SELECT series_id, d, nullif(raw, 0) AS core, row_number() OVER w AS rn FROM filled """ + SW + """)
          WINDOW u AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", "filled")
def _(spark, sf):
    return clean.filled_panel(base.raw_panel(spark, sf), limit=1)


add_cte("rets", """
    SELECT *, CASE WHEN p <> 0 THEN value / p - 1 END AS simple, CASE WHEN value > 0 AND p > 0 THEN ln(value / p) END AS lr
    FROM (SELECT series_id, d, value, lag(value) OVER w AS p FROM filled """ + SW + ")")


@query("W4_simple_return", "series_id:s d:d simple:g", "SELECT * FROM rets", "rets")
def _(spark, sf):
    return base.filled(spark, sf).withColumn("simple", returns.simple_return(F.col("value"), W()))


@query("W5_log_return", "series_id:s d:d lr:f9", "SELECT * FROM rets", "rets")
def _(spark, sf):
    return base.filled(spark, sf).withColumn("lr", returns.log_return(F.col("value"), W()))


@query("W6_hybrid_return", "series_id:s d:d used:f9 used_simple:i",
       "SELECT series_id, d, coalesce(lr, simple) AS used, CAST(lr IS NULL AND simple IS NOT NULL AS INT) AS used_simple FROM rets",
       "rets")
def _(spark, sf):
    used, flag = returns.hybrid_return(F.col("value"), W())
    return base.filled(spark, sf).withColumns({"used": used, "used_simple": flag})


@query("W7_damped_return", "series_id:s d:d r:f9",
       "SELECT series_id, d, coalesce(lr, sign(simple) * ln(1 + abs(simple))) AS r FROM rets", "rets")
def _(spark, sf):
    return base.filled(spark, sf).withColumn("r", returns.damped_return(F.col("value"), W()))


@query("W8_safe_log_return", "series_id:s d:d r:f9", "SELECT series_id, d, coalesce(lr, 0) AS r FROM rets", "rets")
def _(spark, sf):
    return base.filled(spark, sf).withColumn("r", returns.safe_log_return(F.col("value"), W()))


@query("W9_no_roll_series", "instrument:s d:d f_mark:f4 pnl_1c:f4 roll_flag:i held_leg:s",
       "SELECT instrument, d, cl1 AS f_mark, (cl1 - lag(cl1) OVER (ORDER BY d)) * 1000 AS pnl_1c, 0 AS roll_flag, "
       "'CL1' AS held_leg FROM fut", "fut")
def _(spark, sf):
    return roll.series_no_roll(base.futures(spark, sf))


_MOM = [f"{s}_mom_{n}d_lag1" for n in (3, 5, 10, 20) for s in ("spot", "fut")]
_GAP = [f"{s}_ma_{a}_20_gap_lag1" for s in ("spot", "fut") for a in (5, 10)]
_REST = ["basis_lag1", "basis_change_lag1", "basis_mom_5d_lag1", "basis_mom_10d_lag1",
         "spot_minus_fut_mom_5d_lag1", "spot_minus_fut_mom_10d_lag1"]
_FR = lambda n: f"(PARTITION BY exposure_id ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_ORD = "(PARTITION BY exposure_id ORDER BY d)"
add_cte("mom0", f"""
    SELECT *, CASE WHEN tradable > 0 AND spot > 0 AND lag(spot) OVER w > 0 THEN ln(spot / lag(spot) OVER w) ELSE 0 END AS rs,
           CASE WHEN tradable > 0 AND fut > 0 AND lag(fut) OVER w > 0 THEN ln(fut / lag(fut) OVER w) ELSE 0 END AS rf,
           spot - fut AS basis, coalesce(spot - fut - lag(spot - fut) OVER w, 0) AS basis_ret
    FROM cal WINDOW w AS {_ORD}""")
_sums = ", ".join(
    [f"coalesce(sum({c}) OVER {_FR(n)}, 0) AS {s}_mom_{n}d_lag1" for n in (3, 5, 10, 20) for s, c in (("spot", "rs"), ("fut", "rf"))]
    + [f"coalesce(avg({s}) OVER {_FR(n)}, 0) AS {s}_ma{n}" for s in ("spot", "fut") for n in (5, 10, 20)]
    + [f"coalesce(sum(basis_ret) OVER {_FR(n)}, 0) AS basis_mom_{n}d_lag1" for n in (5, 10)])
add_cte("mom1", f"""SELECT exposure_id, d, coalesce(lag(basis) OVER {_ORD}, 0) AS basis_lag1,
    coalesce(lag(basis_ret) OVER {_ORD}, 0) AS basis_change_lag1, {_sums} FROM mom0""")


@query("W15_momentum_features", "exposure_id:s d:d " + " ".join(f"{c}:f7" for c in _MOM + _GAP + _REST), """
    SELECT *, """ + ", ".join(
        f"CASE WHEN abs({s}_ma20) > 1e-12 THEN {s}_ma{a} / {s}_ma20 - 1 ELSE 0 END AS {s}_ma_{a}_20_gap_lag1"
        for s in ("spot", "fut") for a in (5, 10)) + """,
        spot_mom_5d_lag1 - fut_mom_5d_lag1 AS spot_minus_fut_mom_5d_lag1,
        spot_mom_10d_lag1 - fut_mom_10d_lag1 AS spot_minus_fut_mom_10d_lag1 FROM mom1""", "mom1")
def _(spark, sf):
    return returns.momentum_features(base.calendar(spark, sf))


@query("W12_W14_lagged_windows", "exposure_id:s d:d lag1:f4 sum5:f6 mean5:f6", f"""
    SELECT exposure_id, d, coalesce(lag(spot) OVER {_ORD}, 0) AS lag1, coalesce(sum(spot) OVER {_FR(5)}, 0) AS sum5,
           coalesce(avg(spot) OVER {_FR(5)}, 0) AS mean5 FROM cal""", "cal")
def _(spark, sf):
    w = Window.partitionBy("exposure_id").orderBy("d")
    return base.calendar(spark, sf).select(
        "exposure_id", "d", F.lag("spot", 1, 0.0).over(w).alias("lag1"),
        returns.past_sum(F.col("spot"), w, 5).alias("sum5"), returns.past_mean(F.col("spot"), w, 5).alias("mean5"))


@query("W16_spreads", "exposure_id:s d:d spread_12:f4 spread_14:f4 basis:f4 d_spread_12:f4 d_spread_14:f4 d_basis:f4", f"""
    SELECT *, spread_12 - lag(spread_12) OVER w AS d_spread_12, spread_14 - lag(spread_14) OVER w AS d_spread_14,
           basis - lag(basis) OVER w AS d_basis
    FROM (SELECT u.exposure_id, u.d, cl1 - cl2 AS spread_12, cl1 - f.value AS spread_14, spot - cl1 AS basis
          FROM uni u LEFT JOIN (SELECT d, value FROM filled WHERE series_id = 'N') f USING (d)) WINDOW w AS {_ORD}""",
       "uni filled")
def _(spark, sf):
    far = base.filled(spark, sf).where(F.col("series_id") == "N").select("d", F.col("value").alias("cl4"))
    u = base.universe(spark, sf).join(far, "d", "left")
    return returns.spread_features(u, Window.partitionBy("exposure_id").orderBy("d"))


def _corr_sql(n):
    f = f"(PARTITION BY exposure_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count(x) OVER {f} >= {max(20, n // 2)} THEN corr(y, x) OVER {f} END AS rho_{n}")


add_cte("pairs", """SELECT *, CASE WHEN r_s IS NOT NULL AND r_f IS NOT NULL THEN r_f END AS x,
                    CASE WHEN r_s IS NOT NULL AND r_f IS NOT NULL THEN r_s END AS y FROM vdays""")


@query("W17_rolling_corr", "exposure_id:s d:d rho_30:f7 rho_60:f7 rho_120:f7 rho_252:f7",
       "SELECT exposure_id, d, " + ", ".join(_corr_sql(n) for n in (30, 60, 120, 252)) + " FROM pairs", "pairs")
def _(spark, sf):
    return returns.rolling_corrs(base.days(spark, sf), "r_s", "r_f", "exposure_id", "pos", {f"rho_{n}": n for n in (30, 60, 120, 252)})


@query("W19_rolling_slope", "exposure_id:s d:d h:f7", "SELECT exposure_id, d, h_roll AS h FROM hratio", "hratio")
def _(spark, sf):
    return base.strategy_days(spark, sf).select("exposure_id", "d", F.col("h_ols_roll_120").alias("h"))


@query("W19_rolling_slope_direct", "exposure_id:s d:d h:f7", """
    SELECT exposure_id, d, CASE WHEN n >= 30 AND xx <> 0 THEN greatest(-2, least(2, xy / xx)) ELSE 0 END AS h
    FROM (SELECT *, count(x) OVER r AS n, sum(x * x) OVER r AS xx, sum(x * y) OVER r AS xy FROM pairs
          WINDOW r AS (PARTITION BY exposure_id ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""", "pairs")
def _(spark, sf):
    d = returns.rolling_slope(base.days(spark, sf), "r_f", "r_s", "exposure_id", "pos", 60, 30, False, "b")
    return d.withColumn("h", returns.regression_ratio(F.col("b")))


@query("W20_static_slope", "exposure_id:s d:d h:f7", "SELECT exposure_id, d, h_stat AS h FROM hratio", "hratio")
def _(spark, sf):
    from basisflow.operators.hedge import _SUMS
    d = base.strategy_days(spark, sf)
    n, x, y, xx, xy = [F.col(f"c0_{k}") - F.col(f"cb_{k}") for k in _SUMS]
    return d.withColumn("h", returns.regression_ratio(F.when(n >= 60, returns.slope(n, x, y, xx, xy, True))))


@query("W21_min_variance_ratio", "exposure_id:s h:g n:i", """
    SELECT exposure_id, count(x) AS n, CASE WHEN count(x) < 2 OR coalesce(var_samp(x), 0) = 0 THEN 0
           ELSE covar_samp(y, x) / var_samp(x) END AS h FROM pairs GROUP BY 1""", "pairs")
def _(spark, sf):
    d = base.days(spark, sf).where(F.col("r_s").isNotNull() & F.col("r_f").isNotNull())
    v = F.var_samp("r_f")
    return d.groupBy("exposure_id").agg(
        F.count("*").alias("n"),
        F.when((F.count("*") < 2) | (F.coalesce(v, F.lit(0.0)) == 0), 0.0).otherwise(F.covar_samp("r_s", "r_f") / v).alias("h"))


@query("W32_contracts", "trade_no:i even:i away:i short_side:i", """
    SELECT trade_no, -CAST(round_even(x / 1000, 0) AS BIGINT) AS even,
           -CAST(sign(x) * floor(abs(x / 1000) + 0.5) AS BIGINT) AS away, CAST(round_even(x / 1000, 0) AS BIGINT) AS short_side
    FROM (SELECT trade_no, CAST((volume_bbl // 500) * 500 AS DOUBLE) AS x FROM requests)""", "requests")
def _(spark, sf):
    t = market.trade_requests(spark, sf)
    q = (F.floor(F.col("volume_bbl") / 500) * 500).cast("double")
    one = F.lit(1.0)
    return t.select("trade_no", pnl.contracts(one, q).alias("even"),
                    pnl.contracts(one, q, pnl.PnlConfig(rounding="half_away")).alias("away"),
                    pnl.contracts(one, q, pnl.PnlConfig(side=-1)).alias("short_side"))


@query("J1_universe_prices", "exposure_id:s d:d spot:f4 fut:f4 pnl_1c:f4 roll_flag:i valid:i idx:i pos:i", "SELECT * FROM cal", "cal")
def _(spark, sf):
    return base.calendar(spark, sf)


@query("J2_trade_windows", "scenario_id:s n_days:i first_d:d last_d:d spot_move:f4 fut_move:f4 rolls:i dropped:i", """
    SELECT scenario_id, count(*) AS n_days, min(d) AS first_d, max(d) AS last_d, sum(d_spot) AS spot_move,
           sum(d_fut) AS fut_move, sum(roll_flag) AS rolls, 0 AS dropped FROM tdays0 GROUP BY 1""", "tdays0")
def _(spark, sf):
    b = windows.bounds(base.trades(spark, sf), base.calendar(spark, sf))
    b = b.select("scenario_id", "exposure_id", "pos0", "pos1", "window_dropped_nan_rows")
    rows = windows.unfold(b, base.days(spark, sf), ["d_spot", "d_fut", "roll_flag"])
    later = F.col("pos") > F.col("pos0")
    return rows.groupBy("scenario_id").agg(
        F.count("*").alias("n_days"), F.min("d").alias("first_d"), F.max("d").alias("last_d"),
        F.sum(F.when(later, F.col("d_spot")).otherwise(0.0)).alias("spot_move"),
        F.sum(F.when(later, F.col("d_fut")).otherwise(0.0)).alias("fut_move"), F.sum("roll_flag").alias("rolls"),
        F.max("window_dropped_nan_rows").alias("dropped"))


@query("J3_history_before", "scenario_id:s n_hist:i hist_first:d hist_last:d", """
    SELECT b.scenario_id, b.pos0 - greatest(1, b.pos0 - 2520) AS n_hist, h0.d AS hist_first, h1.d AS hist_last
    FROM bounds b JOIN vdays h0 ON h0.exposure_id = b.exposure_id AND h0.pos = greatest(1, b.pos0 - 2520)
    JOIN vdays h1 ON h1.exposure_id = b.exposure_id AND h1.pos = b.pos0 - 1""", "bounds vdays")
def _(spark, sf):
    b = windows.history_bounds(windows.bounds(base.trades(spark, sf), base.calendar(spark, sf)))
    day = base.calendar(spark, sf).where("valid = 1").select("exposure_id", "pos", "d")
    at = lambda c, out: day.select("exposure_id", F.col("pos").alias(c), F.col("d").alias(out))
    return (b.join(at("hist0", "hist_first"), ["exposure_id", "hist0"]).join(at("hist1", "hist_last"), ["exposure_id", "hist1"])
            .withColumn("n_hist", F.col("hist1") - F.col("hist0") + 1))


@query("J4_realised_end", "trade_no:i exposure_id:s end_date:d horizon_days_realized:i data_coverage_flag:s",
       "SELECT * EXCLUDE (end_date), CAST(end_date AS DATE) AS end_date FROM realised", "realised")
def _(spark, sf):
    return base.realised(spark, sf)


@query("J5_previous_tradable", "instrument:s d:d prev_d:d", """
    SELECT f.instrument, f.d, coalesce(p.d, z.d) AS prev_d
    FROM (SELECT DISTINCT 'CL' AS instrument, d FROM raw) f
    ASOF LEFT JOIN tradable_days t ON t.instrument = f.instrument AND f.d >= t.d
    JOIN tradable_days z ON z.instrument = f.instrument AND z.pos = 0
    LEFT JOIN tradable_days p ON p.instrument = f.instrument AND p.pos = greatest(coalesce(t.pos, 0) - 3, 0)""",
       "raw tradable_days")
def _(spark, sf):
    asked = base.panel(spark, sf).select(F.lit("CL").alias("instrument"), "d").distinct()
    return roll.nth_previous_tradable(asked, roll.tradable_days(base.futures(spark, sf)), 3)


@query("J6_date_positions", "exposure_id:s d:d exact_idx:i left_idx:i back_idx:i", """
    WITH asked AS (SELECT DISTINCT exposure_id, start_date + 1 AS d FROM requests),
         n AS (SELECT a.exposure_id, a.d, count(c.d) AS le, max(CASE WHEN c.d = a.d THEN 1 ELSE 0 END) AS hit
               FROM asked a LEFT JOIN cal c ON c.exposure_id = a.exposure_id AND c.d <= a.d GROUP BY 1, 2)
    SELECT exposure_id, d, CASE WHEN hit = 1 THEN le - 1 ELSE -1 END AS exact_idx,
           CASE WHEN hit = 1 THEN le - 1 ELSE le END AS left_idx, le - 1 AS back_idx FROM n""", "requests cal")
def _(spark, sf):
    asked = market.trade_requests(spark, sf).select("exposure_id", F.date_add("start_date", 1).alias("d"))
    return windows.date_positions(asked, base.calendar(spark, sf))


@query("J7_inject_features", "exposure_id:s d:d spot:f4 n_orders:i order_value:f4", """
    SELECT u.exposure_id, u.d, u.spot, f.n_orders, f.order_value FROM uni u LEFT JOIN
      (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n_orders,
              CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS order_value
       FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f USING (d)""", "uni")
def _(spark, sf):
    feat = (market.table(spark, sf, "orders").where("o_orderstatus = 'F'")
            .groupBy(F.to_date("o_orderdate").alias("d"))
            .agg(F.count("*").alias("n_orders"), (F.sum(market.cents("o_totalprice")) / 100.0).alias("order_value")))
    return base.universe(spark, sf).join(feat, "d", "left")


@query("J16_roll_membership", "instrument:s d:d is_roll:i",
       "SELECT f.instrument, f.d, CAST(r.roll_date IS NOT NULL AS INT) AS is_roll FROM fut f "
       "LEFT JOIN (SELECT DISTINCT roll_date FROM rolls) r ON r.roll_date = f.d", "fut rolls")
def _(spark, sf):
    r = base.roll_table(spark, sf).select("instrument", F.col("roll_date").alias("d"), F.lit(1).alias("r")).distinct()
    return base.futures(spark, sf).join(r, ["instrument", "d"], "left").withColumn("is_roll", F.coalesce("r", F.lit(0)))


_DAILY = ("scenario_id:s strategy:s d:d h_t:f6 n_t:i n_prev:i spot_pnl:f4 fut_pnl:f4 cost_trade:f4 cost_roll:f4 "
          "net_pnl:f4 equity:f4")


@query("W33_W34_daily_pnl", "exposure_id:s strategy:s d:d n_rows:i n_sum:i spot_pnl:f4 fut_pnl:f4 cost_trade:f4 cost_roll:f4 net_pnl:f4", """
    SELECT exposure_id, strategy, d, count(*) AS n_rows, sum(n_t) AS n_sum, sum(spot_pnl) AS spot_pnl, sum(fut_pnl) AS fut_pnl,
           sum(cost_trade) AS cost_trade, sum(cost_roll) AS cost_roll, sum(net_pnl) AS net_pnl FROM tdays GROUP BY 1, 2, 3""",
       "tdays")
def _(spark, sf):
    s = lambda c: F.sum(c).alias(c)
    return base.daily(spark, sf).groupBy("exposure_id", "strategy", "d").agg(
        F.count("*").alias("n_rows"), F.sum("n_t").alias("n_sum"), s("spot_pnl"), s("fut_pnl"), s("cost_trade"),
        s("cost_roll"), s("net_pnl"))


@query("W36_static_mode", "scenario_id:s strategy:s net_pnl_total:f4 turnover_h:f6", """
    SELECT scenario_id, strategy, sum(sp + CASE WHEN pos = pos0 THEN 0 ELSE n * d_fut * 1000 END
             - CASE WHEN pos = pos0 THEN abs(n) * 10 ELSE 0 END
             - CASE WHEN roll_flag = 1 AND pos > pos0 THEN abs(n) * 20 ELSE 0 END) AS net_pnl_total, max(abs(h)) AS turnover_h
    FROM (SELECT *, d_spot * volume_bbl AS sp, -CAST(round_even(h * volume_bbl / 1000, 0) AS BIGINT) AS n
          FROM (SELECT *, CAST(CASE strategy WHEN 'nohedge' THEN 0 WHEN 'naive' THEN 1 WHEN 'ols_static' THEN h_stat
                               ELSE first_value(h_roll) OVER (PARTITION BY scenario_id ORDER BY pos) END AS DOUBLE) AS h
                FROM tdays0, (SELECT unnest(['nohedge', 'naive', 'ols_static', 'ols_roll']) AS strategy)
                QUALIFY true)) GROUP BY 1, 2""".replace("QUALIFY true", ""), "tdays0")
def _(spark, sf):
    return base.results_plan(spark, sf, pnl.PnlConfig(dynamic=False))
