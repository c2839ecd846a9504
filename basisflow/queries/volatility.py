"""Queries of the volatility and correlation recursions. Linear ones have a closed form in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from basisflow.operators import pnl, recursion, returns
from basisflow.queries import base
from basisflow.queries.registry import query
from basisflow.queries.sqlbase import add_cte

W = lambda: Window.partitionBy("series_id").orderBy("d")


_EWMA = """
    SELECT series_id, d, sqrt(0.94::DOUBLE ** i * (first_value(r2) OVER w + 0.06 * (sum(r2 * 0.94::DOUBLE ** (-i)) OVER w - first_value(r2) OVER w))) AS sigma
    FROM (SELECT series_id, d, simple ** 2 AS r2, row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS i FROM rets WHERE simple IS NOT NULL)
    WINDOW w AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL SELECT series_id, d, NULL FROM rets WHERE simple IS NULL"""


@query("W24_ewma_volatility", "series_id:s d:d sigma:f9", _EWMA, "rets")
def _(spark, sf):
    r = base.filled(spark, sf).withColumn("r", returns.simple_return(F.col("value"), W()))
    return recursion.per_series(r, "series_id", "d", ["r"], lambda x: {"sigma": np.sqrt(recursion.ewma_variance(x["r"]))}, ["sigma"])


add_cte("momi", """SELECT *, row_number() OVER (PARTITION BY exposure_id ORDER BY d) - 1 AS i FROM mom0""")
add_cte("seed", """SELECT exposure_id, greatest(var_pop(rs), 1e-10) AS is_, greatest(var_pop(rf), 1e-10) AS if_,
    greatest(var_pop(basis_ret), 1e-10) AS ib FROM momi WHERE i < 252 GROUP BY 1""")


def _lin(x, init, om, al, be):
    """Closed form of v[t] = om + al * x[t-1]**2 + be * v[t-1]."""
    past = (f"coalesce(sum(({om}::DOUBLE + {al}::DOUBLE * {x} ** 2) * {be}::DOUBLE ** (-(i + 1))) OVER "
            "(PARTITION BY exposure_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return f"{be}::DOUBLE ** i * ({init} + {past})"


_EG = lambda x, i0: f"""list_reduce(list_prepend([ln({i0})], list([{x}] ORDER BY i)), lambda acc, e: list_append(acc, greatest(-30, least(5,
    -0.05 + 0.94 * acc[-1] + 0.10 * (abs(greatest(-10, least(10, e[1] / sqrt(greatest(exp(acc[-1]), 1e-10))))) - sqrt(2 / pi()))
    - 0.05 * greatest(-10, least(10, e[1] / sqrt(greatest(exp(acc[-1]), 1e-10))))))))"""
add_cte("egl", f"""SELECT exposure_id, {_EG('rs', 'any_value(is_)')} AS ls, {_EG('rf', 'any_value(if_)')} AS lf FROM momi JOIN seed USING (exposure_id) GROUP BY 1""")
add_cte("egp", "SELECT exposure_id, generate_subscripts(ls, 1) - 1 AS i, sqrt(exp(unnest(ls))) AS egarch_spot_vol_lag1, sqrt(exp(unnest(lf))) AS egarch_fut_vol_lag1 FROM egl")
add_cte("lin", f"""
    SELECT exposure_id, d, i, sqrt({_lin('rs', 'is_', 1e-8, 0.06, 0.92)}) AS garch_spot_vol_lag1, sqrt({_lin('rf', 'if_', 1e-8, 0.06, 0.92)}) AS garch_fut_vol_lag1,
      sqrt({_lin('rs', 'is_', 0.0, 0.06, 0.94)}) AS igarch_spot_vol_lag1, sqrt({_lin('rf', 'if_', 0.0, 0.06, 0.94)}) AS igarch_fut_vol_lag1,
      sqrt({_lin('basis_ret', 'ib', 0.0, 0.06, 0.94)}) AS basis_vol_lag1, {_lin('rs', 'is_', 0.0, 0.03, 0.97)} AS vs, {_lin('rf', 'if_', 0.0, 0.03, 0.97)} AS vf,
      0.97::DOUBLE ** i * coalesce(sum(0.03 * rs * rf * 0.97::DOUBLE ** (-(i + 1))) OVER (PARTITION BY exposure_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dcc_cov_sf_lag1 FROM momi JOIN seed USING (exposure_id)""")


_FEATURES = """
    SELECT l.*, garch_spot_vol_lag1 - garch_fut_vol_lag1 AS garch_vol_spread_lag1, egarch_spot_vol_lag1, egarch_fut_vol_lag1,
      egarch_spot_vol_lag1 - egarch_fut_vol_lag1 AS egarch_vol_spread_lag1,
      greatest(-0.999, least(0.999, dcc_cov_sf_lag1 / sqrt(vs * vf))) AS dcc_corr_sf_lag1, dcc_cov_sf_lag1 / garch_fut_vol_lag1 ** 2 AS dcc_hr_lag1
    FROM lin l JOIN egp USING (exposure_id, i)"""


@query("W25_W28_volatility_features", "exposure_id:s d:d " + " ".join(f"{c}:f6" for c in recursion.VOL_COLS), _FEATURES, "lin egp")
def _(spark, sf):
    m = returns.momentum_features(base.calendar(spark, sf))
    return recursion.volatility_features(m)


add_cte("sig", """SELECT *, sqrt(0.94::DOUBLE ** i * (first_value(r_s ** 2) OVER w + 0.06 * (sum(r_s ** 2 * 0.94::DOUBLE ** (-i)) OVER w - first_value(r_s ** 2) OVER w))) AS sigma_s,
    sqrt(0.94::DOUBLE ** i * (first_value(r_f ** 2) OVER w + 0.06 * (sum(r_f ** 2 * 0.94::DOUBLE ** (-i)) OVER w - first_value(r_f ** 2) OVER w))) AS sigma_f
    FROM (SELECT *, pos - 2 AS i FROM vdays WHERE r_s IS NOT NULL AND r_f IS NOT NULL)
    WINDOW w AS (PARTITION BY exposure_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
_F120 = "(PARTITION BY exposure_id ORDER BY pos ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"
add_cte("ccc", f"""SELECT exposure_id, d, pos, CASE WHEN count(r_f) OVER {_F120} >= 60 THEN corr(r_s, r_f) OVER {_F120} END * sigma_s / nullif(sigma_f, 0) AS h
    FROM sig""")


@query("W18_constant_correlation_ratio", "exposure_id:s d:d h:f7",
       "SELECT v.exposure_id, v.d, c.h FROM vdays v LEFT JOIN ccc c USING (exposure_id, pos)", "vdays ccc")
def _(spark, sf):
    return recursion.with_ccc(base.days(spark, sf)).withColumn("h", F.col("h_ccc_120"))


@query("W23_precomputed_strategy", "scenario_id:s h_sum:f5 n_days:i", """
    SELECT scenario_id, count(*) AS n_days, sum(greatest(-3, least(3, coalesce(last_h, 0)))) AS h_sum FROM (
      SELECT b.scenario_id, v.pos, last_value(c.h IGNORE NULLS) OVER (PARTITION BY b.scenario_id ORDER BY v.pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_h
      FROM bounds b JOIN vdays v ON v.exposure_id = b.exposure_id AND v.pos BETWEEN b.pos0 AND b.pos1
      LEFT JOIN ccc c ON c.exposure_id = v.exposure_id AND c.pos = v.pos) GROUP BY 1""", "bounds vdays ccc")
def _(spark, sf):
    s = [recursion.ccc_garch()]
    rows = pnl.trade_days(base.trades(spark, sf), base.calendar(spark, sf), base.days(spark, sf), s)
    return rows.groupBy("scenario_id").agg(F.sum("ccc_garch__h").alias("h_sum"), F.count("*").alias("n_days"))


add_cte("zs", """SELECT *, row_number() OVER (PARTITION BY exposure_id ORDER BY pos) - 1 AS k FROM (
    SELECT exposure_id, pos, r_s / sigma_s AS z1, r_f / sigma_f AS z2, sigma_s, sigma_f FROM sig WHERE sigma_s > 0 AND sigma_f > 0)""")
add_cte("smom", "SELECT exposure_id, var_pop(z1) AS s11, var_pop(z2) AS s22, covar_pop(z1, z2) AS s12 FROM zs WHERE k < 252 GROUP BY 1")
_Q = lambda c, p: (f"(0.98::DOUBLE ** k * ({c} + coalesce(sum((0.01 * {c} + 0.01 * {p}) * 0.98::DOUBLE ** (-(k + 1))) OVER "
                   "(PARTITION BY exposure_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))")


_DCC = f"""
    SELECT v.exposure_id, v.d, CASE WHEN rho IS NULL OR z.k IS NULL OR v.pos = 1 THEN 0 ELSE greatest(-3, least(3, z.sigma_s / z.sigma_f * greatest(-0.999, least(0.999, rho)))) END AS h
    FROM vdays v LEFT JOIN (SELECT *, {_Q('s12', 'z1 * z2')} / sqrt({_Q('s11', 'z1 ** 2')} * {_Q('s22', 'z2 ** 2')}) AS rho
                            FROM zs JOIN smom USING (exposure_id)) z USING (exposure_id, pos)"""


@query("W29_dynamic_correlation_ratio", "exposure_id:s d:d h:f7", _DCC, "vdays zs smom")
def _(spark, sf):
    return recursion.with_dcc(base.days(spark, sf)).withColumn("h", F.col("h_dcc"))


add_cte("zlast", "SELECT *, row_number() OVER (PARTITION BY exposure_id ORDER BY pos DESC) AS age FROM zs")


@query("W30_grid_choice", "exposure_id:s a:f4 b:f4 rho:f7", """
    SELECT exposure_id, a, b, rho FROM (SELECT *, row_number() OVER (PARTITION BY exposure_id ORDER BY ln(1 - least(0.999, rho ** 2)) DESC, a, b) AS rn FROM (
      SELECT exposure_id, a, b, greatest(-0.999, least(0.999, q12 / sqrt(q11 * q22))) AS rho FROM (
        SELECT exposure_id, a, b, b ** (n - 1) * s11 + (1 - a - b) * s11 * sw + a * m11 AS q11, b ** (n - 1) * s22 + (1 - a - b) * s22 * sw + a * m22 AS q22,
               b ** (n - 1) * s12 + (1 - a - b) * s12 * sw + a * m12 AS q12
        FROM (SELECT exposure_id, a, b, sum(b ** (age - 2) * z1 ** 2) AS m11, sum(b ** (age - 2) * z2 ** 2) AS m22, sum(b ** (age - 2) * z1 * z2) AS m12,
                     sum(b ** (age - 2)) AS sw FROM zlast, (SELECT unnest([0.005, 0.01, 0.02])::DOUBLE AS a), (SELECT unnest([0.95, 0.97, 0.98])::DOUBLE AS b)
              WHERE age BETWEEN 2 AND 252 AND a + b < 0.999 GROUP BY 1, 2, 3)
        JOIN (SELECT exposure_id, var_samp(z1) AS s11, var_samp(z2) AS s22, covar_samp(z1, z2) AS s12, count(*) AS n FROM zlast WHERE age <= 252 GROUP BY 1)
        USING (exposure_id)))) WHERE rn = 1""", "zlast")
def _(spark, sf):
    d = recursion.sigma_columns(base.days(spark, sf)).where("sigma_s > 0 AND sigma_f > 0 AND r_s IS NOT NULL AND r_f IS NOT NULL")
    z = d.select("exposure_id", "pos", (F.col("r_s") / F.col("sigma_s")).alias("z1"), (F.col("r_f") / F.col("sigma_f")).alias("z2"))
    return recursion.grid_choice(z, "exposure_id", "pos", [0.005, 0.01, 0.02], [0.95, 0.97, 0.98])


@query("W31_grid_fitted_volatility", "series_id:s d:d sigma:f8", """
    WITH x AS (SELECT series_id, d, simple * 100 AS x, row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS i FROM rets WHERE simple IS NOT NULL),
    m AS (SELECT series_id, var_pop(x) AS level FROM x GROUP BY 1 HAVING count(*) >= 750),
    g AS (SELECT a, b FROM (SELECT unnest([0.03, 0.05, 0.08, 0.12])::DOUBLE AS a), (SELECT unnest([0.80, 0.85, 0.90, 0.94])::DOUBLE AS b) WHERE a + b < 0.999),
    v AS (SELECT series_id, d, x, a, b, b ** i * (level + coalesce(sum((level * (1 - a - b) + a * x ** 2) * b ** (-(i + 1))) OVER
            (PARTITION BY series_id, a, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS v FROM x JOIN m USING (series_id), g),
    best AS (SELECT series_id, arg_max({'a': a, 'b': b}, l) AS p FROM (SELECT series_id, a, b, -0.5 * sum(ln(2 * pi() * v) + x ** 2 / v) AS l FROM v GROUP BY 1, 2, 3)
             GROUP BY 1)
    SELECT r.series_id, r.d, sqrt(v.v) / 100 AS sigma FROM rets r LEFT JOIN (SELECT v.* FROM v JOIN best USING (series_id) WHERE v.a = p.a AND v.b = p.b) v
    USING (series_id, d)""", "rets")
def _(spark, sf):
    r = base.filled(spark, sf).withColumn("r", returns.simple_return(F.col("value"), W()))
    return recursion.per_series(r, "series_id", "d", ["r"], lambda x: {"sigma": recursion.garch_grid_fit(x["r"])}, ["sigma"])


# ---- the same recursions over chunks of a series ----
@query("R_ewma_in_chunks", "series_id:s d:d sigma:f9", _EWMA, "rets")
def _(spark, sf):
    r = base.filled(spark, sf).withColumn("r", returns.simple_return(F.col("value"), W()))
    v = recursion.ewma_in_chunks(r, "series_id", "d", "r", "v", rows=200)
    return v.withColumn("sigma", F.sqrt("v"))


@query("R_features_in_chunks", "exposure_id:s d:d " + " ".join(f"{c}:f6" for c in recursion.VOL_COLS if not c.startswith("egarch")), _FEATURES, "lin egp")
def _(spark, sf):
    return recursion.linear_features_in_chunks(returns.momentum_features(base.calendar(spark, sf)), rows=300)


@query("R_correlation_in_chunks", "exposure_id:s d:d h:f7", _DCC, "vdays zs smom")
def _(spark, sf):
    return recursion.with_dcc(base.days(spark, sf), rows=250).withColumn("h", F.col("h_dcc"))
