"""Queries of the strategies that see a whole trade path."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from basisflow.operators import paths, pnl
from basisflow.queries import base
from basisflow.queries.registry import query
from basisflow.queries.sqlbase import add_cte

# returns inside the trade window: the first day has none
add_cte("tz", """SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY pos) - 1 AS k FROM (
    SELECT b.scenario_id, v.pos, v.r_s / s.sigma_s AS z1, v.r_f / s.sigma_f AS z2, s.sigma_s, s.sigma_f
    FROM bounds b JOIN vdays v ON v.exposure_id = b.exposure_id AND v.pos > b.pos0 AND v.pos <= b.pos1
    JOIN sig s ON s.exposure_id = v.exposure_id AND s.pos = v.pos WHERE s.sigma_s > 0 AND s.sigma_f > 0)""")
add_cte("tmom", """SELECT scenario_id, var_pop(z1) AS s11, var_pop(z2) AS s22, covar_pop(z1, z2) AS s12 FROM tz WHERE k < 252
    GROUP BY 1 HAVING count(*) >= 5""")


def _q(c: str, p: str) -> str:
    """Closed form of the recursion within a trade."""
    return (f"(0.98::DOUBLE ** k * ({c} + coalesce(sum((0.01 * {c} + 0.01 * {p}) * 0.98::DOUBLE ** (-(k + 1))) OVER "
            "(PARTITION BY scenario_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))")


@query("W29_window_restart", "scenario_id:s n_days:i h_sum:f5 h_max:f6 h_min:f6", f"""
    SELECT b.scenario_id, pos1 - pos0 + 1 AS n_days, coalesce(h_sum, 0) AS h_sum, greatest(coalesce(h_max, 0), 0) AS h_max, least(coalesce(h_min, 0), 0) AS h_min
    FROM bounds b LEFT JOIN (
      SELECT scenario_id, sum(h) AS h_sum, max(h) AS h_max, min(h) AS h_min FROM (
        SELECT scenario_id, CASE WHEN q11 > 0 AND q22 > 0
                 THEN greatest(-3, least(3, sigma_s / sigma_f * greatest(-0.999, least(0.999, q12 / sqrt(q11 * q22))))) ELSE 0 END AS h FROM (
          SELECT *, {_q('s12', 'z1 * z2')} AS q12, {_q('s11', 'z1 ** 2')} AS q11, {_q('s22', 'z2 ** 2')} AS q22 FROM tz JOIN tmom USING (scenario_id)))
      GROUP BY 1) USING (scenario_id)""", "bounds tz tmom")
def _(spark, sf):
    rows = pnl.trade_days(base.trades(spark, sf), base.calendar(spark, sf), base.days(spark, sf), [paths.dcc_window()])
    h = F.col("dcc_window__h")
    return rows.groupBy("scenario_id").agg(F.count("*").alias("n_days"), F.sum(h).alias("h_sum"), F.max(h).alias("h_max"), F.min(h).alias("h_min"))


def trailing_stop(share: float = 0.02, calm: float = 0.6) -> paths.PathStrategy:
    """Hedges in part until the spot price has fallen by ``share`` from the highest of the trade, then in full for as long as that lasts."""

    def ratios(trades: paths.Trades) -> np.ndarray:
        spot = trades.padded(trades["spot"])
        peak = np.fmax.accumulate(spot, axis=0)
        return trades.flat(np.where(spot < peak - share * np.abs(peak), 1.0, calm))

    return paths.path_strategy("trailing_stop", ratios)


@query("U1_path_strategy", "scenario_id:s n_days:i net_pnl_total:f4 turnover_contracts:f4 turnover_h:f6 max_abs_contracts:i mdd_equity:f4", """
    WITH p AS (SELECT *, max(spot) OVER (PARTITION BY scenario_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM tdays0),
    h AS (SELECT *, CASE WHEN spot < top - 0.02 * abs(top) THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS h_t FROM p),
    l AS (SELECT *, coalesce(lag(h_t) OVER (PARTITION BY scenario_id ORDER BY pos), 0) AS h_prev FROM h),
    n AS (SELECT *, -CAST(round_even(h_t * volume_bbl / 1000, 0) AS BIGINT) AS n_t, -CAST(round_even(h_prev * volume_bbl / 1000, 0) AS BIGINT) AS n_prev FROM l),
    x AS (SELECT *, d_spot * volume_bbl + n_prev * d_fut * 1000 - abs(n_t - n_prev) * 10.0
                    - CASE WHEN roll_flag = 1 THEN abs(n_prev) * 20.0 ELSE 0 END AS net FROM n),
    e AS (SELECT *, sum(net) OVER (PARTITION BY scenario_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM x),
    m AS (SELECT *, max(equity) OVER (PARTITION BY scenario_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM e)
    SELECT scenario_id, count(*) AS n_days, sum(net) AS net_pnl_total, sum(abs(n_t - n_prev)) AS turnover_contracts, sum(abs(h_t - h_prev)) AS turnover_h,
           max(abs(n_t)) AS max_abs_contracts, min(equity - peak) AS mdd_equity FROM m GROUP BY 1""", "tdays0")
def _(spark, sf):
    s = [trailing_stop()]
    rows = pnl.trade_days(base.trades(spark, sf), base.calendar(spark, sf), base.days(spark, sf), s)
    return pnl.summaries(rows, s, ["scenario_id"])
