"""Shared table expressions of the oracle SQL, one per intermediate table, in dependency order."""

from __future__ import annotations

import re

EXPOSURES = "('N', '1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"

CTES: dict[str, str] = {
    "panel": """
        SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS d,
               CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)
                    // CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS DOUBLE) / 10000.0::DOUBLE AS price
        FROM lineitem GROUP BY 1, 2
        UNION ALL
        SELECT o_orderpriority, CAST(o_orderdate AS DATE),
               CAST(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) // (count(*) * 100) AS DOUBLE)
               / 10000.0::DOUBLE
        FROM orders GROUP BY 1, 2""",
    "raw": """
        SELECT series_id, d, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 53 = 0 THEN 0.0
                                  WHEN n % 97 = 0 THEN -price ELSE price END AS price
        FROM (SELECT *, date_diff('day', DATE '1970-01-01', d) AS n FROM panel)""",
    "days": "SELECT DISTINCT d FROM raw",
    "grid": """
        SELECT s.series_id, y.d FROM (SELECT series_id, min(d) AS d0 FROM raw GROUP BY 1) s
        JOIN days y ON y.d >= s.d0""",
    "filled": """
        SELECT series_id, d, raw, updated,
               last_value(core IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY d
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
        FROM (SELECT g.series_id, g.d, r.price AS raw, nullif(r.price, 0) AS core,
                     CASE WHEN r.price IS NOT NULL AND r.price <> 0 THEN 1 ELSE 0 END AS updated
              FROM grid g LEFT JOIN raw r USING (series_id, d))""",
    "uni": f"""
        SELECT s.series_id AS exposure_id, d, s.value AS spot, f.value AS cl1, n.value AS cl2,
               s.updated AS spot_updated, f.updated AS cl1_updated, f.updated AS tradable
        FROM (SELECT * FROM filled WHERE series_id IN {EXPOSURES} AND value IS NOT NULL) s
        JOIN (SELECT d, value, updated FROM filled WHERE series_id = 'A' AND value IS NOT NULL) f USING (d)
        LEFT JOIN (SELECT d, value FROM filled WHERE series_id = 'R') n USING (d)""",
    "fut": """
        SELECT 'CL' AS instrument, d, max(CASE WHEN series_id = 'A' THEN value END) AS cl1,
               max(CASE WHEN series_id = 'R' THEN value END) AS cl2
        FROM filled WHERE series_id IN ('A', 'R') GROUP BY d""",
    "tradable_days": """
        SELECT instrument, d, row_number() OVER (PARTITION BY instrument ORDER BY d) - 1 AS pos
        FROM (SELECT *, lag(cl1) OVER (PARTITION BY instrument ORDER BY d) AS p FROM fut)
        WHERE cl1 IS NOT NULL AND (p IS NULL OR cl1 <> p)""",
    "anchors": """
        SELECT instrument, m + INTERVAL 24 DAY AS anchor_25
        FROM (SELECT instrument, unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)),
                     INTERVAL 1 MONTH)) AS m FROM fut GROUP BY 1)
        WHERE m + INTERVAL 24 DAY BETWEEN (SELECT min(d) FROM tradable_days) AND (SELECT max(d) FROM tradable_days)""",
    "rolls": """
        SELECT a.instrument, strftime(a.anchor_25, '%Y-%m') AS month, CAST(a.anchor_25 AS DATE) AS anchor_25,
               l.d AS ltd, r.d AS roll_date
        FROM anchors a
        ASOF JOIN tradable_days t ON a.instrument = t.instrument AND a.anchor_25 >= t.d
        JOIN tradable_days l ON l.instrument = a.instrument AND l.pos = greatest(t.pos - 3, 0)
        JOIN tradable_days r ON r.instrument = a.instrument AND r.pos = greatest(t.pos - 5, 0)""",
    "series": """
        SELECT instrument, d, f_mark, roll_flag,
               CASE WHEN rn > 1 THEN (cl1 - coalesce(last_value(f_mark IGNORE NULLS) OVER (PARTITION BY instrument
                   ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cl1)) * 1000 END AS pnl_1c,
               CASE WHEN roll_flag = 1 AND cl2 IS NOT NULL THEN 'CL2' ELSE 'CL1' END AS held_leg
        FROM (SELECT *, CASE WHEN roll_flag = 1 THEN coalesce(cl2, cl1) ELSE cl1 END AS f_mark
              FROM (SELECT f.*, row_number() OVER (PARTITION BY instrument ORDER BY d) AS rn,
                           CASE WHEN cl1 IS NOT NULL
                                 AND row_number() OVER (PARTITION BY instrument ORDER BY d) > 1
                                 AND d IN (SELECT roll_date FROM rolls) THEN 1 ELSE 0 END AS roll_flag
                    FROM fut f))""",
    "cal": """
        SELECT *, row_number() OVER w AS idx, sum(valid) OVER w AS pos
        FROM (SELECT u.*, s.f_mark AS fut, s.pnl_1c, s.roll_flag,
                     CASE WHEN u.spot IS NOT NULL AND s.f_mark IS NOT NULL THEN 1 ELSE 0 END AS valid
              FROM uni u JOIN series s USING (d))
        WINDOW w AS (PARTITION BY exposure_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "vdays": """
        SELECT *, coalesce(spot - lag(spot) OVER w, 0) AS d_spot, coalesce(fut - lag(fut) OVER w, 0) AS d_fut,
               spot / nullif(lag(spot) OVER w, 0) - 1 AS r_s, fut / nullif(lag(fut) OVER w, 0) - 1 AS r_f
        FROM cal WHERE valid = 1 WINDOW w AS (PARTITION BY exposure_id ORDER BY d)""",
    "requests": """
        SELECT o_orderkey AS trade_no, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderpriority END AS exposure_id,
               CAST(o_orderdate AS DATE) AS start_date, CAST(20 + o_orderkey % 21 AS INT) AS horizon_days_target,
               500000 + (o_orderkey * 7919) % 1000001 AS volume_bbl, 'C' || o_custkey AS company_id,
               ['SMALL', 'MEDIUM', 'LARGE'][o_custkey % 3 + 1] AS company_size
        FROM orders""",
    "daymap": """
        SELECT g.exposure_id, g.cal_d, c.d AS trade_d
        FROM (SELECT exposure_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS cal_d
              FROM cal GROUP BY 1) g
        ASOF JOIN cal c ON g.exposure_id = c.exposure_id AND g.cal_d >= c.d""",
    "realised": """
        SELECT r.*, coalesce(m.trade_d, start_date + horizon_days_target) AS end_date,
               date_diff('day', start_date, CAST(coalesce(m.trade_d, start_date + horizon_days_target) AS DATE))
                   AS horizon_days_realized,
               CASE WHEN m.trade_d IS NULL OR date_diff('day', start_date, m.trade_d) < 15 THEN 'REJECTED'
                    WHEN date_diff('day', start_date, m.trade_d) = horizon_days_target THEN 'OK'
                    ELSE 'SHORTENED' END AS data_coverage_flag
        FROM requests r LEFT JOIN daymap m
          ON m.exposure_id = r.exposure_id AND m.cal_d = r.start_date + r.horizon_days_target""",
    "trades": """
        SELECT 'T' || trade_no AS scenario_id, * EXCLUDE (end_date, data_coverage_flag), CAST(end_date AS DATE) AS end_date,
               data_coverage_flag, CASE WHEN trade_no % 2 = 0 THEN 'company' ELSE 'baseline' END AS scenario_kind
        FROM realised WHERE data_coverage_flag <> 'REJECTED'""",
    "bounds": """
        SELECT t.*, s.pos + 1 - s.valid AS pos0, e.pos AS pos1
        FROM trades t JOIN cal s ON s.exposure_id = t.exposure_id AND s.d = t.start_date
        JOIN cal e ON e.exposure_id = t.exposure_id AND e.d = t.end_date WHERE e.idx >= s.idx""",
    "hratio": """
        SELECT *, lag(h_roll) OVER (PARTITION BY exposure_id ORDER BY pos) AS h_roll_before
        FROM (SELECT *, CASE WHEN b_roll IS NULL THEN 0 ELSE greatest(-2, least(2, b_roll)) END AS h_roll,
                     CASE WHEN b_stat IS NULL THEN 0 ELSE greatest(-2, least(2, b_stat)) END AS h_stat
              FROM (SELECT *, CASE WHEN rn >= 30 AND rxx - rx * rx / rn <> 0
                                   THEN (rxy - rx * ry / rn) / (rxx - rx * rx / rn) END AS b_roll,
                           CASE WHEN hn >= 60 AND hxx - hx * hx / hn <> 0
                                THEN (hxy - hx * hy / hn) / (hxx - hx * hx / hn) END AS b_stat
                    FROM (SELECT v.*, count(x) OVER r AS rn, sum(x) OVER r AS rx, sum(y) OVER r AS ry,
                                 sum(x * x) OVER r AS rxx, sum(x * y) OVER r AS rxy,
                                 count(x) OVER h AS hn, sum(x) OVER h AS hx, sum(y) OVER h AS hy,
                                 sum(x * x) OVER h AS hxx, sum(x * y) OVER h AS hxy
                          FROM (SELECT *, CASE WHEN r_s IS NOT NULL AND r_f IS NOT NULL THEN r_f END AS x,
                                       CASE WHEN r_s IS NOT NULL AND r_f IS NOT NULL THEN r_s END AS y FROM vdays) v
                          WINDOW r AS (PARTITION BY exposure_id ORDER BY pos ROWS BETWEEN 119 PRECEDING AND CURRENT ROW),
                                 h AS (PARTITION BY exposure_id ORDER BY pos ROWS BETWEEN 2519 PRECEDING AND 1 PRECEDING))))""",
    "tdays0": """
        SELECT b.scenario_id, b.exposure_id, b.pos0, v.pos, v.d, v.spot, v.fut, v.roll_flag, b.volume_bbl,
               CASE WHEN v.pos = b.pos0 THEN 0 ELSE v.d_spot END AS d_spot,
               CASE WHEN v.pos = b.pos0 THEN 0 ELSE v.d_fut END AS d_fut,
               v.h_roll, v.h_roll_before, s.h_stat
        FROM bounds b JOIN hratio s ON s.exposure_id = b.exposure_id AND s.pos = b.pos0
        JOIN hratio v ON v.exposure_id = b.exposure_id AND v.pos BETWEEN b.pos0 AND b.pos1""",
    "tdays": """
        SELECT *, sum(net_pnl) OVER (PARTITION BY scenario_id, strategy ORDER BY pos
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity
        FROM (SELECT *, d_spot * volume_bbl AS spot_pnl, n_prev * d_fut * 1000 AS fut_pnl,
                     abs(n_t - n_prev) * 10.0 AS cost_trade,
                     CASE WHEN roll_flag = 1 THEN abs(n_prev) * 20.0 ELSE 0 END AS cost_roll,
                     d_spot * volume_bbl + n_prev * d_fut * 1000 - abs(n_t - n_prev) * 10.0
                       - CASE WHEN roll_flag = 1 THEN abs(n_prev) * 20.0 ELSE 0 END AS net_pnl
              FROM (SELECT *, -CAST(round_even(h_t * volume_bbl / 1000, 0) AS BIGINT) AS n_t,
                           -CAST(round_even(h_prev * volume_bbl / 1000, 0) AS BIGINT) AS n_prev
                    FROM (SELECT *, CAST(CASE strategy WHEN 'nohedge' THEN 0 WHEN 'naive' THEN 1
                                    WHEN 'ols_static' THEN h_stat ELSE h_roll END AS DOUBLE) AS h_t,
                                 CAST(CASE WHEN pos = pos0 THEN 0 ELSE CASE strategy WHEN 'nohedge' THEN 0
                                    WHEN 'naive' THEN 1 WHEN 'ols_static' THEN h_stat ELSE h_roll_before END END
                                    AS DOUBLE) AS h_prev
                          FROM tdays0, (SELECT unnest(['nohedge', 'naive', 'ols_static', 'ols_roll']) AS strategy))))""",
    "results": """
        SELECT t.scenario_id, t.exposure_id, t.scenario_kind, t.start_date, t.end_date, t.horizon_days_target,
               t.horizon_days_realized, t.company_id, t.company_size, x.strategy, 1 AS dynamic, 1 AS mode_roll,
               CAST(t.volume_bbl AS DOUBLE) AS volume_bbl, x.* EXCLUDE (scenario_id, strategy)
        FROM trades t JOIN (
            SELECT scenario_id, strategy, count(*) AS n_days, sum(spot_pnl) AS spot_pnl_total,
                   sum(fut_pnl) AS fut_pnl_total, sum(cost_trade) AS cost_trade_total,
                   sum(cost_roll) AS cost_roll_total, sum(net_pnl) AS net_pnl_total,
                   sum(abs(n_t - n_prev)) AS turnover_contracts, sum(abs(h_t - h_prev)) AS turnover_h,
                   sum(abs(n_t - n_prev)) AS trade_contracts,
                   sum(CASE WHEN roll_flag = 1 THEN 2 * abs(n_t) ELSE 0 END) AS roll_contracts,
                   max(abs(n_t)) AS max_abs_contracts, min(equity - peak) AS mdd_equity
            FROM (SELECT *, max(equity) OVER (PARTITION BY scenario_id, strategy ORDER BY pos
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM tdays)
            GROUP BY 1, 2) x USING (scenario_id)""",
}


def _needs(text: str, have: list[str]) -> list[str]:
    return [n for n in have if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text) or re.search(rf",\s*{n}\b", text)]


def add_cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_(names: str) -> str:
    """WITH clause of the named expressions and all they build on."""
    wanted: list[str] = []

    def visit(n: str) -> None:
        if n in wanted:
            return
        for m in _needs(CTES[n], [k for k in CTES if k != n]):
            visit(m)
        wanted.append(n)
    for n in names.split():
        visit(n)
    if not wanted:
        return ""
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
