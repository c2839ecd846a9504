"""Queries of step-log and episode analytics, splits and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basisflow.operators import episodes, metrics, pnl, report, splits, windows
from basisflow.plans.intervals import points_in_intervals
from basisflow.plans.lineage import written
from basisflow.plans.quantiles import exact_quantiles, exact_quantiles_of
from basisflow.queries import base
from basisflow.queries.registry import query
from basisflow.queries.sqlbase import add_cte
from basisflow.sources import market

add_cte("slog", """
    SELECT t.*, d.pnl_1c0, greatest(abs((t.spot - coalesce(t.d_spot, 0)) * t.volume_bbl), 1.0) AS notional,
           CASE WHEN t.pos = t.pos0 THEN 0 ELSE coalesce(d.pnl_1c0, 0) END AS pnl_1c, b.scenario_kind,
           first_value(greatest(abs((t.spot - coalesce(t.d_spot, 0)) * t.volume_bbl), 1.0)) OVER (PARTITION BY t.scenario_id, t.strategy ORDER BY t.pos) AS notional0,
           max(equity) OVER (PARTITION BY t.scenario_id, t.strategy ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
    FROM tdays t JOIN (SELECT exposure_id, pos, pnl_1c AS pnl_1c0 FROM vdays) d USING (exposure_id, pos) JOIN trades b USING (scenario_id)""")
_EP = "PARTITION BY scenario_id, strategy"
_RUN = f"({_EP} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("W48_day_counters", "exposure_id:s day_in_episode:i n:i elapsed:f6 remaining:f6", f"""
    SELECT exposure_id, k AS day_in_episode, count(*) AS n, sum(k / greatest(c - 1, 1)) AS elapsed, sum(1 - k / greatest(c - 1, 1)) AS remaining FROM (
      SELECT *, row_number() OVER ({_EP} ORDER BY pos) - 1 AS k, count(*) OVER ({_EP}) AS c FROM slog) GROUP BY 1, 2""", "slog")
def _(spark, sf):
    d = episodes.day_counters(base.step_log(spark, sf))
    return d.groupBy("exposure_id", "day_in_episode").agg(F.count("*").alias("n"), F.sum("elapsed_frac").alias("elapsed"),
                                                           F.sum("remaining_frac").alias("remaining"))


@query("W38_risk_attribution", "scenario_id:s strategy:s lpm_sum:f7 delta_sum:f7 vol_last:f7 cost_last:f7 score_sum:f7", f"""
    SELECT scenario_id, strategy, sum(lpm) AS lpm_sum, sum(lpm - pl) AS delta_sum, arg_max(vol, pos) AS vol_last, arg_max(cost, pos) AS cost_last,
           sum(-(0.5 * (0.7 * lpm + 0.3 * (lpm - pl)) + 0.35 * vol + 0.15 * cost)) AS score_sum
    FROM (SELECT *, coalesce(lag(lpm) OVER ({_EP} ORDER BY pos), 0) AS pl FROM (
      SELECT *, greatest(-(sum(p) OVER {_RUN}) / notional0, 0) ** 2 AS lpm, sum((p / notional) ** 2) OVER {_RUN} AS vol,
             sum(cost_trade) OVER {_RUN} / notional0 AS cost FROM (SELECT *, spot_pnl + fut_pnl - cost_trade AS p FROM slog))) GROUP BY 1, 2""", "slog")
def _(spark, sf):
    log = base.step_log(spark, sf).withColumns({"pnl": F.col("spot_pnl") + F.col("fut_pnl") - F.col("cost_trade"), "decision_cost": F.col("cost_trade")})
    r = episodes.risk_attribution(log)
    return r.groupBy("scenario_id", "strategy").agg(
        F.sum("episode_lpm").alias("lpm_sum"), F.sum("delta_lpm").alias("delta_sum"), F.max_by("running_vol", "pos").alias("vol_last"),
        F.max_by("cum_cost", "pos").alias("cost_last"), F.sum("score").alias("score_sum"))


@query("W39_rolling_risk", "scenario_id:s strategy:s var_sum:f7 lpm_sum:f7", f"""
    SELECT scenario_id, strategy, sum(v) AS var_sum, sum(l) AS lpm_sum FROM (
      SELECT *, CASE WHEN count(r) OVER w >= 2 THEN var_samp(r) OVER w ELSE 0 END AS v, greatest(-r, 0) ** 2 AS l
      FROM (SELECT *, net_pnl / notional AS r FROM slog) WINDOW w AS ({_EP} ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY 1, 2""", "slog")
def _(spark, sf):
    log = base.step_log(spark, sf).withColumn("r", F.col("net_pnl") / F.col("notional"))
    r = episodes.rolling_risk(log, "r")
    return r.groupBy("scenario_id", "strategy").agg(F.sum("roll_var").alias("var_sum"), F.sum("step_lpm").alias("lpm_sum"))


@query("W40_path_signals", "scenario_id:s strategy:s n_negative:i n_convex:i recent_last:f4 z_max:f1", f"""
    SELECT scenario_id, strategy, sum(an) AS n_negative, sum(cv) AS n_convex, arg_max(rs, pos) AS recent_last, max(z) AS z_max FROM (
      SELECT *, CASE WHEN count(p) OVER f >= 3 AND max(p) OVER f < 0 THEN 1 ELSE 0 END AS an, sum(p) OVER f AS rs,
             CASE WHEN count(p) OVER f >= 3 AND min(st) OVER g > 0 AND st >= avg(st) OVER g THEN 1 ELSE 0 END AS cv,
             (spot - avg(spot) OVER z) / greatest(stddev_pop(spot) OVER z, 1e-12) AS z
      FROM (SELECT *, net_pnl AS p, net_pnl AS st FROM slog)
      WINDOW f AS ({_EP} ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), g AS ({_EP} ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
             z AS ({_EP} ORDER BY pos ROWS BETWEEN 252 PRECEDING AND CURRENT ROW)) GROUP BY 1, 2""", "slog")
def _(spark, sf):
    names = [s.name for s in base.STRATEGIES]
    z = episodes.zscore_peaks(windows.bounds(base.trades(spark, sf), base.calendar(spark, sf)), base.days(spark, sf), "spot")
    z = written(z, "zscores")  # Spark broadcasts it or not by its true size
    r = episodes.signals_of(base.trade_days(spark, sf), {s: f"{s}__net" for s in names}, 3, ["scenario_id"])
    flat = r.groupBy("scenario_id", "exposure_id", "pos0", "pos1").agg(*[a.alias(f"{s}__{k}") for s in names for k, a in (
        ("n_negative", F.sum(f"{s}__all_negative")), ("n_convex", F.sum(f"{s}__convex_rise")), ("recent_last", F.max_by(f"{s}__recent_sum", "pos")))])
    flat = flat.join(z, ["exposure_id", "pos0"]).withColumn("z_max", F.get("z_peaks", (F.col("pos1") - F.col("pos0")).cast("int")))
    out = pnl.stack(flat, ["scenario_id", "z_max"], base.STRATEGIES, {k: k for k in ("n_negative", "n_convex", "recent_last")})
    return out.select("scenario_id", "strategy", "n_negative", "n_convex", "recent_last", "z_max")


_EK = ["scenario_id", "scenario_kind", "exposure_id", "strategy"]
add_cte("eps", """
    SELECT scenario_id, scenario_kind, exposure_id, strategy, count(*) AS steps, sum(net_pnl) AS total_pnl, sum(spot_pnl) AS physical_pnl,
      sum(fut_pnl) AS futures_pnl, sum(cost_trade) AS decision_cost, sum(cost_roll) AS roll_cost, avg(h_t) AS mean_h, max(h_t) AS max_h, min(h_t) AS min_h,
      stddev_pop(h_t) AS h_std, avg(abs(h_t)) AS h_abs_mean, avg(CAST(h_t <> 0 AS INT)) AS h_nonzero_share, sum(abs(h_t - h_prev)) AS turnover_h,
      sum(abs(n_t - n_prev)) AS turnover_contracts, sum(roll_flag) AS roll_days, arg_max(equity, pos) AS final_equity, min(equity - peak) AS mdd,
      sum(spot_pnl) AS no_hedge_pnl, sum(nv * pnl_1c) AS naive_fut_pnl, sum(spot_pnl + nv * pnl_1c) AS naive_pnl,
      avg(CAST(net_pnl > spot_pnl + nv * pnl_1c AS INT)) AS win_vs_naive
    FROM (SELECT *, -round_even(volume_bbl / 1000, 0) AS nv FROM slog) GROUP BY 1, 2, 3, 4""")


def _eps_plan(spark, sf):
    return episodes.episode_summaries(base.steps(spark, sf), _EK[:3], base.STRATEGIES)


def _eps(spark, sf):
    return base._once(spark, sf, "episodes", lambda: _eps_plan(spark, sf))


@query("A9_J20_episode_summary", "scenario_id:s strategy:s steps:i total_pnl:f4 futures_pnl:f4 decision_cost:f4 roll_cost:f4 mean_h:f7 max_h:f7 h_std:f7 "
       "h_nonzero_share:f7 turnover_h:f6 turnover_contracts:f4 roll_days:i final_equity:f4 mdd:f4 no_hedge_pnl:f4 naive_fut_pnl:f4 naive_pnl:f4",
       "SELECT * FROM eps", "eps")
def _(spark, sf):
    return _eps_plan(spark, sf)


def _evaluated(spark, sf):
    d = base.step_log(spark, sf).where("pos > pos0")
    n = -F.col("n_t")
    np_ = F.when(F.col("pos") == F.col("pos0") + 1, 0).otherwise(-F.col("n_prev"))
    dn = F.abs(n - np_)
    cost = dn * 10.0 + F.when(F.col("roll_flag") != 0, F.abs(np_) * 20.0).otherwise(0.0)
    d = d.withColumns({"dn": dn, "cost": cost, "pnl": F.col("spot_pnl") + np_ * F.col("pnl_1c") - cost,
                       "notional": F.abs((F.col("spot") - F.col("d_spot")) * F.col("volume_bbl"))})
    return d


add_cte("evald", """SELECT *, spot_pnl + np * pnl_1c - cost AS pnl FROM (SELECT *, abs(n - np) AS dn, abs(n - np) * 10.0 + CASE WHEN roll_flag <> 0
    THEN abs(np) * 20.0 ELSE 0 END AS cost FROM (SELECT * EXCLUDE (notional), -n_t AS n, CASE WHEN pos = pos0 + 1 THEN 0 ELSE -n_prev END AS np,
    abs((spot - d_spot) * volume_bbl) AS notional FROM slog WHERE pos > pos0))""")
add_cte("evals", """
    SELECT scenario_id, strategy, sum(pnl) AS pnl_net_sum, sum(cost) AS cost_sum, sum(dn) AS turnover_contract, max(dd) AS mdd, avg(r) AS mean_daily_return,
      var_samp(r) AS var_daily, sqrt(avg(least(r, 0) ** 2)) AS dd_daily, any_value(v) AS var95_loss, avg(-r) FILTER (-r >= v) AS es95_loss
    FROM (SELECT *, quantile_cont(-r, 0.95) OVER (PARTITION BY scenario_id, strategy) AS v, greatest(max(eq) OVER (PARTITION BY scenario_id, strategy ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - eq AS dd
          FROM (SELECT *, pnl / greatest(notional, 1e-9) AS r, sum(pnl) OVER (PARTITION BY scenario_id, strategy ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM evald)) GROUP BY 1, 2""")


def _evals(spark, sf):
    return base._once(spark, sf, "evaluations", lambda: episodes.policy_evaluation(_evaluated(spark, sf), ["scenario_id", "strategy"]))


@query("A10_policy_evaluation", "scenario_id:s strategy:s pnl_net_sum:f4 cost_sum:f4 turnover_contract:f4 mdd:f4 mean_daily_return:f8 var_daily:f8 dd_daily:f8 "
       "var95_loss:f8 es95_loss:f8", "SELECT * FROM evals", "evals")
def _(spark, sf):
    return episodes.policy_evaluation(_evaluated(spark, sf), ["scenario_id", "strategy"])


@query("A27_policy_metrics", "strategy:s n:i pnl_mean:g pnl_std:g VaR95:g ES95:g cost_mean:g turnover_mean:g HE_var:f8", """
    SELECT *, 1 - v / (SELECT var_samp(pnl_net_sum) FROM evals WHERE strategy = 'nohedge') AS HE_var FROM (
      SELECT strategy, count(*) AS n, avg(pnl_net_sum) AS pnl_mean, stddev_samp(pnl_net_sum) AS pnl_std, var_samp(pnl_net_sum) AS v, avg(cost_sum) AS cost_mean,
             avg(turnover_contract) AS turnover_mean FROM evals GROUP BY 1)
    JOIN (SELECT strategy, max(pnl_net_sum) AS VaR95, avg(pnl_net_sum) AS ES95 FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY pnl_net_sum) AS rn,
          count(*) OVER (PARTITION BY strategy) AS c FROM evals) WHERE rn <= greatest(1, floor(c * 0.05)) GROUP BY 1) USING (strategy)""", "evals")
def _(spark, sf):
    e = _evals(spark, sf)
    m = e.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("pnl_net_sum").alias("pnl_mean"), F.stddev_samp("pnl_net_sum").alias("pnl_std"),
                                  F.var_samp("pnl_net_sum").alias("v"), F.avg("cost_sum").alias("cost_mean"), F.avg("turnover_contract").alias("turnover_mean"))
    t = metrics.tail_metrics(e, ["strategy"], "pnl_net_sum", "order").withColumnsRenamed({"var": "VaR95", "es": "ES95"})
    v0 = m.where("strategy = 'nohedge'").select("v").scalar()
    return m.join(t, "strategy").withColumn("HE_var", metrics.effectiveness(F.col("v"), v0))


@query("A21_grouped_means", "scenario_kind:s strategy:s n:i mean_pnl:g median_pnl:g mean_mdd:g q95_turnover:g", """
    SELECT scenario_kind, strategy, count(*) AS n, avg(total_pnl) AS mean_pnl, median(total_pnl) AS median_pnl, avg(mdd) AS mean_mdd,
           quantile_cont(turnover_h, 0.95) AS q95_turnover FROM eps GROUP BY 1, 2""", "eps")
def _(spark, sf):
    e, k = _eps(spark, sf), ["scenario_kind", "strategy"]
    m = e.groupBy(*k).agg(F.count("*").alias("n"), F.avg("total_pnl").alias("mean_pnl"), F.avg("mdd").alias("mean_mdd"))
    return metrics._join_keys(m, exact_quantiles_of(e, k, {"total_pnl": ({"median_pnl": 0.5}, {}), "turnover_h": ({"q95_turnover": 0.95}, {})}), k)


@query("A21_overall_means", "n:i mean_pnl:g mean_mdd:g mean_turnover_h:g mean_h:g", """
    SELECT count(*) AS n, avg(total_pnl) AS mean_pnl, avg(mdd) AS mean_mdd, avg(turnover_h) AS mean_turnover_h, avg(mean_h) AS mean_h FROM eps""", "eps")
def _(spark, sf):
    # read once, and few of its columns: not worth the table that other queries share
    return _eps_plan(spark, sf).agg(F.count("*").alias("n"), F.avg("total_pnl").alias("mean_pnl"), F.avg("mdd").alias("mean_mdd"),
                               F.avg("turnover_h").alias("mean_turnover_h"), F.avg("mean_h").alias("mean_h"))


@query("A22_strategy_columns", "scenario_id:s nohedge:f4 naive:f4 ols_static:f4 ols_roll:f4", """
    SELECT scenario_id, """ + ", ".join(f"max(CASE WHEN strategy = '{s}' THEN net_pnl_total END) AS {s}" for s in ("nohedge", "naive", "ols_static", "ols_roll")) +
       " FROM results GROUP BY 1", "results")
def _(spark, sf):
    return base.results(spark, sf).groupBy("scenario_id").pivot("strategy", ["nohedge", "naive", "ols_static", "ols_roll"]).agg(F.first("net_pnl_total"))


_S4 = ("nohedge", "naive", "ols_static", "ols_roll")


@query("A22_median_grid", "exposure_id:s nohedge:g naive:g ols_static:g ols_roll:g", "SELECT exposure_id, " + ", ".join(
    f"median(CASE WHEN strategy = '{s}' THEN net_pnl_total END) AS {s}" for s in _S4) + " FROM results GROUP BY 1", "results")
def _(spark, sf):
    q = exact_quantiles(base.results(spark, sf), ["exposure_id", "strategy"], "net_pnl_total", {"m": 0.5})
    return q.groupBy("exposure_id").pivot("strategy", list(_S4)).agg(F.first("m"))


_VN = ("exposure_id:s strategy:s n_scenarios:i mean_pnl:g naive_mean_pnl:g diff_mean_pnl:g es95:g naive_es95:g diff_es95:g he:f8 naive_he:f8 diff_he:f8 "
       "mean_h:g turnover_h:g flag_mean_pnl:i flag_es95:i flag_he:i flags_total:i")
add_cte("vsn", """
    SELECT *, mean_pnl - naive_mean_pnl AS diff_mean_pnl, es95 - naive_es95 AS diff_es95, he - naive_he AS diff_he, CAST(mean_pnl > naive_mean_pnl AS INT) AS flag_mean_pnl,
           CAST(es95 > naive_es95 AS INT) AS flag_es95, CAST(he > naive_he AS INT) AS flag_he,
           CAST(mean_pnl > naive_mean_pnl AS INT) + CAST(es95 > naive_es95 AS INT) + CAST(he > naive_he AS INT) AS flags_total
    FROM (SELECT exposure_id, strategy, count(*) AS n_scenarios, avg(total_pnl) AS mean_pnl, avg(naive_pnl) AS naive_mean_pnl, avg(mean_h) AS mean_h, avg(turnover_h) AS turnover_h,
                 1 - var_samp(total_pnl) / var_samp(no_hedge_pnl) AS he, 1 - var_samp(naive_pnl) / var_samp(no_hedge_pnl) AS naive_he,
                 avg(total_pnl) FILTER (total_pnl <= q) AS es95, avg(naive_pnl) FILTER (naive_pnl <= qn) AS naive_es95
          FROM eps JOIN (SELECT exposure_id, strategy, quantile_cont(total_pnl, 0.05) AS q, quantile_cont(naive_pnl, 0.05) AS qn FROM eps GROUP BY 1, 2)
          USING (exposure_id, strategy) GROUP BY 1, 2)""")


def _vsn(spark, sf):
    return episodes.versus_naive(_eps(spark, sf), ["exposure_id", "strategy"])


@query("A23_versus_naive", _VN, "SELECT * FROM vsn", "vsn")
def _(spark, sf):
    return _vsn(spark, sf)


def _rk(c, d=""):
    return f"rank() OVER (ORDER BY {c} {d}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("A23_run_ranking", "exposure_id:s strategy:s flags_total:i rank_score:f2", f"""
    SELECT exposure_id, strategy, flags_total, {_rk('a', 'DESC')} + {_rk('b', 'DESC')} + {_rk('c', 'DESC')} + {_rk('t')} AS rank_score
    FROM (SELECT *, round(diff_mean_pnl, 2) AS a, round(diff_es95, 2) AS b, round(diff_he, 9) AS c, round(turnover_h, 9) AS t FROM vsn)""", "vsn")
def _(spark, sf):
    m = _vsn(spark, sf).withColumns({"a": F.round("diff_mean_pnl", 2), "b": F.round("diff_es95", 2), "c": F.round("diff_he", 9), "t": F.round("turnover_h", 9)})
    r = metrics.average_rank
    return m.withColumn("rank_score", r("a", [], True) + r("b", [], True) + r("c", [], True) + r("t", []))


# runs with the settings in their folder's name; every third configuration was run twice, the later row with other figures
add_cte("runs", """
    SELECT *, 'runs/x/exp_T' || t || '_s1_hmin0.0_hmax' || hx || '_dh0.25_wLPM' || wl || '_wVOL0.5_wCOST' || wc || '_tau' || tau || '/' AS run_dir FROM (
      SELECT v.*, attempt, CASE WHEN exposure_id = 'N' THEN 100000 ELSE 200000 END AS t, CASE WHEN strategy = 'naive' THEN '1.5' ELSE '2.0' END AS hx,
             CASE strategy WHEN 'nohedge' THEN '1' WHEN 'naive' THEN '1.0' WHEN 'ols_static' THEN '2e0' ELSE '0.5' END AS wl,
             CASE WHEN exposure_id < '3' THEN '0.1' ELSE '1E-1' END AS wc, length(exposure_id) || '.5' AS tau
      FROM vsn v, (SELECT unnest([0, 1]) AS attempt) WHERE attempt = 0 OR strategy = 'ols_roll')""")


def _runs(spark, sf):
    m = _vsn(spark, sf).withColumn("attempt", F.explode(F.when(F.col("strategy") == "ols_roll", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    e, s = F.col("exposure_id"), F.col("strategy")
    name = F.concat(F.lit("runs/x/exp_T"), F.when(e == "N", "100000").otherwise("200000"), F.lit("_s1_hmin0.0_hmax"), F.when(s == "naive", "1.5").otherwise("2.0"),
                    F.lit("_dh0.25_wLPM"), F.when(s == "nohedge", "1").when(s == "naive", "1.0").when(s == "ols_static", "2e0").otherwise("0.5"),
                    F.lit("_wVOL0.5_wCOST"), F.when(e < "3", "0.1").otherwise("1E-1"), F.lit("_tau"), F.length(e).cast("string"), F.lit(".5/"))
    return report.run_folder_settings(m.withColumn("run_dir", name), "run_dir")


@query("P16_run_folder", "exposure_id:s strategy:s attempt:i timesteps:i h_min:f6 h_max:f6 delta_h:f6 w_lpm:f6 w_volatility:f6 w_cost:f6 lpm_target:f6 gamma:f6", """
    SELECT exposure_id, strategy, attempt, t AS timesteps, 0.0 AS h_min, CAST(hx AS DOUBLE) AS h_max, 0.25 AS delta_h, CAST(wl AS DOUBLE) AS w_lpm, 0.5 AS w_volatility,
           CAST(wc AS DOUBLE) AS w_cost, CAST(tau AS DOUBLE) AS lpm_target, NULL AS gamma FROM runs""", "runs")
def _(spark, sf):
    return _runs(spark, sf)


def _score(c, d=""):
    return f"rank() OVER (ORDER BY {c} {d}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("A23_run_summary", "w_lpm:f6 lpm_target:f6 timesteps:i exposure_id:s strategy:s flags_total:i rank_score:f2 position:i flagged:i", f"""
    WITH k AS (SELECT *, CAST(wl AS DOUBLE) AS w_lpm, CAST(wc AS DOUBLE) AS w_cost, CAST(tau AS DOUBLE) AS lpm_target FROM runs),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w_lpm, w_cost, lpm_target, t ORDER BY exposure_id DESC, strategy DESC, attempt DESC) AS rn FROM k) WHERE rn = 1),
    r AS (SELECT *, {_score('diff_mean_pnl', 'DESC')} + {_score('diff_es95', 'DESC')} + {_score('diff_he', 'DESC')} + {_score('turnover_h')} AS rank_score FROM l)
    SELECT w_lpm, lpm_target, t AS timesteps, exposure_id, strategy, flags_total, rank_score, CAST(flags_total > 0 AS INT) AS flagged,
           row_number() OVER (ORDER BY flags_total DESC, rank_score, w_lpm, 0.5, w_cost, 0.25, t, lpm_target) AS position FROM r""", "runs")
def _(spark, sf):
    return report.rank_runs(_runs(spark, sf), ["exposure_id", "strategy", "attempt"])


@query("A9_episode_actions", "scenario_id:s strategy:s action_counts:s n_actions:i top_share:f8", """
    WITH a AS (SELECT scenario_id, strategy, CAST(sign(round(h_t - h_prev, 6)) AS INT) AS a FROM tdays),
    c AS (SELECT scenario_id, strategy, a, count(*) AS n FROM a GROUP BY 1, 2, 3)
    SELECT scenario_id, strategy, '{' || string_agg('"' || a || '": ' || n, ', ' ORDER BY a) || '}' AS action_counts, count(*) AS n_actions, max(n) / sum(n) AS top_share
    FROM c GROUP BY 1, 2""", "tdays")
def _(spark, sf):
    log = base.step_log(spark, sf).withColumn("action", F.signum(F.round(F.col("h_t") - F.col("h_prev"), 6)).cast("int"))
    return episodes.action_statistics(log, ["scenario_id", "strategy"], "action")


add_cte("ev", """SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, (value - 60) * 1000 AS pnl FROM events""")
add_cte("trial", """
    SELECT m.*, e.unique_actions, e.entropy, CASE WHEN unique_actions > 1 THEN e.entropy / ln(unique_actions) ELSE 0 END AS entropy_norm
    FROM (SELECT user_id, avg(pnl) AS mean_pnl, avg(-abs(value) * 10) AS mean_mdd, avg(k * 20.0) AS mean_cost, avg((k % 10) / 100.0) AS mean_h_std, avg(k / 16.0) AS mean_turnover_h
          FROM ev GROUP BY 1) m
    JOIN (SELECT user_id, count(*) AS unique_actions, -sum(n / t * ln(n / t + 1e-12)) AS entropy FROM (
            SELECT *, sum(n) OVER (PARTITION BY user_id) AS t FROM (SELECT user_id, event_type, CAST(sum(k) AS DOUBLE) AS n FROM ev WHERE k IS NOT NULL GROUP BY 1, 2)) GROUP BY 1) e USING (user_id)""")
add_cte("trials", """
    SELECT *, CASE WHEN reject_reasons <> '' THEN 1 ELSE 0 END AS reject, mean_pnl - 0.65 * abs(mean_mdd) - 0.35 * mean_cost + 350000 * entropy_norm
      + 1250000 * least(mean_h_std, 0.25) - 150000 * greatest(mean_turnover_h - 1.25, 0) - CASE WHEN reject_reasons <> '' THEN 10000000 ELSE 0 END AS score
    FROM (SELECT *, concat_ws(';', CASE WHEN unique_actions < 2 THEN 'unique_actions<2' END, CASE WHEN mean_h_std < 0.02 THEN 'mean_h_std<0.02' END,
            CASE WHEN mean_turnover_h < 0.05 THEN 'mean_turnover_h<0.05' END, CASE WHEN mean_turnover_h > 3.0 THEN 'mean_turnover_h>3.0' END,
            CASE WHEN mean_cost / (abs(mean_pnl) + 1) > 0.2 THEN 'cost_ratio>20pct' END) AS reject_reasons FROM trial)""")


def _trials(spark, sf):
    e = market.table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).try_cast("long"))
    counts = e.withColumn("counts", F.concat(F.lit('{"'), "event_type", F.lit('": '), F.col("k").cast("string"), F.lit("}")))
    ent = episodes.action_entropy(episodes.merged_counts(counts, ["user_id"], "counts"), ["user_id"])
    a = lambda x, o: F.avg(x).alias(o)
    m = e.groupBy("user_id").agg(a((F.col("value") - 60) * 1000, "mean_pnl"), a(-F.abs("value") * 10, "mean_mdd"), a(F.col("k") * 20.0, "mean_cost"),
                                 a(F.col("k") % 10 / 100.0, "mean_h_std"), a(F.col("k") / 16.0, "mean_turnover_h"))
    return episodes.trial_scores(m.join(ent, "user_id"))


@query("A24_trial_scores", "user_id:i unique_actions:i entropy:f7 entropy_norm:f7 reject:i reject_reasons:s score:f3", "SELECT * FROM trials", "trials")
def _(spark, sf):
    return _trials(spark, sf)


@query("A24_best_trial", "grp:i user_id:i reject:i score:f3", """
    SELECT grp, user_id, reject, score FROM (SELECT *, user_id % 5 AS grp, row_number() OVER (PARTITION BY user_id % 5 ORDER BY reject, score DESC, user_id DESC) AS rn FROM trials)
    WHERE rn = 1""", "trials")
def _(spark, sf):
    return episodes.best_trial(_trials(spark, sf).withColumn("grp", F.col("user_id") % 5), ["grp"], "user_id")


add_cte("vsc", """
    SELECT exposure_id, strategy, pnl_mean / 1e6 - 0.45 * mdd_abs / 1e6 - 0.40 * greatest(0, -cvar) / 1e6 - 0.20 * boundary AS score FROM (
      SELECT exposure_id, strategy, avg(total_pnl) AS pnl_mean, avg(abs(mdd)) AS mdd_abs, avg(total_pnl) FILTER (total_pnl <= q) AS cvar,
             coalesce(avg(CASE WHEN mx > 0 THEN CAST(h_abs_mean > 0.95 * mx AS INT) END), 0) AS boundary
      FROM eps JOIN (SELECT exposure_id, strategy, quantile_cont(total_pnl, 0.05) AS q, max(h_abs_mean) AS mx FROM eps GROUP BY 1, 2) USING (exposure_id, strategy) GROUP BY 1, 2)""")


@query("A25_validation_score", "exposure_id:s strategy:s score:f6", "SELECT * FROM vsc", "vsc")
def _(spark, sf):
    return episodes.validation_score(_eps(spark, sf), ["exposure_id", "strategy"])


@query("A25_composite_score", "strategy:s score:g", """
    SELECT strategy, avg(total_pnl) + 0.5 * avg(mdd) + 0.3 * any_value(q) + 0.3 * avg(total_pnl) FILTER (total_pnl <= q) AS score
    FROM eps JOIN (SELECT strategy, quantile_cont(total_pnl, 0.05) AS q FROM eps GROUP BY 1) USING (strategy) GROUP BY 1""", "eps")
def _(spark, sf):
    e = _eps(spark, sf)
    m = e.groupBy("strategy").agg(F.avg("total_pnl").alias("p"), F.avg("mdd").alias("m")).join(metrics.tail_metrics(e, ["strategy"], "total_pnl"), "strategy")
    return m.withColumn("score", episodes.composite_score(F.col("p"), F.col("m"), F.col("var"), F.col("es")))


@query("A26_seed_stability", "strategy:s score_mean:f6 score_std:f6 stable_score:f6 rank:i", """
    SELECT *, row_number() OVER (ORDER BY stable_score DESC, strategy) AS rank FROM (SELECT strategy, avg(score) AS score_mean, stddev_samp(score) AS score_std,
           avg(score) - 0.5 * coalesce(stddev_samp(score), 0) AS stable_score FROM vsc GROUP BY 1)""", "vsc")
def _(spark, sf):
    return episodes.seed_stability(episodes.validation_score(_eps(spark, sf), ["exposure_id", "strategy"]), "strategy", "score")


@query("A28_first_full_year", "exposure_id:s year:i scenario_id:s", """
    SELECT exposure_id, year, scenario_id FROM (SELECT t.*, row_number() OVER (PARTITION BY t.exposure_id ORDER BY md5('s1|' || scenario_id), scenario_id) AS rn FROM (
      SELECT *, year(start_date) AS year FROM trades) t JOIN (SELECT exposure_id, coalesce(min(CASE WHEN c >= 200 THEN year END), min(year)) AS year FROM (
        SELECT exposure_id, year(start_date) AS year, count(*) AS c FROM trades GROUP BY 1, 2) GROUP BY 1) p ON p.exposure_id = t.exposure_id AND p.year = t.year)
    WHERE rn <= 200""", "trades")
def _(spark, sf):
    return episodes.first_full_year(base.trades(spark, sf), 200, "s1")


@query("D8_seeded_sample", "scenario_id:s", "SELECT scenario_id FROM trades ORDER BY md5('s2|' || scenario_id), scenario_id LIMIT 500", "trades")
def _(spark, sf):
    return episodes.seeded_sample(base.trades(spark, sf), 500, "s2", "scenario_id")


_POS = "row_number() OVER (ORDER BY start_date, trade_no) - 1"


@query("D8_spread_pick", "trade_no:i", f"""
    WITH p AS (SELECT trade_no, {_POS} AS p, count(*) OVER () AS n FROM trades)
    SELECT trade_no FROM p WHERE p IN (SELECT CAST(floor(i * (n - 1) / (m - 1)) AS BIGINT) FROM (SELECT n, ceil(n * 0.1) AS m, unnest(range(0, CAST(ceil(n * 0.1) AS BIGINT))) AS i FROM p LIMIT 1000000))""".replace(
    " FROM p LIMIT 1000000", " FROM (SELECT count(*) AS n FROM trades)"), "trades")
def _(spark, sf):
    return episodes.spread_pick(base.trades(spark, sf), "start_date", ["trade_no"], 0.1)


@query("D8_chunks", "chunk:i n:i first_no:i last_no:i", f"""
    SELECT c AS chunk, count(*) AS n, arg_min(trade_no, p) AS first_no, arg_max(trade_no, p) AS last_no FROM (SELECT trade_no, p, p // 1000 AS c FROM (
      SELECT trade_no, {_POS} AS p FROM trades)) GROUP BY 1""", "trades")
def _(spark, sf):
    c = episodes.chunked(base.trades(spark, sf), "start_date", ["trade_no"], 1000)
    o = F.struct("start_date", "trade_no")
    return c.groupBy("chunk").agg(F.count("*").alias("n"), F.min_by("trade_no", o).alias("first_no"), F.max_by("trade_no", o).alias("last_no"))


# ---- splits ----
_WF = "window_id:i train_start:d val_start:d test_start:d test_end:d"
add_cte("wf", """SELECT k + 1 AS window_id, CAST(d0 + to_years(k) AS DATE) AS train_start, CAST(d0 + to_years(k + 2) AS DATE) AS val_start, CAST(d0 + to_years(k + 3) AS DATE) AS test_start,
    CAST(d0 + to_years(k + 4) AS DATE) AS test_end FROM (SELECT d0, d1, CAST(unnest(range(0, 50)) AS INT) AS k FROM (SELECT min(d) AS d0, max(d) AS d1 FROM filled)) WHERE d0 + to_years(k + 4) <= d1""")
add_cte("seg", """SELECT window_id, 'train' AS segment, train_start AS a, val_start AS b FROM wf UNION ALL SELECT window_id, 'val', val_start, test_start FROM wf
    UNION ALL SELECT window_id, 'test', test_start, test_end FROM wf""")


def _wf(spark, sf):
    return splits.walk_forward_years(base.filled(spark, sf), "d", 2, 1, 1, 1)


@query("G5_walk_forward_years", _WF, "SELECT * FROM wf", "wf")
def _(spark, sf):
    return _wf(spark, sf)


@query("G5_calendar_year_windows", "mode:s window_name:s train_y0:i train_y1:i val_y:i test_y:i", """
    SELECT mode, 'WF_train' || train_y0 || '-' || train_y1 || '_val' || (train_y1 + 1) || '_test' || (train_y1 + 2) AS window_name, train_y0, train_y1, train_y1 + 1 AS val_y, train_y1 + 2 AS test_y
    FROM (SELECT mode, CASE mode WHEN 'rolling' THEN y - 1 WHEN 'expanding' THEN y0 ELSE greatest(y0, y - 2) END AS train_y0, y AS train_y1 FROM (
      SELECT y0, unnest(range(y0 + 1, y1 - 1)) AS y FROM (SELECT min(year(d)) AS y0, max(year(d)) AS y1 FROM filled)), (SELECT unnest(['rolling', 'expanding', 'hybrid_expanding']) AS mode))""", "filled")
def _(spark, sf):
    f = base.filled(spark, sf)
    parts = [splits.calendar_year_windows(f, "d", m, 2, 3).withColumn("mode", F.lit(m)) for m in ("rolling", "expanding", "hybrid_expanding")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("G5_rolling_day_windows", _WF, """
    SELECT k // 183 + 1 AS window_id, d0 + k AS train_start, d0 + k + 730 AS val_start, d0 + k + 913 AS test_start, d0 + k + 1096 AS test_end
    FROM (SELECT d0, CAST(unnest(range(0, date_diff('day', d0, d1) + 2 - 1096, 183)) AS INT) AS k FROM (SELECT min(d) AS d0, max(d) AS d1 FROM filled))""", "filled")
def _(spark, sf):
    return splits.rolling_day_windows(base.filled(spark, sf), "d", 730, 183, 183, 183)


@query("G5_expanding_index_windows", "exposure_id:s window_id:i train_start:i val_start:i test_start:i test_end:i", """
    SELECT exposure_id, k + 1 AS window_id, 0 AS train_start, CAST(floor(n * (0.5 + k * 0.1) + 1e-9) AS BIGINT) AS val_start, CAST(floor(n * (0.6 + k * 0.1) + 1e-9) AS BIGINT) AS test_start,
           CAST(floor(n * (0.7 + k * 0.1) + 1e-9) AS BIGINT) AS test_end FROM (SELECT exposure_id, CAST(count(*) AS DOUBLE) AS n, unnest([0, 1, 2, 3]) AS k FROM cal GROUP BY 1)""", "cal")
def _(spark, sf):
    n = base.calendar(spark, sf).groupBy("exposure_id").agg(F.count("*").alias("n"))
    w = splits.expanding_index_windows(n, "n", 0.5, 0.1, 0.1, 0.1)
    return w


@query("J18_segment_rows", "window_id:i segment:s exposure_id:s n:i", """
    SELECT window_id, segment, exposure_id, count(*) AS n FROM trades JOIN seg ON start_date >= a AND start_date < b GROUP BY 1, 2, 3""", "trades seg")
def _(spark, sf):
    a = splits.assign(base.trades(spark, sf).select("exposure_id", "start_date"), splits.segments(_wf(spark, sf)), "start_date")
    return a.groupBy("window_id", "segment", "exposure_id").agg(F.count("*").alias("n"))


@query("J18_interval_join", "exposure_id:s d:d n_open:i volume:i last_end:d", """
    SELECT exposure_id, d, count(*) AS n_open, sum(volume_bbl) AS volume, max(end_date) AS last_end
    FROM cal JOIN trades USING (exposure_id) WHERE d >= start_date AND d < end_date GROUP BY 1, 2""", "cal trades")
def _(spark, sf):
    """Trades open on each day: as many intervals as trades."""
    open_trades = base.trades(spark, sf).select("exposure_id", "start_date", "end_date", "volume_bbl")
    j = points_in_intervals(base.calendar(spark, sf).select("exposure_id", "d"), "d", open_trades, "start_date", "end_date", ("exposure_id",))
    return j.groupBy("exposure_id", "d").agg(F.count("*").alias("n_open"), F.sum("volume_bbl").alias("volume"), F.max("end_date").alias("last_end"))


@query("A5_segment_coverage", "window_id:i segment:s series_id:s coverage:f8 n_rows:i", """
    SELECT window_id, segment, series_id, count(CASE WHEN raw IS NOT NULL THEN 1 END) / count(*) AS coverage, count(*) AS n_rows
    FROM filled JOIN seg ON d >= a AND d < b GROUP BY 1, 2, 3""", "filled seg")
def _(spark, sf):
    a = splits.assign(base.filled(spark, sf).select("series_id", "d", "raw"), splits.segments(_wf(spark, sf)), "d")
    return a.groupBy("window_id", "segment", "series_id").agg((F.count("raw") / F.count("*")).alias("coverage"), F.count("*").alias("n_rows"))


@query("G7_window_audit", "window_id:i n_train:i n_val:i n_test:i status:s", """
    SELECT window_id, max(CASE WHEN segment = 'train' THEN n END) AS n_train, max(CASE WHEN segment = 'val' THEN n END) AS n_val, max(CASE WHEN segment = 'test' THEN n END) AS n_test,
           CASE WHEN min(n) > 0 THEN 'accepted' ELSE 'empty' END AS status
    FROM (SELECT s.window_id, s.segment, count(t.trade_no) AS n FROM seg s LEFT JOIN (SELECT * FROM trades WHERE year(start_date) <> 1998) t ON start_date >= a AND start_date < b GROUP BY 1, 2) GROUP BY 1""",
       "trades seg")
def _(spark, sf):
    s = splits.segments(_wf(spark, sf))
    a = splits.assign(base.trades(spark, sf).where("year(start_date) <> 1998").select("start_date"), s, "start_date")
    return splits.window_audit(a, s)


@query("G5_snapped_years", "y0:i y1:i first_day:d last_day:d", """
    SELECT y AS y0, y + 1 AS y1, (SELECT min(d) FROM raw WHERE year(d) BETWEEN y AND y + 1 AND price IS NOT NULL) AS first_day,
           (SELECT max(d) FROM raw WHERE year(d) BETWEEN y AND y + 1 AND price IS NOT NULL) AS last_day FROM (SELECT DISTINCT year(d) AS y FROM raw)""", "raw")
def _(spark, sf):
    raw = base.raw_panel(spark, sf)
    w = raw.select(F.year("d").alias("y0"), (F.year("d") + 1).alias("y1")).distinct()
    return splits.snap_to_days(w, raw.where("price IS NOT NULL"), "d")


@query("G6_splits", "exposure_id:s by_index:s by_date:s n:i", """
    SELECT exposure_id, CASE WHEN i < floor(n * 0.7 + 1e-9) THEN 'train' WHEN i < floor(n * 0.85 + 1e-9) THEN 'val' ELSE 'test' END AS by_index,
           CASE WHEN d < DATE '1999-01-01' THEN 'train' WHEN d < DATE '2000-06-01' THEN 'val' ELSE 'test' END AS by_date, count(*) AS n
    FROM (SELECT *, idx - 1 AS i, CAST(count(*) OVER (PARTITION BY exposure_id) AS DOUBLE) AS n FROM cal) GROUP BY 1, 2, 3""", "cal")
def _(spark, sf):
    c = base.calendar(spark, sf)
    n = F.count("*").over(Window.partitionBy("exposure_id")).cast("double")
    c = c.withColumns({"by_index": splits.percentile_split(F.col("idx") - 1, n), "by_date": splits.date_split(F.col("d"), "1999-01-01", "2000-06-01")})
    return c.groupBy("exposure_id", "by_index", "by_date").agg(F.count("*").alias("n"))


@query("W46_fixed_length", "exposure_id:s start_idx:i end_idx:i start_date:d end_date:d tradable_days:i", """
    SELECT exposure_id, idx - 1 AS start_idx, idx + 29 AS end_idx, d AS start_date, ed AS end_date, td AS tradable_days FROM (
      SELECT *, sum(tradable) OVER w AS td, last_value(d) OVER w AS ed, max(idx) OVER (PARTITION BY exposure_id) AS n FROM cal
      WINDOW w AS (PARTITION BY exposure_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)) WHERE (idx - 1) % 5 = 0 AND idx + 29 <= n AND td >= 15""", "cal")
def _(spark, sf):
    return splits.fixed_length(base.calendar(spark, sf), 30, 5)
