"""Queries of risk metrics, audits and feature screening."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basisflow.operators import audit, features, metrics, pnl, returns
from basisflow.queries import base
from basisflow.queries.registry import query
from basisflow.queries.sqlbase import add_cte
from basisflow.sources import market

K = ["exposure_id", "scenario_kind", "strategy"]
KS = "exposure_id:s scenario_kind:s strategy:s"
KSQL = "exposure_id, scenario_kind, strategy"
X = "net_pnl_total"

add_cte("gross", "SELECT *, spot_pnl_total + fut_pnl_total AS gross_pnl_total, "
                 "cost_trade_total + cost_roll_total AS total_cost FROM results")
add_cte("var05", f"SELECT {KSQL}, quantile_cont({X}, 0.05) AS q05, quantile_cont({X}, 0.95) AS q95, "
                 f"quantile_cont(-{X}, 0.95) AS l95, count(*) AS n FROM results GROUP BY ALL")


@query("A11_tail_signed", KS + " var:g es:g",
       f"SELECT {KSQL}, any_value(q05) AS var, avg({X}) FILTER ({X} <= q05) AS es FROM results JOIN var05 USING ({KSQL}) GROUP BY ALL",
       "results var05")
def _(spark, sf):
    return metrics.tail_metrics(base.results(spark, sf), K, X)


@query("A11_tail_positive", KS + " var:g es:g",
       f"SELECT {KSQL}, -any_value(q05) AS var, -avg({X}) FILTER ({X} <= q05) AS es FROM results JOIN var05 USING ({KSQL}) GROUP BY ALL",
       "results var05")
def _(spark, sf):
    return metrics.tail_metrics(base.results(spark, sf), K, X, "positive")


@query("A11_tail_losses", KS + " var:g es:g",
       f"SELECT {KSQL}, any_value(l95) AS var, avg(-{X}) FILTER (-{X} >= l95) AS es FROM results JOIN var05 USING ({KSQL}) GROUP BY ALL",
       "results var05")
def _(spark, sf):
    return metrics.tail_metrics(base.results(spark, sf), K, X, "losses")


@query("A11_tail_order", KS + " var:g es:g", f"""
    SELECT {KSQL}, max({X}) AS var, avg({X}) AS es FROM (
      SELECT *, row_number() OVER (PARTITION BY {KSQL} ORDER BY {X}) AS rn FROM results)
    JOIN var05 USING ({KSQL}) WHERE rn <= greatest(1, CAST(floor(n * 0.05) AS BIGINT)) GROUP BY ALL""", "results var05")
def _(spark, sf):
    return metrics.tail_metrics(base.results(spark, sf), K, X, "order")


@query("A12_lower_partial_moments", KS + " lpm1:g lpm2:g lpm3:g root_lpm2:g", f"""
    SELECT {KSQL}, avg(s) AS lpm1, avg(s ** 2) AS lpm2, avg(s ** 3) AS lpm3, sqrt(avg(s ** 2)) AS root_lpm2
    FROM (SELECT *, greatest(-1000 - {X}, 0) AS s FROM results) GROUP BY ALL""", "results")
def _(spark, sf):
    x = F.col(X)
    return base.results(spark, sf).groupBy(*K).agg(
        metrics.lpm(x, -1000, 1).alias("lpm1"), metrics.lpm(x, -1000, 2).alias("lpm2"),
        metrics.lpm(x, -1000, 3).alias("lpm3"), F.sqrt(metrics.lpm(x, -1000, 2)).alias("root_lpm2"))


@query("A13_ratio_metrics", KS + " omega:g prob_profit:g cv:g sortino_tau0:g tail_ratio:g", f"""
    SELECT {KSQL}, CASE WHEN sum(greatest(-{X}, 0)) > 0 THEN sum(greatest({X}, 0)) / sum(greatest(-{X}, 0)) END AS omega,
           avg(CAST({X} > 0 AS INT)) AS prob_profit, stddev_samp({X}) / abs(avg({X})) AS cv,
           avg({X}) / sqrt(avg(greatest(-{X}, 0) ** 2)) AS sortino_tau0,
           abs(quantile_cont({X}, 0.95)) / abs(quantile_cont({X}, 0.05)) AS tail_ratio
    FROM results GROUP BY ALL""", "results")
def _(spark, sf):
    return metrics.group_metrics(base.results(spark, sf), K)


_VARS = """var_samp(net_pnl_total) AS var_net, var_samp(gross_pnl_total) AS var_gross, var_samp(spot_pnl_total) AS var_spot"""
_MEANS = ", ".join(f"avg({c}) AS {a}" for a, c in metrics.MEANS.items())
add_cte("gm", f"""
    SELECT {KSQL}, count(*) AS n_rows, count(DISTINCT scenario_id) AS n_scenarios, avg({X}) AS mean_net,
           median({X}) AS median_net, stddev_samp({X}) AS std_net, min({X}) AS min_net, max({X}) AS max_net, {_VARS},
           avg(greatest(-{X}, 0)) AS lpm1, avg(greatest(-{X}, 0) ** 2) AS lpm2, skewness({X}) AS skew,
           kurtosis({X}) AS kurtosis_excess, min(mdd_equity) AS mdd_equity_min, {_MEANS}, any_value(q05) AS var95,
           avg({X}) FILTER ({X} <= q05) AS es95
    FROM gross JOIN var05 USING ({KSQL}) GROUP BY ALL""")
add_cte("gmhe", """
    SELECT m.*, b.var_net AS var_unhedged_net, CASE WHEN b.var_net > 0 THEN 1 - m.var_net / b.var_net END AS he_net_vs_nohedge,
           CASE WHEN b.var_gross > 0 THEN 1 - m.var_gross / b.var_gross END AS he_gross_vs_nohedge,
           CASE WHEN b.var_spot > 0 THEN 1 - m.var_spot / b.var_spot END AS he_spot_vs_nohedge
    FROM gm m LEFT JOIN (SELECT * FROM gm WHERE strategy = 'nohedge') b USING (exposure_id, scenario_kind)""")
_GM = (" n_rows:i n_scenarios:i mean_net:g median_net:g std_net:g min_net:g max_net:g var_net:g var_gross:g var_spot:g lpm1:g "
       "lpm2:g skew:f6 kurtosis_excess:f6 mdd_equity_min:g var95:g es95:g " + " ".join(f"{a}:g" for a in metrics.MEANS))
_HE = " he_net_vs_nohedge:f8 he_gross_vs_nohedge:f8 he_spot_vs_nohedge:f8"


def _metrics(spark, sf):
    """Metric rows of every group, read by several reports: few rows, written once."""
    return base._once(spark, sf, "group_metrics", lambda: metrics.add_effectiveness(
        metrics.group_metrics(base.results(spark, sf), K), ["exposure_id", "scenario_kind"]))


@query("A15_group_metrics", KS + _GM, "SELECT * FROM gm", "gm")
def _(spark, sf):
    return metrics.group_metrics(base.results(spark, sf), K)


@query("A14_hedging_effectiveness", KS + " var_unhedged_net:g" + _HE, "SELECT * FROM gmhe", "gmhe")
def _(spark, sf):
    return _metrics(spark, sf)


@query("J11_benchmark_variance", "exposure_id:s scenario_kind:s horizon:s strategy:s var_net:g var_unhedged_net:g he_net_vs_nohedge:f8", f"""
    WITH r AS (SELECT *, CASE WHEN horizon_days_realized = horizon_days_target THEN 'full' ELSE 'short' END AS horizon FROM gross
               WHERE NOT (strategy = 'nohedge' AND horizon_days_realized <> horizon_days_target)),
         m AS (SELECT exposure_id, scenario_kind, horizon, strategy, var_samp({X}) AS var_net FROM r GROUP BY ALL),
         b AS (SELECT * FROM m WHERE strategy = 'nohedge'),
         f AS (SELECT exposure_id, avg(var_net) AS v FROM b GROUP BY 1)
    SELECT m.*, coalesce(b.var_net, f.v) AS var_unhedged_net, 1 - m.var_net / coalesce(b.var_net, f.v) AS he_net_vs_nohedge
    FROM m LEFT JOIN b USING (exposure_id, scenario_kind, horizon) LEFT JOIN f USING (exposure_id)""", "gross")
def _(spark, sf):
    full = F.col("horizon_days_realized") == F.col("horizon_days_target")
    r = metrics.with_gross(base.results(spark, sf)).withColumn("horizon", F.when(full, "full").otherwise("short"))
    r = r.where(~((F.col("strategy") == "nohedge") & ~full))
    m = r.groupBy("exposure_id", "scenario_kind", "horizon", "strategy").agg(
        F.var_samp(X).alias("var_net"), F.var_samp("gross_pnl_total").alias("var_gross"),
        F.var_samp("spot_pnl_total").alias("var_spot"))
    return metrics.add_effectiveness(m, ["exposure_id", "scenario_kind", "horizon"], ["exposure_id"])


@query("A16_ranked_metrics", KS + " he_net_vs_nohedge:f8 es95:g mdd_equity_mean:g rank_by_he:i rank_by_es:i rank_by_mdd:i", """
    SELECT *, dense_rank() OVER (PARTITION BY exposure_id, scenario_kind ORDER BY CAST(printf('%.11e', he_net_vs_nohedge) AS DOUBLE) DESC) AS rank_by_he,
           dense_rank() OVER (PARTITION BY exposure_id, scenario_kind ORDER BY CAST(printf('%.11e', es95) AS DOUBLE) DESC) AS rank_by_es,
           dense_rank() OVER (PARTITION BY exposure_id, scenario_kind ORDER BY CAST(printf('%.11e', mdd_equity_mean) AS DOUBLE) DESC) AS rank_by_mdd FROM gmhe""", "gmhe")
def _(spark, sf):
    return metrics.metric_ranks(_metrics(spark, sf), ["exposure_id", "scenario_kind"])


@query("W45_quick_score", KS + " score_quick:f6", """
    SELECT *, 0.35 * z1 - 0.25 * z2 - 0.25 * z3 + 0.15 * z4 AS score_quick FROM (
      SELECT *, """ + ", ".join(f"({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) AS z{i}" for i, c in
                                enumerate(("he_net_vs_nohedge", "es95", "mdd_equity_mean", "mean_net"), 1)) +
       " FROM gmhe WINDOW w AS (PARTITION BY exposure_id, scenario_kind))", "gmhe")
def _(spark, sf):
    return metrics.quick_score(_metrics(spark, sf), ["exposure_id", "scenario_kind"])


@query("W45_score_without_drawdown", KS + " score_quick:f6", """
    SELECT *, 0.45 * z1 - 0.30 * z2 + 0.25 * z3 AS score_quick FROM (
      SELECT *, """ + ", ".join(f"({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) AS z{i}" for i, c in
                                enumerate(("he_net_vs_nohedge", "es95", "mean_net"), 1)) +
       " FROM gmhe WINDOW w AS (PARTITION BY exposure_id, scenario_kind))", "gmhe")
def _(spark, sf):
    return metrics.quick_score(_metrics(spark, sf).drop("mdd_equity_mean"), ["exposure_id", "scenario_kind"])


@query("W44_average_rank", KS + " rank_es:f2 rank_he:f2 rank_sum:f2", """
    SELECT *, rank_es + rank_he AS rank_sum FROM (
      SELECT *, rank() OVER (PARTITION BY exposure_id ORDER BY round(es95 / 1e6) DESC)
                + (count(*) OVER (PARTITION BY exposure_id, round(es95 / 1e6)) - 1) / 2.0 AS rank_es,
             rank() OVER (PARTITION BY exposure_id ORDER BY round(he_net_vs_nohedge, 2) DESC)
                + (count(*) OVER (PARTITION BY exposure_id, round(he_net_vs_nohedge, 2)) - 1) / 2.0 AS rank_he FROM gmhe)""", "gmhe")
def _(spark, sf):
    m = _metrics(spark, sf).withColumns({"_es": F.round(F.col("es95") / 1e6), "_he": F.round("he_net_vs_nohedge", 2)})
    m = m.withColumns({"rank_es": metrics.average_rank("_es", ["exposure_id"], True),
                       "rank_he": metrics.average_rank("_he", ["exposure_id"], True)})
    return m.withColumn("rank_sum", F.col("rank_es") + F.col("rank_he"))


@query("A18_pooled_strategy", "exposure_id:s strategy:s n_scenarios:i mean_net:g std_net:g es95:g he_net_vs_nohedge:f8 scenario_kind:s", """
    SELECT exposure_id, strategy, sum(n_scenarios) AS n_scenarios, sum(n_scenarios * mean_net) / sum(n_scenarios) AS mean_net,
           sqrt((sum((n_scenarios - 1) * std_net ** 2) + sum(n_scenarios * (mean_net - pm) ** 2)) / (sum(n_scenarios) - 1)) AS std_net,
           sum(n_scenarios * es95) / sum(n_scenarios) AS es95,
           sum(n_scenarios * he_net_vs_nohedge) / sum(n_scenarios) AS he_net_vs_nohedge, 'ALL' AS scenario_kind
    FROM (SELECT *, sum(n_scenarios * mean_net) OVER w / sum(n_scenarios) OVER w AS pm FROM gmhe
          WINDOW w AS (PARTITION BY exposure_id, strategy)) GROUP BY 1, 2""", "gmhe")
def _(spark, sf):
    return metrics.pooled(_metrics(spark, sf), ["exposure_id", "strategy"],
                          ["mean_net", "es95", "he_net_vs_nohedge"], ["scenario_kind"])


_ALPHAS = [0.80 + 0.01 * i for i in range(20)] + [0.991, 0.9925, 0.995, 0.9975, 0.999]
_P = "[" + ", ".join(repr(round(1 - a, 10)) for a in _ALPHAS) + "]"


@query("A19_tail_curves", "exposure_id:s strategy:s alpha:f4 n:i var:g es:g", f"""
    SELECT r.exposure_id, r.strategy, round(1 - p, 10) AS alpha, count(*) AS n, any_value(q) AS var, avg({X}) FILTER ({X} <= q) AS es
    FROM results r JOIN (SELECT exposure_id, strategy, unnest({_P}) AS p, unnest(quantile_cont({X}, {_P})) AS q FROM results
                         GROUP BY 1, 2) USING (exposure_id, strategy) GROUP BY r.exposure_id, r.strategy, p HAVING count(*) >= 5""", "results")
def _(spark, sf):
    return metrics.tail_curve(base.results(spark, sf), ["exposure_id", "strategy"], X, _ALPHAS)


@query("A20_normal_aic", "exposure_id:s strategy:s aic:g", f"""
    SELECT exposure_id, strategy, 4 - 2 * (-n / 2.0 * ln(2 * pi() * v) - (n - 1) / 2.0) AS aic
    FROM (SELECT exposure_id, strategy, count(*) AS n, var_samp({X}) AS v FROM results GROUP BY 1, 2) WHERE n >= 30""", "results")
def _(spark, sf):
    return base.results(spark, sf).groupBy("exposure_id", "strategy").agg(metrics.normal_aic(F.col(X)).alias("aic"))


@query("A29_distribution_bins", "exposure_id:s strategy:s bin:i n:i density:g", f"""
    WITH rng AS (SELECT exposure_id, quantile_cont({X}, 0.005) AS lo, quantile_cont({X}, 0.995) AS hi FROM results GROUP BY 1)
    SELECT exposure_id, strategy, bin, n, n / (sum(n) OVER (PARTITION BY exposure_id, strategy) * w) AS density FROM (
      SELECT r.exposure_id, r.strategy, least(CAST(floor(({X} - lo) / ((hi - lo) / 360)) AS BIGINT), 359) AS bin, count(*) AS n,
             any_value((hi - lo) / 360) AS w
      FROM results r JOIN rng USING (exposure_id) WHERE {X} BETWEEN lo AND hi GROUP BY 1, 2, 3)""", "results")
def _(spark, sf):
    return metrics.histogram(base.results(spark, sf), ["exposure_id", "strategy"], X, 360, 0.005, 0.995, ["exposure_id"])


@query("A29_return_histogram", "series_id:s bin:i n:i", """
    SELECT series_id, least(CAST(floor((simple - lo) / ((hi - lo) / 80)) AS BIGINT), 79) AS bin, count(*) AS n
    FROM (SELECT *, min(simple) OVER (PARTITION BY series_id) AS lo, max(simple) OVER (PARTITION BY series_id) AS hi FROM rets
          WHERE simple IS NOT NULL) GROUP BY 1, 2""", "rets")
def _(spark, sf):
    w = Window.partitionBy("series_id").orderBy("d")
    r = base.filled(spark, sf).withColumn("r", returns.simple_return(F.col("value"), w)).where("r IS NOT NULL")
    return metrics.histogram(r, ["series_id"], "r", 80)


@query("W47_running_lpm", "strategy:s end_date:d scenario_id:s cum_lpm:r cum_root_lpm:r", f"""
    SELECT strategy, end_date, scenario_id, c AS cum_lpm, sqrt(c) AS cum_root_lpm FROM (
      SELECT *, sum(greatest(-{X}, 0) ** 2) OVER (PARTITION BY strategy ORDER BY end_date, scenario_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM results)""", "results")
def _(spark, sf):
    return metrics.running_lpm(base.results(spark, sf), ["strategy"], "end_date", "scenario_id", X)


@query("W35_drawdown_forms", "scenario_id:s strategy:s mdd_peak_first:f4 mdd_peak_zero:f4", """
    SELECT scenario_id, strategy, min(equity - pk) AS mdd_peak_first, max(greatest(pk, 0) - equity) AS mdd_peak_zero
    FROM (SELECT *, max(equity) OVER (PARTITION BY scenario_id, strategy ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING
                 AND CURRENT ROW) AS pk FROM tdays) GROUP BY 1, 2""", "tdays")
def _(spark, sf):
    d = base.daily(spark, sf)
    w = Window.partitionBy("scenario_id", "strategy").orderBy("pos")
    d = d.withColumns({"a": pnl.drawdown(F.col("equity"), w), "b": pnl.drawdown(F.col("equity"), w, 0.0)})
    return d.groupBy("scenario_id", "strategy").agg(F.min("a").alias("mdd_peak_first"), (-F.min("b")).alias("mdd_peak_zero"))


@query("A1_coverage", "series_id:s start_date:d end_date:d n_obs:i missing_pct:f8 missing_flag:s", """
    SELECT *, CASE WHEN missing_pct >= 0.2 THEN 'HIGH' WHEN missing_pct >= 0.05 THEN 'WARN' ELSE 'OK' END AS missing_flag
    FROM (SELECT series_id, min(CASE WHEN price IS NOT NULL THEN d END) AS start_date, max(CASE WHEN price IS NOT NULL THEN d END)
                 AS end_date, count(price) AS n_obs, 1 - count(price) / (SELECT count(*) FROM days) AS missing_pct FROM raw GROUP BY 1)""",
       "raw days")
def _(spark, sf):
    raw = base.raw_panel(spark, sf)
    total = raw.agg(F.count_distinct("d")).scalar()
    per = raw.groupBy("series_id").agg(
        F.count("price").alias("n_obs"), F.min(F.when(F.col("price").isNotNull(), F.col("d"))).alias("start_date"),
        F.max(F.when(F.col("price").isNotNull(), F.col("d"))).alias("end_date"))
    m = F.col("missing_pct")
    return per.withColumn("missing_pct", 1 - F.col("n_obs") / total).withColumn(
        "missing_flag", F.when(m >= audit.HIGH, "HIGH").when(m >= audit.WARN, "WARN").otherwise("OK"))


def _desc(x, src):
    return (f"SELECT series_id, count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, " + ", ".join(
        f"quantile_cont({x}, {p}) AS {q}" for q, p in audit.QS.items()) +
        f", max({x}) AS max, skewness({x}) AS skew, kurtosis({x}) AS kurtosis_excess FROM {src} GROUP BY 1")


_DS = "series_id:s n:i mean:g std:g min:f4 q01:g q05:g q50:g q95:g q99:g max:f4 skew:f6 kurtosis_excess:f6"


@query("A2_describe", _DS, _desc("price", "raw"), "raw")
def _(spark, sf):
    return audit.describe(base.raw_panel(spark, sf), "price")


add_cte("hyb", "SELECT *, coalesce(lr, simple) AS used, CAST(lr IS NULL AND simple IS NOT NULL AS INT) AS used_simple FROM rets")


@query("A3_return_stats", _DS + " n_log:i n_simple:i",
       "SELECT * FROM (" + _desc("used", "hyb") + ") JOIN (SELECT series_id, count(lr) AS n_log, sum(used_simple) AS n_simple FROM hyb GROUP BY 1) USING (series_id)",
       "hyb")
def _(spark, sf):
    w = Window.partitionBy("series_id").orderBy("d")
    used, flag = returns.hybrid_return(F.col("value"), w)
    r = base.filled(spark, sf).withColumns({"used": used, "flag": flag, "lr": returns.log_return(F.col("value"), w)})
    n = r.groupBy("series_id").agg(F.count("lr").alias("n_log"), F.sum("flag").alias("n_simple"))
    return audit.describe(r, "used").join(n, "series_id")


@query("A4_trading_days", "series_id:s total_days:i tradable_days:i non_tradable_days:i non_tradable_weekend:i non_tradable_weekday:i non_tradable_pct:f8", """
    SELECT series_id, count(*) AS total_days, sum(updated) AS tradable_days, sum(1 - updated) AS non_tradable_days,
           sum(CASE WHEN isodow(d) >= 6 THEN 1 - updated ELSE 0 END) AS non_tradable_weekend,
           sum(CASE WHEN isodow(d) < 6 THEN 1 - updated ELSE 0 END) AS non_tradable_weekday,
           sum(1 - updated) / count(*) AS non_tradable_pct FROM filled GROUP BY 1""", "filled")
def _(spark, sf):
    return audit.trading_days(base.filled(spark, sf), "updated", "series_id")


@query("W42_outliers", "series_id:s d:d used:f9 zscore:f6", """
    SELECT series_id, d, used, z AS zscore FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d) AS rn FROM (
      SELECT *, (used - avg(used) OVER w) / nullif(stddev_samp(used) OVER w, 0) AS z FROM hyb WHERE used IS NOT NULL
      WINDOW w AS (PARTITION BY series_id)) WHERE abs(z) >= 6)""", "hyb")
def _(spark, sf):
    w = Window.partitionBy("series_id").orderBy("d")
    r = base.filled(spark, sf).withColumn("used", returns.hybrid_return(F.col("value"), w)[0])
    return audit.outliers(r, "used")


add_cte("acfs", """
    SELECT series_id, lag, coalesce(sum(p), 0) / sum(c * c) AS acf FROM (
      SELECT series_id, d, c, unnest(range(1, 31)) AS lag, unnest([""" + ", ".join(
        f"c * lag(c, {k}) OVER (PARTITION BY series_id ORDER BY d)" for k in range(1, 31)) + """]) AS p
      FROM (SELECT series_id, d, lr - avg(lr) OVER (PARTITION BY series_id) AS c FROM rets WHERE lr IS NOT NULL))
    GROUP BY 1, 2 HAVING count(*) >= 35""")


def _acf(spark, sf):
    w = Window.partitionBy("series_id").orderBy("d")
    return audit.acf(base.filled(spark, sf).withColumn("lr", returns.log_return(F.col("value"), w)), "lr", 30)


@query("W41_acf", "series_id:s lag:i acf:f7", "SELECT * FROM acfs", "acfs")
def _(spark, sf):
    return _acf(spark, sf)


@query("W41_pacf", "series_id:s lag:i pacf:f7", """
    WITH RECURSIVE r AS (SELECT series_id, list(acf ORDER BY lag) AS r FROM acfs GROUP BY 1),
    p AS (SELECT series_id, r, 1 AS k, [r[1]] AS phi, r[1] AS a FROM r UNION ALL
          SELECT series_id, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - b * phi[k + 1 - j]), b), b FROM (
            SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])))
                      / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS b FROM p WHERE k < len(r)))
    SELECT series_id, k AS lag, a AS pacf FROM p""", "acfs")
def _(spark, sf):
    return audit.pacf(_acf(spark, sf))


add_cte("fret", "SELECT series_id, d, CASE WHEN value > 0 AND p > 0 THEN lr END AS value FROM rets")
add_cte("fpairs", """SELECT a.series_id AS feature_i, b.series_id AS feature_j, a.d, a.value AS a, b.value AS b FROM fret a
    JOIN fret b ON a.d = b.d AND a.series_id < b.series_id AND a.value IS NOT NULL AND b.value IS NOT NULL""")
add_cte("pcorr", "SELECT feature_i, feature_j, count(*) AS n, corr(a, b) AS corr FROM fpairs GROUP BY 1, 2 HAVING count(*) >= 30")


def _pairs(spark, sf):
    w = Window.partitionBy("series_id").orderBy("d")
    f = base.filled(spark, sf).withColumn("r", returns.log_return(F.col("value"), w))
    return features.feature_pairs(f.select("series_id", "d", F.col("r").alias("value")))


def _corr(spark, sf):
    w = Window.partitionBy("series_id").orderBy("d")
    return features.pearson_panel(base.filled(spark, sf).withColumn("r", returns.log_return(F.col("value"), w)), value="r")


@query("A6_pearson", "feature_i:s feature_j:s n:i corr:f8", "SELECT * FROM pcorr", "pcorr")
def _(spark, sf):
    return _corr(spark, sf)


@query("A7_spearman", "feature_i:s feature_j:s n:i corr:f8", """
    SELECT feature_i, feature_j, count(*) AS n, corr(ra, rb) AS corr FROM (
      SELECT *, rank() OVER (PARTITION BY feature_i, feature_j ORDER BY a) + (count(*) OVER (PARTITION BY feature_i, feature_j, a) - 1) / 2.0 AS ra,
             rank() OVER (PARTITION BY feature_i, feature_j ORDER BY b) + (count(*) OVER (PARTITION BY feature_i, feature_j, b) - 1) / 2.0 AS rb
      FROM fpairs) GROUP BY 1, 2 HAVING count(*) >= 30""", "fpairs")
def _(spark, sf):
    return features.spearman(_pairs(spark, sf))


@query("J19_feature_pairs", "feature_i:s feature_j:s n:i sum_ab:f7", "SELECT feature_i, feature_j, count(*) AS n, sum(a * b) AS sum_ab FROM fpairs GROUP BY 1, 2", "fpairs")
def _(spark, sf):
    return _pairs(spark, sf).groupBy("feature_i", "feature_j").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("sum_ab"))


_THR = 0.01  # a level that links some of the nearly independent fixture series


@query("D3_top_pairs", "feature_i:s feature_j:s corr:f8 abs_corr:f8",
       f"SELECT *, abs(corr) AS abs_corr FROM pcorr WHERE abs(corr) >= {_THR} ORDER BY abs(corr) DESC, feature_i, feature_j LIMIT 10", "pcorr")
def _(spark, sf):
    return features.top_pairs(_corr(spark, sf), 10, _THR)


add_cte("edge", f"""SELECT feature_i, feature_j, corr FROM pcorr WHERE abs(corr) >= {_THR} UNION ALL
    SELECT feature_j, feature_i, corr FROM pcorr WHERE abs(corr) >= {_THR}""")


@query("D5_connected_groups", "group_size:i group_id:i feature:s", """
    WITH RECURSIVE reach AS (SELECT feature_i AS f, feature_i AS g FROM edge UNION SELECT r.f, e.feature_j FROM reach r
                             JOIN edge e ON e.feature_i = r.g),
         lab AS (SELECT f, min(g) AS label FROM reach GROUP BY 1),
         sz AS (SELECT label, count(*) AS group_size FROM lab GROUP BY 1 HAVING count(*) >= 2)
    SELECT s.group_size, s.group_id, l.f AS feature FROM lab l JOIN (SELECT *, row_number() OVER (ORDER BY group_size DESC, label)
        AS group_id FROM sz) s USING (label)""", "edge")
def _(spark, sf):
    return features.connected_groups(features.edges(_corr(spark, sf), _THR))


@query("D4_greedy_prune", "feature:s kept_feature:s corr:f8 abs_corr:f8", """
    WITH RECURSIVE pri AS (SELECT series_id AS f, row_number() OVER (ORDER BY count(price) DESC, series_id) AS k FROM raw GROUP BY 1),
      walk AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS kept UNION ALL
        SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM edge e WHERE e.feature_i = p.f AND list_contains(w.kept, e.feature_j))
                             THEN w.kept ELSE list_append(w.kept, p.f) END
        FROM walk w JOIN pri p ON p.k = w.k + 1),
      fin AS (SELECT kept FROM walk ORDER BY k DESC LIMIT 1)
    SELECT feature, kept_feature, corr, abs(corr) AS abs_corr FROM (
      SELECT p.f AS feature, e.feature_j AS kept_feature, e.corr, row_number() OVER (PARTITION BY p.f ORDER BY q.k) AS rn
      FROM pri p, fin JOIN edge e ON e.feature_i = p.f JOIN pri q ON q.f = e.feature_j
      WHERE NOT list_contains(kept, p.f) AND list_contains(kept, e.feature_j)) WHERE rn = 1""", "edge raw")
def _(spark, sf):
    pri = base.raw_panel(spark, sf).groupBy(F.col("series_id").alias("feature")).agg(F.count("price").alias("priority"))
    return features.greedy_prune(features.edges(_corr(spark, sf), _THR), pri)[1]


@query("P7_coverage_filter", "series_id:s", """
    SELECT series_id FROM raw GROUP BY 1 HAVING count(price) / (SELECT count(*) FROM days) >= 0.5 OR series_id = '3-MEDIUM'
    OR regexp_full_match(series_id, '[45]-.*')""", "raw days")
def _(spark, sf):
    raw = base.raw_panel(spark, sf)
    cov = audit.coverage(raw, "price", total=raw.agg(F.count_distinct("d")).scalar())
    return features.coverage_filter(cov, 0.5, ["3-MEDIUM"], "[45]-.*")


@query("A13_omega_without_loss", KS + " n:i omega:g", f"""
    SELECT {KSQL}, count(*) AS n, CASE WHEN sum(greatest(-1e12 - {X}, 0)) > 0 THEN sum(greatest({X} + 1e12, 0)) / sum(greatest(-1e12 - {X}, 0)) ELSE 1e300 END AS omega
    FROM results GROUP BY ALL""", "results")
def _(spark, sf):
    m = base.results(spark, sf).groupBy(*K).agg(F.count("*").alias("n"), metrics.omega(F.col(X), -1e12, float("inf")).alias("omega"))
    return m.withColumn("omega", F.least("omega", F.lit(1e300)))  # infinity has no digits to compare


@query("W35_drawdown_start_equity", "scenario_id:s strategy:s mdd:f4", """
    SELECT scenario_id, strategy, max(greatest(pk, volume_bbl) - e) AS mdd FROM (
      SELECT *, max(e) OVER (PARTITION BY scenario_id, strategy ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk
      FROM (SELECT *, equity + volume_bbl AS e FROM tdays)) GROUP BY 1, 2""", "tdays")
def _(spark, sf):
    w = Window.partitionBy("scenario_id", "strategy").orderBy("pos")
    d = base.daily(spark, sf).withColumn("e", F.col("equity") + F.col("volume_bbl"))
    peak = F.greatest(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("volume_bbl"))
    return d.withColumn("dd", peak - F.col("e")).groupBy("scenario_id", "strategy").agg(F.max("dd").alias("mdd"))


@query("A29_ecdf", "exposure_id:s strategy:s rank:i value:f4 share:f9", f"""
    SELECT exposure_id, strategy, rank, v AS value, rank / n AS share FROM (
      SELECT exposure_id, strategy, v, sum(c) OVER (PARTITION BY exposure_id, strategy ORDER BY v) AS rank, sum(c) OVER (PARTITION BY exposure_id, strategy) AS n
      FROM (SELECT exposure_id, strategy, {X} AS v, count(*) AS c FROM results GROUP BY 1, 2, 3))""", "results")
def _(spark, sf):
    return metrics.ecdf(base.results(spark, sf), ["exposure_id", "strategy"], X)
