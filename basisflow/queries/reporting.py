"""Queries of report parsing, enrichment, alignment and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from basisflow.functions.core import null_text
from basisflow.operators import report, validate
from basisflow.plans.ordered import keep_first, keep_last
from basisflow.queries import base
from basisflow.queries.registry import query
from basisflow.queries.sqlbase import add_cte
from basisflow.sources import market

# result file names in the spellings found in practice, one per order
add_cte("files", """
    SELECT o_orderkey AS n, CASE o_orderkey % 6
      WHEN 0 THEN 'FINAL/' || o_orderpriority || '/baseline/hedge__scenarios_baseline__naive__w' || (30 * (1 + o_custkey % 4)) || '__dynamic__roll__x.parquet'
      WHEN 1 THEN 'out/' || o_orderpriority || '/run__oracle_universe__' || o_orderstatus || '__wNA__static__no_roll__.parquet'
      WHEN 2 THEN 'sum-w' || (60 + o_custkey % 9) || '_company_' || o_orderstatus || '.csv'
      WHEN 3 THEN 'grid window=' || (100 + o_custkey % 20) || ' TEST:ALL'
      WHEN 4 THEN o_orderpriority || '/oracle_all/extreme__STATIC__NOROLL__w1'
      ELSE 'misc-' || o_custkey END AS path,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 END AS flag,
      CASE o_custkey % 12 WHEN 0 THEN 'No Hedge' WHEN 1 THEN 'NAIVE' WHEN 2 THEN 'ols_roll' WHEN 3 THEN 'Static OLS' WHEN 4 THEN 'sac'
        WHEN 5 THEN 'my-CCC-Garch' WHEN 6 THEN 'dcc_garch_v2' WHEN 7 THEN 'naive hedge' WHEN 8 THEN 'rl_ppo' ELSE 'Other' END AS strategy,
      CASE o_custkey % 9 WHEN 0 THEN 'EXTREME_DAILY_BEST' WHEN 1 THEN 'feasible_monthly_worst' WHEN 2 THEN 'Extreme-Weekly BEST' WHEN 3 THEN ''
        WHEN 4 THEN 'nan' WHEN 5 THEN NULL WHEN 6 THEN 'FEASIBLE' WHEN 7 THEN 'custom__x_BEST' ELSE 'EXTREME_QUARTERLY' END AS oracle_series
    FROM orders""")


def _files(spark, sf):
    k, c, p, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    t = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    def case(e, values, other):
        out = F
        for i, v in enumerate(values):
            out = out.when(e == i, v if v is None else (F.lit(v) if isinstance(v, str) else v))
        return out.otherwise(other)
    path = case(k % 6, [
        t("FINAL/", p, "/baseline/hedge__scenarios_baseline__naive__w", 30 * (1 + c % 4), "__dynamic__roll__x.parquet"),
        t("out/", p, "/run__oracle_universe__", s, "__wNA__static__no_roll__.parquet"),
        t("sum-w", 60 + c % 9, "_company_", s, ".csv"), t("grid window=", 100 + c % 20, " TEST:ALL"),
        t(p, "/oracle_all/extreme__STATIC__NOROLL__w1")], t("misc-", c))
    return market.table(spark, sf, "orders").select(
        k.alias("n"), path.alias("path"), F.when(k % 5 == 0, None).otherwise(k % 2).alias("flag"),
        case(c % 12, ["No Hedge", "NAIVE", "ols_roll", "Static OLS", "sac", "my-CCC-Garch", "dcc_garch_v2", "naive hedge", "rl_ppo"],
             F.lit("Other")).alias("strategy"),
        case(c % 9, ["EXTREME_DAILY_BEST", "feasible_monthly_worst", "Extreme-Weekly BEST", "", "nan", F.lit(None).cast("string"),
                     "FEASIBLE", "custom__x_BEST"], F.lit("EXTREME_QUARTERLY")).alias("oracle_series"))


@query("P15_strategy_name", "strategy:s name:s n:i", """
    SELECT strategy, CASE WHEN s IN ('nohedge', 'no_hedge') THEN 'NoHedge' WHEN s IN ('naive', 'naivehedge', 'naive_hedge') THEN 'Naive'
      WHEN s IN ('olsstatic', 'ols_static', 'static_ols') THEN 'OLSStatic' WHEN s IN ('olsrolling', 'ols_roll', 'rolling_ols') THEN 'OLSRolling'
      WHEN s IN ('rl', 'rl_ppo', 'ppo', 'sac') THEN 'Policy' WHEN contains(s, 'ccc') AND contains(s, 'garch') THEN 'CCCGarchProxyStrategy'
      WHEN contains(s, 'dcc') AND contains(s, 'garch') THEN 'DCCGarchStrategy' ELSE strategy END AS name, count(*) AS n
    FROM (SELECT *, replace(lower(strategy), ' ', '_') AS s FROM files) GROUP BY 1, 2""", "files")
def _(spark, sf):
    return (_files(spark, sf).withColumn("name", report.strategy_name(F.col("strategy")))
            .groupBy("strategy", "name").agg(F.count("*").alias("n")))


add_cte("parsed", r"""
    SELECT n, strategy, flag, CASE WHEN upper(w) = 'NA' THEN NULL ELSE TRY_CAST(w AS INT) END AS "window",
      CASE WHEN flag IS NOT NULL THEN CASE WHEN flag <> 0 THEN 'dynamic' ELSE 'static' END
           ELSE lower(nullif(regexp_extract(path, '(?i)__(dynamic|static)__', 1), '')) END AS mode,
      CASE WHEN r = 'roll' THEN 'roll' WHEN r IS NOT NULL THEN 'noroll' END AS roll,
      CASE WHEN contains(p, 'univ') THEN 'oracle_universe' WHEN contains(p, 'test:all') OR contains(p, 'oracle_all') THEN 'oracle_all'
           WHEN contains(p, 'baseline') OR contains(p, 'base_') THEN 'baseline' WHEN contains(p, 'company') THEN 'company' ELSE 'unknown' END AS kind,
      list_filter(string_split(path, '/'), lambda x: x IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))[1] AS asset
    FROM (SELECT *, lower(path) AS p, replace(lower(nullif(regexp_extract(path, '(?i)__(roll|noroll|no_roll|no-roll)__', 1), '')), '_', '-') AS r,
      coalesce(nullif(regexp_extract(path, '(?i)__w(\d+|NA)__', 1), ''), nullif(regexp_extract(path, '(?i)(?:^|[|_\-])w(\d{2,4})(?:[|_\-]|$)', 1), ''),
               nullif(regexp_extract(path, '(?i)(?:window|win)[_=\-]?(\d{2,4})', 1), '')) AS w FROM files)""")


def _parsed(spark, sf):
    f = _files(spark, sf)
    p = F.col("path")
    return f.withColumns({"window": report.window_of(p), "mode": report.mode_of(p, F.col("flag")), "roll": report.roll_of(p),
                          "kind": report.kind_of(p), "asset": report.asset_of(p, list(market.PRIORITIES))})


@query("P16_run_settings", "n:i window:i mode:s roll:s kind:s asset:s", "SELECT * FROM parsed", "parsed")
def _(spark, sf):
    return _parsed(spark, sf)


@query("P18_run_key", "run_key:s n_runs:i", """
    SELECT concat_ws('|', asset, kind, strategy, 'w' || coalesce(CAST("window" AS VARCHAR), 'NA'), mode, roll) AS run_key, count(*) AS n_runs
    FROM parsed GROUP BY 1""", "parsed")
def _(spark, sf):
    p = _parsed(spark, sf).withColumnsRenamed({"asset": "exposure_id", "kind": "scenario_kind"})
    return p.withColumn("run_key", report.run_key()).groupBy("run_key").agg(F.count("*").alias("n_runs"))


@query("P23_metadata_probe", "window_known:f8 mode_unknown:f8 roll_unknown:f8 needs_rebuild:i", """
    SELECT avg(CAST("window" IS NOT NULL AS INT)) AS window_known, avg(CAST(mode IS NULL AS INT)) AS mode_unknown,
           avg(CAST(roll IS NULL AS INT)) AS roll_unknown, CAST(avg(CAST("window" IS NOT NULL AS INT)) < 0.1 AND
           avg(CAST(mode IS NULL AS INT)) > 0.8 AND avg(CAST(roll IS NULL AS INT)) > 0.8 AS INT) AS needs_rebuild FROM parsed""", "parsed")
def _(spark, sf):
    return report.metadata_probe(_parsed(spark, sf))


@query("P17_oracle_labels", "oracle_series:s pool:s freq:s label:s pool_word:s freq_word:s label_word:s bucket:s n:i", r"""
    SELECT oracle_series, ps[1] AS pool, ps[2] AS freq, CASE WHEN ps[-1] IN ('BEST', 'WORST') THEN ps[-1] END AS label,
      CASE WHEN list_contains(ws, 'EXTREME') THEN 'EXTREME' WHEN list_contains(ws, 'FEASIBLE') THEN 'FEASIBLE' ELSE 'unknown' END AS pool_word,
      CASE WHEN list_contains(ws, 'DAILY') THEN 'DAILY' WHEN list_contains(ws, 'WEEKLY') THEN 'WEEKLY' WHEN list_contains(ws, 'MONTHLY') THEN 'MONTHLY'
           WHEN list_contains(ws, 'QUARTERLY') THEN 'QUARTERLY' ELSE 'unknown' END AS freq_word,
      CASE WHEN list_contains(ws, 'BEST') THEN 'BEST' WHEN list_contains(ws, 'WORST') THEN 'WORST' ELSE 'unknown' END AS label_word,
      CASE WHEN oracle_series IS NULL OR oracle_series = '' THEN NULL WHEN contains(lower(oracle_series), 'extreme') THEN 'oracle_extreme'
           WHEN contains(lower(oracle_series), 'feasible') THEN 'oracle_feasible' ELSE 'oracle_other' END AS bucket, count(*) AS n
    FROM (SELECT *, list_filter(string_split(upper(t), '_'), lambda x: x <> '') AS ps, regexp_split_to_array(upper(coalesce(t, '')), '[_\-\s]+') AS ws
          FROM (SELECT *, CASE WHEN oracle_series IN ('', 'nan') THEN NULL ELSE oracle_series END AS t FROM files)) GROUP BY ALL""", "files")
def _(spark, sf):
    o = F.col("oracle_series")
    pos, words = report.oracle_parts(o), report.oracle_words(o)
    f = _files(spark, sf).withColumns({**dict(zip(("pool", "freq", "label"), pos)), **dict(zip(("pool_word", "freq_word", "label_word"), words)),
                                       "bucket": report.oracle_kind(o)})
    return f.groupBy("oracle_series", "pool", "freq", "label", "pool_word", "freq_word", "label_word", "bucket").agg(F.count("*").alias("n"))


@query("P17_canonical_oracle", "n:i scenario_kind:s oracle_pool:s label:s", """
    SELECT n, CASE WHEN contains(full_, 'EXTREME') THEN 'oracle_extreme' WHEN contains(full_, 'FEASIBLE') THEN 'oracle_feasible'
                   ELSE scenario_kind END AS scenario_kind, oracle_pool, label
    FROM (SELECT *, upper(scenario_kind || '__' || oracle_series || '__' || oracle_pool || '__' || tag || '__' || label) AS full_ FROM (
      SELECT n, scenario_kind, oracle_series, tag, CASE WHEN contains(t, 'WORST') THEN 'WORST' WHEN contains(t, 'BEST') THEN 'BEST' ELSE 'unknown' END AS label,
             CASE WHEN contains(t, 'EXTREME') THEN 'EXTREME' WHEN contains(t, 'FEASIBLE') THEN 'FEASIBLE' ELSE 'unknown' END AS oracle_pool
      FROM (SELECT *, upper(scenario_kind || '__' || oracle_series || '__unknown__unknown__' || tag) AS t FROM (
        SELECT n, 'oracle_all' AS scenario_kind, coalesce(oracle_series, 'unknown') AS oracle_series, path AS tag FROM files))))""", "files")
def _(spark, sf):
    f = _files(spark, sf).select("n", F.lit("oracle_all").alias("scenario_kind"), "oracle_series", F.lit(None).cast("string").alias("oracle_pool"),
                                 F.lit(None).cast("string").alias("label"), F.col("path").alias("tag"))
    return report.canonical_oracle(f)


@query("P14_report_schema", "scenario_id:s strategy:s net_pnl_total:f4 gross_pnl_total:f4 total_cost:f4", """
    SELECT scenario_id, strategy, net_pnl_total, spot_pnl_total + fut_pnl_total AS gross_pnl_total, cost_trade_total AS total_cost
    FROM results""", "results")
def _(spark, sf):
    r = base.results(spark, sf).select(
        "scenario_id", "strategy", F.col("net_pnl_total").alias("pnl_net_sum"), F.col("cost_trade_total").alias("cost_sum"), "spot_pnl_total", "fut_pnl_total")
    return report.report_schema(r)


@query("P13_contract", "n_rows:i identity_violations:i oracle_rows_without_record_id:i splits:s windows:s", """
    SELECT count(*) AS n_rows, count(*) FILTER (off <> 0) AS identity_violations, count(*) FILTER (kind = 'oracle_all') AS oracle_rows_without_record_id, 'NA' AS splits, 'full' AS windows
    FROM (SELECT CASE WHEN n_days % 4 = 0 THEN 1 ELSE 0 END AS off, CASE WHEN n_days % 5 = 0 THEN 'oracle_all' ELSE scenario_kind END AS kind FROM results)""", "results")
def _(spark, sf):
    r = base.results(spark, sf)
    bent = r.withColumn("net_pnl_total", F.when(F.col("n_days") % 4 == 0, F.col("net_pnl_total") + 1).otherwise(
        F.col("spot_pnl_total") + F.col("fut_pnl_total") - F.col("cost_trade_total") - F.col("cost_roll_total")))
    bent = bent.withColumn("scenario_kind", F.when(F.col("n_days") % 5 == 0, "oracle_all").otherwise(F.col("scenario_kind")))
    d, _ = validate.conform(bent.withColumnsRenamed({"scenario_kind": "kind", "strategy": "model", "net_pnl_total": "pnl_total"}))
    names = d.agg(F.max("split").alias("splits"), F.max("window_id").alias("windows"))
    return validate.contract_notes(d).withColumns({"splits": names.select("splits").scalar(), "windows": names.select("windows").scalar()})


#: faults laid into the trades: every rule of the checks meets some
_FAULTS = {
    "scenario_kind": "CASE WHEN trade_no % 50 = 0 THEN 'odd' WHEN trade_no % 51 = 0 THEN NULL WHEN trade_no % 7 = 0 THEN 'oracle_all' ELSE scenario_kind END",
    "volume_bbl": "CASE WHEN trade_no % 56 = 0 THEN NULL ELSE volume_bbl END",
    "horizon_days_realized": "CASE WHEN trade_no % 54 = 0 THEN horizon_days_target + 1 WHEN trade_no % 55 = 0 THEN 1000 ELSE horizon_days_realized END",
    "end_date": "CASE WHEN trade_no % 53 = 0 THEN start_date - INTERVAL 1 DAY WHEN trade_no % 59 = 0 THEN NULL ELSE end_date END",
    "oracle_series": "CASE WHEN trade_no % 7 = 0 THEN CASE WHEN trade_no % 21 = 0 THEN '' ELSE 'EXTREME' END END",
    "scenario_record_id": "CASE WHEN trade_no % 14 = 0 THEN 'R' || (trade_no % 1400) WHEN trade_no % 35 = 0 THEN '' END",
    "scenario_id": "concat_ws('|', company_id, start_date)",
    "start_date": "CASE WHEN trade_no % 57 = 0 THEN NULL ELSE start_date END",
}
_RULES = {
    **{f"{k}_present": f"{k} IS NULL" for k in ("scenario_id", "exposure_id", "start_date", "end_date", "volume_bbl", "scenario_kind")},
    "kind_allowed": "scenario_kind NOT IN (" + ", ".join(f"'{k}'" for k in validate.SCENARIO_KINDS) + ")",
    "end_not_before_start": "end_date < start_date", "realized_within_target": "horizon_days_realized > horizon_days_target",
    "realized_within_span": "horizon_days_realized > CAST(end_date AS DATE) - CAST(start_date AS DATE) + 5", "exposure_matches": "exposure_id <> 'N'",
    "label_present": "scenario_kind = 'oracle_all' AND trim(coalesce(oracle_series, '')) = ''",
    "record_id_present": "scenario_kind = 'oracle_all' AND trim(coalesce(scenario_record_id, '')) = ''",
}
add_cte("faulty", "SELECT exposure_id, horizon_days_target, company_id, trade_no, " + ", ".join(f"{e} AS {c}" for c, e in _FAULTS.items()) + " FROM trades")


def _twice(name, keys, where):
    key = f"concat_ws('|', {keys})"
    return (f"SELECT '{name}', coalesce(sum(n), 0), min(k) FROM (SELECT count(*) AS n, {key} AS k FROM faulty WHERE {where} GROUP BY {keys} HAVING count(*) > 1)")


@query("P25_scenario_checks", "check:s ok:i n_bad:i sample:s", "SELECT c AS \"check\", CAST(b = 0 AS INT) AS ok, b AS n_bad, k AS sample FROM (" + " UNION ALL ".join(
    [f"SELECT '{n}' AS c, count(*) FILTER ({e}) AS b, min(CASE WHEN {e} THEN scenario_id END) AS k FROM faulty" for n, e in _RULES.items()]
    + [_twice("record_id_unique", "scenario_record_id", "scenario_kind = 'oracle_all' AND scenario_record_id IS NOT NULL"),
       _twice("label_unique", "scenario_id, oracle_series", "scenario_kind = 'oracle_all'"), _twice("id_unique", "scenario_id", "scenario_kind <> 'oracle_all'")]) + ")", "faulty")
def _(spark, sf):
    t = base.trades(spark, sf)
    return validate.scenario_checks(t.select("exposure_id", "horizon_days_target", "company_id", "trade_no", *[F.expr(e).alias(c) for c, e in _FAULTS.items()]), "N")


_BENT = """SELECT * REPLACE (CASE WHEN substr(scenario_id, 2)::BIGINT % 13 = 0 THEN 'odd' ELSE scenario_kind END AS scenario_kind,
    CASE WHEN strategy = 'nohedge' AND exposure_id = '5-LOW' THEN 0 ELSE net_pnl_total END AS net_pnl_total)
    FROM results WHERE NOT (strategy = 'naive' AND company_size = 'SMALL')"""


@query("P26_result_checks", "check:s ok:i n_bad:i", f"""
    WITH b AS ({_BENT}), c AS (
      SELECT 'kinds_allowed' AS c, count(*) FILTER (scenario_kind = 'odd') AS n FROM b
      UNION ALL SELECT 'ids_known', count(*) FROM b WHERE substr(scenario_id, 2)::BIGINT % 10 = 0
      UNION ALL SELECT 'strategies_even', count(*) FROM (SELECT exposure_id, scenario_kind FROM (SELECT exposure_id, scenario_kind, strategy, count(DISTINCT scenario_id) AS n
        FROM b GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING min(n) <> max(n))
      UNION ALL SELECT 'nohedge_varies', count(*) FROM (SELECT exposure_id, scenario_kind FROM b WHERE strategy = 'nohedge' GROUP BY 1, 2
        HAVING NOT coalesce(var_pop(net_pnl_total) > 0, false)))
    SELECT c AS "check", CAST(n = 0 AS INT) AS ok, n AS n_bad FROM c""", "results")
def _(spark, sf):
    r = base.results(spark, sf).where("NOT (strategy = 'naive' AND company_size = 'SMALL')")
    r = r.withColumns({"scenario_kind": F.when(F.substring("scenario_id", 2, 20).cast("long") % 13 == 0, "odd").otherwise(F.col("scenario_kind")),
                       "net_pnl_total": F.when((F.col("strategy") == "nohedge") & (F.col("exposure_id") == "5-LOW"), 0.0).otherwise(F.col("net_pnl_total"))})
    known = base.trades(spark, sf).where("trade_no % 10 <> 0")
    return validate.result_checks(r, known)


@query("P27_id_overlap", "a:s b:s n_shared:i", """
    WITH s AS (SELECT DISTINCT o_custkey AS scenario_id, o_orderpriority AS scenario_kind FROM orders)
    SELECT x.scenario_kind AS a, y.scenario_kind AS b, count(*) AS n_shared FROM s x JOIN s y ON x.scenario_id = y.scenario_id
    AND x.scenario_kind < y.scenario_kind GROUP BY 1, 2""")
def _(spark, sf):
    o = market.table(spark, sf, "orders").select(F.col("o_custkey").alias("scenario_id"), F.col("o_orderpriority").alias("scenario_kind"))
    return validate.id_overlap(o)


@query("P8_P9_P10_filters", "trade_no:i exposure_id:s data_coverage_flag:s inside:i overlaps:i", """
    SELECT trade_no, exposure_id, data_coverage_flag, CAST(start_date >= DATE '1996-06-01' AND end_date <= DATE '1999-12-31' AS INT) AS inside,
           CAST(end_date >= DATE '1996-06-01' AND start_date <= DATE '1999-12-31' AS INT) AS overlaps
    FROM realised WHERE data_coverage_flag IN ('OK', 'SHORTENED') AND exposure_id IN ('N', '2-HIGH')""", "realised")
def _(spark, sf):
    a, b = F.lit("1996-06-01").cast("date"), F.lit("1999-12-31").cast("date")
    t = base.realised(spark, sf).where(F.col("data_coverage_flag").isin("OK", "SHORTENED") & F.col("exposure_id").isin("N", "2-HIGH"))
    return t.withColumns({"inside": ((F.col("start_date") >= a) & (F.col("end_date") <= b)).cast("int"),
                          "overlaps": ((F.col("end_date") >= a) & (F.col("start_date") <= b)).cast("int")})


@query("P11_dynamic_roll_rows", "mode:s roll:s n:i", """
    SELECT mode, roll, count(*) AS n FROM parsed WHERE lower(mode) = 'dynamic' AND lower(roll) IN ('roll', 'rolling') GROUP BY 1, 2""", "parsed")
def _(spark, sf):
    p = _parsed(spark, sf).where((F.lower("mode") == "dynamic") & F.lower("roll").isin("roll", "rolling"))
    return p.groupBy("mode", "roll").agg(F.count("*").alias("n"))


@query("P12_complete_features", "series_id:s", "SELECT series_id FROM filled GROUP BY 1 HAVING count(value) = count(*) AND count(raw) < count(*)", "filled")
def _(spark, sf):
    return base.filled(spark, sf).groupBy("series_id").agg(
        (F.count("value") == F.count("*")).alias("full"), (F.count("raw") < F.count("*")).alias("gaps")).where("full AND gaps").select("series_id")


@query("P22_config_key", "key:s n:i", """
    SELECT printf('%.10f', round(l_discount, 2)) || '|' || printf('%.10f', round(l_tax, 2)) || '|' || CAST(l_linenumber AS BIGINT) AS key, count(*) AS n
    FROM lineitem GROUP BY 1""")
def _(spark, sf):
    k = report.config_key(["l_discount", "l_tax"], ["l_linenumber"])
    return market.table(spark, sf, "lineitem").groupBy(k.alias("key")).agg(F.count("*").alias("n"))


@query("J8_enrich", "n:i company_size:s strategy:s", """
    SELECT o_orderkey AS n, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'OWN' END, m.size) AS company_size,
           o_orderstatus AS strategy FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment AS size FROM customer WHERE c_custkey % 7 <> 0) m
           ON m.c_custkey = o_custkey""")
def _(spark, sf):
    k = F.col("o_orderkey") % 3
    o = market.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("strategy"),
        F.when(k == 0, None).when(k == 1, "Unknown").otherwise("OWN").alias("company_size"))
    m = market.table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("company_size"), F.lit(1).alias("row_no"))
    later = m.where("id % 2 = 0").withColumns({"company_size": F.lit("AAA"), "row_no": F.lit(2)})  # smaller in value, later in order
    return report.enrich(o, m.unionByName(later), "id", ["company_size"], ["row_no"])


@query("J9_fill_ids", "trade_no:i scenario_id:s", """
    SELECT r.trade_no, CASE WHEN r.trade_no % 2 = 0 THEN r.scenario_id ELSE f.id END AS scenario_id FROM trades r
    LEFT JOIN (SELECT start_date, horizon_days_target, exposure_id, 'T' || min(trade_no) AS id FROM trades GROUP BY 1, 2, 3) f
    USING (start_date, horizon_days_target, exposure_id)""", "trades")
def _(spark, sf):
    t = base.trades(spark, sf).select("trade_no", "scenario_id", "exposure_id", "start_date", "horizon_days_target")
    holes = t.withColumn("scenario_id", F.when(F.col("trade_no") % 2 == 0, F.col("scenario_id")))
    return report.fill_ids(holes, t, ["start_date", "horizon_days_target", "exposure_id"], ["trade_no"])


@query("J10_split_by_label", "exposure_id:s scenario_kind:s n:i", """
    SELECT exposure_id, CASE WHEN k = 'oracle_all' AND l IS NOT NULL THEN CASE WHEN contains(lower(l), 'extreme') THEN 'oracle_extreme'
           WHEN contains(lower(l), 'feasible') THEN 'oracle_feasible' ELSE 'oracle_other' END ELSE k END AS scenario_kind, count(*) AS n
    FROM (SELECT t.exposure_id, CASE WHEN t.trade_no % 4 = 0 THEN 'company' ELSE 'oracle_all' END AS k, CASE WHEN t.trade_no % 7 = 0 THEN 'FEASIBLE' WHEN t.trade_no % 3 > 0 AND t.trade_no % 5 = 0 THEN 'EXTREME' WHEN t.trade_no % 3 > 0 THEN f.oracle_series END AS l
          FROM trades t JOIN files f ON f.n = t.trade_no) GROUP BY 1, 2""".replace("l IS NOT NULL", "l IS NOT NULL AND l <> ''"), "trades files")
def _(spark, sf):
    t = base.trades(spark, sf).select("trade_no", "exposure_id", "scenario_id",
                                      F.when(F.col("trade_no") % 4 == 0, "company").otherwise("oracle_all").alias("scenario_kind"))
    lab = t.join(_files(spark, sf).withColumnRenamed("n", "trade_no"), "trade_no").where("trade_no % 3 > 0").select(
        "exposure_id", "scenario_id", "oracle_series", F.lit(1).alias("entry"), "trade_no")
    later = lab.where("trade_no % 5 = 0").withColumns({"oracle_series": F.lit("EXTREME"), "entry": F.lit(2)})
    own = t.withColumn("oracle_series", F.when(F.col("trade_no") % 7 == 0, "FEASIBLE"))
    return report.split_by_label(own, lab.unionByName(later), ["entry"]).groupBy("exposure_id", "scenario_kind").agg(F.count("*").alias("n"))


@query("J12_restrict_to_reference", "scenario_id:s strategy:s net_pnl_total:f4",
       "SELECT scenario_id, strategy, net_pnl_total FROM results WHERE substr(scenario_id, 2)::BIGINT % 3 = 1", "results")
def _(spark, sf):
    ref = base.trades(spark, sf).where("trade_no % 3 = 1").select("exposure_id", "scenario_kind", "scenario_id")
    return report.restrict_to_reference(base.results(spark, sf), ref)


@query("J13_common_scenarios", "exposure_id:s scenario_kind:s strategy:s n:i net:f4", """
    WITH r AS (SELECT * FROM results WHERE NOT (strategy = 'ols_roll' AND company_size = 'SMALL') AND NOT (exposure_id = '5-LOW' AND
                 (strategy <> 'naive')) AND NOT (exposure_id = '2-HIGH' AND (strategy = 'naive') = (company_size = 'LARGE'))),
         c AS (SELECT exposure_id, scenario_kind, scenario_id FROM r GROUP BY 1, 2, 3 HAVING count(DISTINCT strategy) =
               (SELECT count(DISTINCT strategy) FROM r q WHERE q.exposure_id = r.exposure_id AND q.scenario_kind = r.scenario_kind)),
         b AS (SELECT DISTINCT exposure_id, scenario_kind FROM c)
    SELECT exposure_id, scenario_kind, strategy, count(*) AS n, sum(net_pnl_total) AS net FROM r
    WHERE (exposure_id, scenario_kind, scenario_id) IN (SELECT (exposure_id, scenario_kind, scenario_id) FROM c)
       OR (exposure_id, scenario_kind) NOT IN (SELECT (exposure_id, scenario_kind) FROM b) GROUP BY 1, 2, 3""", "results")
def _(spark, sf):
    r = base.results(spark, sf).where(
        "NOT (strategy = 'ols_roll' AND company_size = 'SMALL') AND NOT (exposure_id = '5-LOW' AND strategy <> 'naive') "
        "AND NOT (exposure_id = '2-HIGH' AND (strategy = 'naive') = (company_size = 'LARGE'))")
    return report.common_scenarios(r, ["exposure_id", "scenario_kind"]).groupBy("exposure_id", "scenario_kind", "strategy").agg(
        F.count("*").alias("n"), F.sum("net_pnl_total").alias("net"))


def _grid(spark, sf):
    e = base.panel(spark, sf).select(F.col("series_id").alias("exposure_id")).distinct()
    return report.run_grid(e, ["baseline", "oracle_universe"], {"ols_roll": [30, 120], "ccc_garch": [120, 252]}, ["nohedge", "naive", "ols_static"])


add_cte("rgrid", """SELECT DISTINCT e.series_id AS exposure_id, k AS scenario_kind, v[1] AS strategy, TRY_CAST(v[2] AS INT) AS "window",
    CASE WHEN v[1] IN ('nohedge', 'naive') THEN 'static' ELSE m END AS mode, r AS roll
    FROM (SELECT DISTINCT series_id FROM panel) e, (SELECT unnest(['baseline', 'oracle_universe']) AS k),
    (SELECT unnest([['ols_roll', '30'], ['ols_roll', '120'], ['ccc_garch', '120'], ['ccc_garch', '252'], ['nohedge', NULL], ['naive', NULL],
    ['ols_static', NULL]]) AS v), (SELECT unnest(['dynamic', 'static']) AS m), (SELECT unnest(['roll', 'noroll']) AS r)""")


@query("J15_D7_run_grid", "exposure_id:s scenario_kind:s strategy:s window:i mode:s roll:s", "SELECT * FROM rgrid", "rgrid")
def _(spark, sf):
    return _grid(spark, sf)


@query("J14_remaining_runs", "exposure_id:s scenario_kind:s strategy:s window:i mode:s roll:s", """
    SELECT g.* FROM rgrid g WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.exposure_id = g.exposure_id AND r.scenario_kind = g.scenario_kind
    AND r.strategy = g.strategy AND g.mode = 'static' AND g.roll = 'roll' AND r.strategy IN ('naive', 'nohedge'))""", "rgrid results")
def _(spark, sf):
    done = base.results(spark, sf).where("strategy IN ('naive', 'nohedge')").select("exposure_id", "scenario_kind", "strategy").distinct()
    done = done.withColumns({"window": F.lit(None).cast("int"), "mode": F.lit("static"), "roll": F.lit("roll")})
    return report.remaining_runs(_grid(spark, sf), done.withColumn("run_key", report.run_key()))


@query("J17_policy_default", "exposure_id:s d:d h:f6", """
    SELECT c.exposure_id, c.d, coalesce(p.h, 1.0) AS h FROM cal c LEFT JOIN (SELECT exposure_id, d, h_roll AS h FROM hratio WHERE roll_flag = 0 AND d_fut > 0) p
    USING (exposure_id, d)""", "cal hratio")
def _(spark, sf):
    p = base.strategy_days(spark, sf).where("roll_flag = 0 AND d_fut > 0").select("exposure_id", "d", F.col("h_ols_roll_120").alias("h"))
    return report.with_default(base.calendar(spark, sf), p, ["exposure_id", "d"], "h", 1.0)


@query("D6_keep_last", "l_suppkey:i l_returnflag:s l_orderkey:i l_linenumber:i", """
    SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(spark, sf):
    li = market.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return keep_last(li, ["l_suppkey", "l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])


@query("D6_keep_first", "l_suppkey:i l_returnflag:s l_orderkey:i l_linenumber:i", """
    SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def _(spark, sf):
    li = market.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return keep_first(li, ["l_suppkey", "l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])


@query("D10_set_operations", "only_here:i shared:i", """
    SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_here,
           (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS shared""")
def _(spark, sf):
    c = market.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    o = market.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    hit = c.distinct().join(o.withColumn("hit", F.lit(1)), "k", "left")
    return hit.agg(F.count_if(F.col("hit").isNull()).alias("only_here"), F.count("hit").alias("shared"))
