"""Queries of sources and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basisflow.operators import audit, report
from basisflow.plans.lineage import checkpoint_folder
from basisflow.queries import base, risk
from basisflow.queries.reporting import _parsed
from basisflow.queries.registry import query
from basisflow.sources import market, readers, sinks


def _folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


_WIDE = ", ".join(f"max(CASE WHEN series_id = '{s}' THEN price END) AS \"{s}\"" for s in ("A", "R", "N"))


@query("S1_S2_S3_master", "d:d A:f4 R:f4 N:f4", f"""
    SELECT * FROM (SELECT d, {_WIDE} FROM panel GROUP BY 1) WHERE day(d) <> 13 AND (A IS NOT NULL OR R IS NOT NULL OR N IS NOT NULL)""", "panel")
def _(spark, sf):
    path = _folder(spark, "master.csv")
    p = base.panel(spark, sf).where(F.col("series_id").isin("A", "R", "N"))
    w = p.groupBy("d").pivot("series_id", ["A", "R", "N"]).agg(F.max("price"))
    text = F.when(F.dayofmonth("d") == 13, "not a date").when(F.dayofmonth("d") % 2 == 0, F.date_format("d", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.col("d").cast("string"))
    w.select(text.alias("trade_date"), "A", "R", F.coalesce(F.col("N").cast("string"), F.lit("n/a")).alias("N")).write.option("header", True).csv(path)
    return readers.read_master(spark, path)


@query("S1_csv_once", "series_id:s n:i", "SELECT series_id, count(*) AS n FROM panel GROUP BY 1", "panel")
def _(spark, sf):
    src, out = _folder(spark, "panel.csv"), _folder(spark, "panel")
    base.panel(spark, sf).write.option("header", True).csv(src)
    readers.csv_to_parquet(spark, src, out)
    return readers.csv_to_parquet(spark, src, out).groupBy("series_id").agg(F.count("*").alias("n"))


@query("S4_price_series", "d:d f_mark:f4", "SELECT d, f_mark FROM series", "series")
def _(spark, sf):
    path = _folder(spark, "marks")
    base.series(spark, sf).select(F.date_format("d", "yyyy-MM-dd").alias("Date"), F.col("f_mark").cast("string").alias("f_mark")).write.parquet(path)
    return readers.read_price_series(spark, path)


@query("S5_scenarios", "trade_no:i start_date:d end_date:d volume_bbl:i",
       "SELECT trade_no, start_date, end_date, volume_bbl FROM trades WHERE trade_no % 9 <> 0", "trades")
def _(spark, sf):
    path = _folder(spark, "scenarios.csv")
    t = base.trades(spark, sf)
    t.select("trade_no", F.col("start_date").alias("start"), F.when(F.col("trade_no") % 9 == 0, F.date_sub("start_date", 1)).otherwise(
        F.col("end_date")).alias("end"), F.col("volume_bbl").alias("Q")).write.option("header", True).csv(path)
    return readers.read_scenarios(spark, path)


@query("S6_scenario_root", "scenario_kind:s scenario_file:s n:i volume:i", """
    SELECT scenario_kind, CASE scenario_kind WHEN 'company' THEN 'company.parquet' ELSE 'baseline.parquet' END AS scenario_file, count(*) AS n,
           sum(CASE WHEN scenario_kind = 'company' THEN volume_bbl ELSE 1000000 END) AS volume FROM trades GROUP BY 1""", "trades")
def _(spark, sf):
    root = _folder(spark, "root")
    t = base.trades(spark, sf).select("scenario_id", "start_date", "end_date", "volume_bbl", "scenario_kind")
    t.where("scenario_kind = 'baseline'").drop("volume_bbl", "scenario_kind").write.parquet(f"{root}/ALL/baseline.parquet")
    company = t.where("scenario_kind = 'company'").drop("scenario_kind")
    company.unionByName(company).write.parquet(f"{root}/ALL/company.parquet")
    s = readers.read_scenario_root(spark, root, "ALL", ["baseline", "company", "oracle_all"])
    return s.groupBy("scenario_kind", "scenario_file").agg(F.count("*").alias("n"), F.sum("volume_bbl").alias("volume"))


@query("S7_S8_partitioned_results", "exposure_id:s scenario_kind:s n:i net:f4 from_bucket:i", """
    SELECT exposure_id, scenario_kind, count(*) AS n, sum(net_pnl_total) AS net, count(*) AS from_bucket FROM results GROUP BY 1, 2""", "results")
def _(spark, sf):
    path = _folder(spark, "final")
    r = base.results(spark, sf)
    sinks.write_results(r.where("strategy <> 'naive'"), path)
    sinks.append_results(r.where("strategy = 'naive'").drop("turnover_h").withColumn("extra", F.lit(1)), path)
    back = readers.read_results(spark, [path])
    return back.groupBy("exposure_id", "scenario_kind").agg(
        F.count("*").alias("n"), F.sum("net_pnl_total").alias("net"),
        F.count_if(F.col("source_file").contains("scenario_kind=")).alias("from_bucket"))


@query("S8_committed_parts", "part:s exposure_id:s n:i net:f4", """
    SELECT strategy AS part, exposure_id, count(*) AS n, sum(net_pnl_total) AS net FROM results WHERE NOT (strategy = 'naive' AND exposure_id < '3') GROUP BY 1, 2""", "results")
def _(spark, sf):
    """One part per strategy; one is written twice, the second time with fewer buckets, and one writer dies before its note."""
    path, r = _folder(spark, "parts"), base.results(spark, sf)
    sinks.write_part(r.where("strategy = 'naive'"), path, "naive")
    for s in ("nohedge", "ols_static", "ols_roll"):
        sinks.write_part(r.where(F.col("strategy") == s), path, s)
    sinks.write_part(r.where("strategy = 'naive' AND exposure_id >= '3'"), path, "naive")
    r.where("strategy = 'ols_roll'").limit(5).write.parquet(f"{path}/part=ols_roll/run=unfinished")
    return readers.read_parts(spark, path).groupBy("part", "exposure_id").agg(F.count("*").alias("n"), F.sum("net_pnl_total").alias("net"))


@query("S1_mixed_encodings", "series_id:s label:s n:i total:f4", """
    SELECT series_id, 'Köln ' || series_id AS label, count(*) AS n, sum(price) AS total FROM panel GROUP BY 1""", "panel")
def _(spark, sf):
    """A folder of CSV files, some UTF-8 and some latin-1, all read right."""
    path = _folder(spark, "mixed.csv")
    p = base.panel(spark, sf).select("series_id", F.concat(F.lit("Köln "), "series_id").alias("label"), "price")
    p.where("series_id < '3'").write.option("header", True).csv(path)
    p.where("series_id >= '3'").write.mode("append").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    t = readers.read_table(spark, path)
    return t.groupBy("series_id", "label").agg(F.count("*").alias("n"), F.sum(F.col("price").cast("double")).alias("total"))


@query("S9_window_union", "window_id:s split:s n:i turnover:f4", """
    SELECT strategy AS window_id, 'test' AS split, count(*) AS n, sum(CASE WHEN strategy = 'naive' THEN 0 ELSE turnover_contracts END) AS turnover
    FROM results GROUP BY 1""", "results")
def _(spark, sf):
    r, parts = base.results(spark, sf), {}
    for s in ("nohedge", "naive", "ols_static", "ols_roll"):  # one part lacks a column
        parts[s] = _folder(spark, s)
        r.where(F.col("strategy") == s).select("scenario_id", "strategy", *([] if s == "naive" else ["turnover_contracts"])).write.parquet(parts[s])
    u = readers.union_windows(spark, parts, {"split": "test", "turnover_contracts": 0.0})
    return u.groupBy("window_id", "split").agg(F.count("*").alias("n"), F.sum("turnover_contracts").alias("turnover"))


@query("S10_policy_results", "scenario_id:s scenario_kind:s strategy:s window:i mode:s roll:s net_pnl_total:f4 cost_trade_total:f4", """
    SELECT scenario_id, CASE scenario_kind WHEN 'baseline' THEN 'baseline' ELSE 'oracle_universe' END AS scenario_kind, 'Policy' AS strategy, 60 AS "window",
           'dynamic' AS mode, 'roll' AS roll, net_pnl_total, cost_trade_total FROM results WHERE strategy = 'ols_roll'""", "results")
def _(spark, sf):
    r = base.results(spark, sf).where("strategy IN ('naive', 'ols_roll')").select(
        "scenario_id", "exposure_id", F.when(F.col("scenario_kind") == "baseline", "test:base").otherwise("test:univ").alias("dataset"),
        F.lit("sac").alias("strategy"), F.lit("runs/policy__w60__x.parquet").alias("source_file"), F.col("net_pnl_total").alias("episode_pnl"),
        F.col("cost_trade_total").alias("cost_sum"), (F.col("strategy") == "ols_roll").cast("int").alias("row_no"))
    return readers.ingest_policy(r, ["source_file", "row_no"])


@query("S11_audit_csv", "series_id:s n_obs:s missing_flag:s", """
    SELECT series_id, CAST(count(price) AS VARCHAR) AS n_obs, CASE WHEN 1 - count(price) / count(*) >= 0.2 THEN 'HIGH' WHEN 1 - count(price) / count(*) >= 0.05 THEN 'WARN' ELSE 'OK' END
           AS missing_flag FROM raw GROUP BY 1""", "raw")
def _(spark, sf):
    path = _folder(spark, "coverage.csv")
    sinks.write_report_csv(audit.coverage(base.raw_panel(spark, sf), "price"), path, ["series_id"])
    return readers.read_table(spark, path)


@query("S12_safe_names", "original:s safe:s", r"""
    WITH n AS (SELECT *, trim(regexp_replace(regexp_replace(original, '[^0-9A-Za-z_]', '_', 'g'), '_+', '_', 'g'), '_') AS b
               FROM (SELECT DISTINCT series_id || ' (px)' AS original FROM panel UNION ALL SELECT DISTINCT series_id || '__px' FROM panel))
    SELECT original, b || CASE WHEN rn > 1 THEN '_' || rn ELSE '' END AS safe FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY original) AS rn FROM n)
    UNION ALL SELECT 'Date', 'Date'""", "panel")
def _(spark, sf):
    p = base.panel(spark, sf)
    ids = sorted(r[0] for r in p.select("series_id").distinct().collect())  # the few configured series
    w = p.groupBy(F.col("d").alias("Date")).pivot("series_id", ids).agg(F.max("price"))
    w = w.select("Date", *[F.col(f"`{i}`").alias(f"{i} (px)") for i in ids], *[F.col(f"`{i}`").alias(f"{i}__px") for i in ids])
    return sinks.with_safe_names(w)[1]


@query("S13_top_slices", "scenario_kind:s exposure_id:s strategy:s place:i he_net_vs_nohedge:f8", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_kind ORDER BY round(he_net_vs_nohedge, 9) DESC NULLS LAST, strategy, exposure_id) AS place FROM gmhe) WHERE place <= 15""", "gmhe")
def _(spark, sf):
    m = risk._metrics(spark, sf).withColumn("he", F.round("he_net_vs_nohedge", 9)).withColumn("s", F.col("strategy"))
    m = m.withColumn("strategy", F.concat_ws("|", "strategy", "exposure_id"))
    return sinks.top_slices(m, ["scenario_kind"], "he").withColumn("strategy", F.col("s"))


@query("S13_main_slices", "slice:s kind:s n:i", """
    SELECT slice, kind, count(*) AS n FROM (
      SELECT 'primary' AS slice, kind FROM parsed WHERE mode = 'dynamic' AND roll = 'roll' AND ("window" IS NULL OR "window" IN (120, 252))
      UNION ALL SELECT 'roll_vs_noroll', kind FROM parsed WHERE mode = 'dynamic' AND roll IS NOT NULL AND ("window" IS NULL OR "window" = 120)
      UNION ALL SELECT 'static_vs_dynamic', kind FROM parsed WHERE roll = 'roll' AND mode IS NOT NULL AND ("window" IS NULL OR "window" = 120)) GROUP BY 1, 2""", "parsed")
def _(spark, sf):
    return sinks.main_slices(_parsed(spark, sf)).groupBy("slice", "kind").agg(F.count("*").alias("n"))


@query("P21_feature_pack", "d:d teacher:f6 A:f4 R:f4", """
    SELECT c.d, h.h_roll AS teacher, a.value AS A, r.value AS R FROM (SELECT DISTINCT d FROM cal WHERE exposure_id = 'N') c
    JOIN (SELECT d, h_roll FROM hratio WHERE exposure_id = 'N') h USING (d) LEFT JOIN (SELECT d, value FROM filled WHERE series_id = 'A') a USING (d)
    LEFT JOIN (SELECT d, value FROM filled WHERE series_id = 'R') r USING (d)""", "cal hratio filled")
def _(spark, sf):
    f = base.filled(spark, sf).where(F.col("series_id").isin("A", "R", "5-LOW")).groupBy("d").pivot("series_id", ["A", "R", "5-LOW"]).agg(F.max("value"))
    h = base.strategy_days(spark, sf).where("exposure_id = 'N'").select("d", F.col("h_ols_roll_120").alias("y_h_dcc_120"))
    from basisflow.operators.features import feature_pack
    return feature_pack(f.join(h, "d"), None, ["A"], ["A", "R"], ["teacher_h", "y_h_dcc_120"])


@query("S13_best_worst", "exposure_id:s side:s place:i strategy:s scenario_kind:s mean_net:g", " UNION ALL ".join(f"""
    SELECT * FROM (SELECT exposure_id, '{side}' AS side, row_number() OVER (PARTITION BY exposure_id ORDER BY mean_net {order}, strategy || scenario_kind) AS place,
           strategy, scenario_kind, mean_net FROM gm) WHERE place <= 3""" for side, order in (("best", "DESC"), ("worst", "ASC"))), "gm")
def _(spark, sf):
    m = risk._metrics(spark, sf).withColumn("tie", F.concat("strategy", "scenario_kind"))
    return sinks.best_and_worst(m, ["exposure_id"], "mean_net", "tie", 3)


@query("S13_raw_sample", "exposure_id:s place:i scenario_id:s strategy:s net_pnl_total:f4", """
    SELECT * FROM (SELECT exposure_id, row_number() OVER (PARTITION BY exposure_id ORDER BY md5('raw|' || scenario_id || '|' || strategy), scenario_id, strategy) AS place,
           scenario_id, strategy, net_pnl_total FROM results) WHERE place <= 200""", "results")
def _(spark, sf):
    return sinks.raw_sample(base.results(spark, sf), ["exposure_id"], ["scenario_id", "strategy"], 200, "raw")


@query("S12_safe_parquet", "d:d A_px:f4 R_px:f4 N_px:f4", f"SELECT d, {_WIDE.replace(' AS "A"', ' AS A_px').replace(' AS "R"', ' AS R_px').replace(' AS "N"', ' AS N_px')} FROM panel GROUP BY 1", "panel")
def _(spark, sf):
    path = _folder(spark, "safe")
    w = base.panel(spark, sf).groupBy(F.col("d").alias("Date")).pivot("series_id", ["A", "R", "N"]).agg(F.max("price"))
    sinks.write_safe_parquet(w.select("Date", *[F.col(c).alias(f"{c} (px)") for c in "ARN"]), path)
    return spark.read.parquet(path).withColumnRenamed("Date", "d")


@query("S10_exposure_from_path", "exposure_id:s n:i", """
    SELECT CASE o_orderkey % 4 WHEN 0 THEN 'OPEC_BASKET' WHEN 1 THEN 'BRENT_SPOT' WHEN 2 THEN 'WTI_SPOT' ELSE 'unknown' END AS exposure_id, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    o = market.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("scenario_id"), F.col("o_totalprice").alias("episode_pnl"), F.lit(1).alias("row_no"),
        F.concat(F.lit("out/"), F.when(k == 0, "opec_wti").when(k == 1, "Brent").when(k == 2, "wti").otherwise("other"), F.lit("/test.parquet")).alias("source_file"))
    return readers.ingest_policy(o, ["row_no"]).groupBy("exposure_id").agg(F.count("*").alias("n"))


@query("P16_roll_flags", "flag:s roll:s n:i", """
    SELECT flag, CASE WHEN flag IN ('TRUE', ' yes', '1', 'Roll', '1.0') THEN 'roll' WHEN flag IN ('no_roll', 'No-Roll', '0', 'f') THEN 'noroll'
           WHEN odd = 1 THEN 'noroll' END AS roll, count(*) AS n FROM (
      SELECT ['TRUE', ' yes', '1', 'Roll', '1.0', 'no_roll', 'No-Roll', '0', 'f', 'maybe', '', NULL][o_orderkey % 12 + 1] AS flag, o_custkey % 2 AS odd FROM orders) GROUP BY 1, 2""")
def _(spark, sf):
    words = F.array(*[F.lit(w) for w in ("TRUE", " yes", "1", "Roll", "1.0", "no_roll", "No-Roll", "0", "f", "maybe", "", None)])
    o = market.table(spark, sf, "orders").select(F.get(words, (F.col("o_orderkey") % 12).cast("int")).alias("flag"),
                                                 F.when(F.col("o_custkey") % 2 == 1, "x__noroll__y").otherwise("x").alias("path"))
    return o.withColumn("roll", report.roll_of(F.col("path"), F.col("flag"))).groupBy("flag", "roll").agg(F.count("*").alias("n"))
