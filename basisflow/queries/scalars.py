"""Queries of scalar functions and of the strategy registry and its settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from basisflow.functions import core
from basisflow.operators import hedge, pnl
from basisflow.queries import base
from basisflow.queries.registry import query
from basisflow.sources import market


@query("F_date_functions", "trade_no:i ordinal:i ymd:i epoch:i weekday:i month:s anchor:d back1:d back2:d back3:d", """
    SELECT trade_no, date_diff('day', DATE '1970-01-01', start_date) + 719163 AS ordinal, CAST(strftime(start_date, '%Y%m%d') AS BIGINT) AS ymd,
           date_diff('day', DATE '1970-01-01', start_date) AS epoch, isodow(start_date) - 1 AS weekday, strftime(start_date, '%Y-%m') AS month,
           CAST(date_trunc('month', start_date) + INTERVAL 24 DAY AS DATE) AS anchor, start_date AS back1, start_date AS back2, start_date AS back3
    FROM requests""", "requests")
def _(spark, sf):
    t, d = market.trade_requests(spark, sf), F.col("start_date")
    t = t.select("trade_no", "start_date", core.to_ordinal(d).alias("ordinal"), core.to_yyyymmdd(d).alias("ymd"), F.unix_date(d).alias("epoch"),
                 F.weekday(d).alias("weekday"), core.month_key(d).alias("month"), F.make_date(F.year(d), F.month(d), F.lit(25)).alias("anchor"))
    return t.withColumns({f"back{i}": core.any_day_number(F.col(c)) for i, c in enumerate(("ordinal", "ymd", "epoch"), 1)})


@query("F_text_functions", "n:i clean:s safe:s short_id:s draw:i", r"""
    SELECT o_orderkey AS n, CASE WHEN lower(trim(x)) IN ('', 'nan', 'none', '<na>', 'unknown') THEN NULL ELSE trim(x) END AS clean,
           regexp_replace(trim(x), '[^A-Za-z0-9._-]+', '_', 'g') AS safe, substr(sha1(o_orderpriority || '|' || o_custkey), 1, 12) AS short_id,
           5 + ('0x' || substr(md5('s|' || o_orderkey), 1, 15))::BIGINT % 17 AS draw
    FROM (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'None' WHEN 2 THEN '<NA>' WHEN 3 THEN '' WHEN 4 THEN 'Unknown' ELSE ' ' || o_orderpriority || '/x ' END AS x FROM orders)""")
def _(spark, sf):
    k = F.col("o_orderkey") % 7
    x = (F.when(k == 0, " NaN ").when(k == 1, "None").when(k == 2, "<NA>").when(k == 3, "").when(k == 4, "Unknown")
         .otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("/x "))))
    o = market.table(spark, sf, "orders").withColumn("x", x)
    return o.select(F.col("o_orderkey").alias("n"), core.null_text(F.col("x")).alias("clean"), core.file_safe(F.col("x")).alias("safe"),
                    core.short_sha1(12, F.col("o_orderpriority"), F.col("o_custkey")).alias("short_id"),
                    core.uniform_int(5, 21, F.lit("s"), F.col("o_orderkey")).alias("draw"))


@query("F_json_and_arrays", "user_id:i event_type:s total:i json:s last3:f4 n:i", """
    SELECT user_id, event_type, total, '{"' || event_type || '":' || total || '}' AS json, last3, n FROM (
      SELECT user_id, event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total, count(*) AS n,
             CAST(sum(CAST(value AS FLOAT)::DOUBLE) FILTER (rn <= 3) AS DOUBLE) AS last3
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY 1, 2)""")
def _(spark, sf):
    e = market.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    from pyspark.sql import Window
    rn = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    # the last three rows come by a ranked filter, which Spark limits before the shuffle
    last = (e.withColumn("rn", rn).where("rn <= 3").groupBy("user_id", "event_type")
            .agg(F.aggregate(F.transform(F.collect_list("value"), lambda v: v.cast("float").cast("double")), F.lit(0.0), lambda a, v: a + v).alias("last3")))
    g = e.groupBy("user_id", "event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
    g = g.withColumn("json", F.to_json(F.create_map("event_type", "total")))
    return g.join(last, ["user_id", "event_type"])


@query("U1_strategy_registry", "scenario_id:s strategy:s net_pnl_total:f4 fut_pnl_total:f4 cost_roll_total:f4", """
    SELECT scenario_id, strategy, sum(spot_pnl + f - c) AS net_pnl_total, sum(f) AS fut_pnl_total, 0 AS cost_roll_total FROM (
      SELECT t.scenario_id, t.strategy, t.spot_pnl, t.cost_trade AS c, t.n_prev * CASE WHEN t.pos = t.pos0 THEN 0 ELSE coalesce(d.pnl_1c, 0) END AS f
      FROM tdays t JOIN vdays d USING (exposure_id, pos)) GROUP BY 1, 2""", "tdays vdays")
def _(spark, sf):
    cfg = pnl.PnlConfig(fut_pnl="pnl_1c", roll_costs=False)
    chosen = [hedge.make_strategy("nohedge"), hedge.make_strategy("Naive"), hedge.make_strategy("ols_static"), hedge.make_strategy("rolling_ols", window=120)]
    rows = pnl.trade_days(base.trades(spark, sf), base.calendar(spark, sf), base.days(spark, sf), chosen, cfg)
    return pnl.summaries(rows, chosen, base.TRADE_KEYS, cfg)


@query("W20_static_slope_with_window", "scenario_id:s h:f6", """
    SELECT scenario_id, CASE WHEN n >= 60 AND xx - x * x / n <> 0 THEN greatest(-2, least(2, (xy - x * y / n) / (xx - x * x / n))) ELSE 0 END AS h FROM (
      SELECT b.scenario_id, count(*) AS n, sum(v.r_f) AS x, sum(v.r_s) AS y, sum(v.r_f * v.r_f) AS xx, sum(v.r_f * v.r_s) AS xy
      FROM bounds b JOIN vdays v ON v.exposure_id = b.exposure_id AND v.pos BETWEEN b.pos0 - 2519 AND b.pos1 AND v.r_s IS NOT NULL AND v.r_f IS NOT NULL GROUP BY 1)""",
       "bounds vdays")
def _(spark, sf):
    s = [hedge.ols_static(sees_window=True)]
    placed = pnl._placed(base.trades(spark, sf), base.calendar(spark, sf), s[0].prepare(base.days(spark, sf)), s, pnl.PnlConfig())
    return placed.select("scenario_id", F.col("ols_static__h0").alias("h"))
