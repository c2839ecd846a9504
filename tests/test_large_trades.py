"""Trade tables of many rows: sums taken once and in order, tasks that stay small."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import pytest

from basisflow.functions import digest
from basisflow.functions.core import hex_number, hex_text
from basisflow.operators import episodes, metrics, scenarios, windows
from basisflow.queries import base, grains
from basisflow.queries.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_the_unhedged_strategy_never_differs_from_itself(spark):
    """A variance that comes out otherwise each time it is computed, as sums in another order do."""
    noisy = F.udf(lambda: 1.0 + random.random() * 1e-9, "double").asNondeterministic()
    m = spark.createDataFrame([("e", s) for s in ("nohedge", "naive")], "exposure_id string, strategy string")
    m = m.withColumns({f"var_{p}": noisy() for p in ("net", "gross", "spot")})
    got = {r.strategy: r for r in metrics.add_effectiveness(m, ["exposure_id"], ["exposure_id"]).collect()}
    assert got["nohedge"].he_net_vs_nohedge == got["nohedge"].he_gross_vs_nohedge == got["nohedge"].he_spot_vs_nohedge == 0.0


def test_net_total_is_the_sum_of_the_days_in_order(spark):
    """To the last digit: distinct values are counted."""
    daily = {}
    for r in base.daily(spark, SF).select("scenario_id", "strategy", "pos", "net_pnl").orderBy("scenario_id", "strategy", "pos").collect():
        daily[r.scenario_id, r.strategy] = daily.get((r.scenario_id, r.strategy), 0.0) + r.net_pnl
    got = {(r.scenario_id, r.strategy): r.net_pnl_total for r in base.results_plan(spark, SF).select("scenario_id", "strategy", "net_pnl_total").collect()}
    assert got == daily and len(got) > 1000


def test_tasks_stay_small_however_many_trades(spark):
    """Ten times the trade days, ten times the tasks; few of them still fill the tasks there are."""
    t = spark.range(1000).select(F.col("id").cast("string").alias("scenario_id"), F.lit(1).alias("pos0"), F.lit(30).alias("pos1"))
    assert windows.by_scenario(t, 1000).rdd.getNumPartitions() == 30
    assert windows.by_scenario(t.union(t), 1000).rdd.getNumPartitions() == 60
    assert windows.by_scenario(t).rdd.getNumPartitions() == 8
    assert windows.by_scenario(t.where("false")).rdd.getNumPartitions() == 8


def test_days_are_sorted_before_strategies_widen_them(spark):
    """One sort in the plan of the result table, on rows without strategy columns; the windows need no other."""
    plan = base.results_plan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = [i for i, line in enumerate(lines) if "Sort [" in line]
    assert len(at) == 1 and "BroadcastHashJoin" in "".join(lines[at[0] + 1:at[0] + 3])


def sorts(df):
    """Sort operators of a plan, from the top."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line]


def test_path_signals_sort_no_stacked_rows(spark):
    """Trade days are sorted once, not once more for each strategy: the only sort is that of the narrow days."""
    found = sorts(QUERIES["W40_path_signals"](spark, SF))
    assert len(found) == 1 and "strategy" not in found[0]


@pytest.mark.parametrize("n", [2, 3, 5])
def test_signals_side_by_side_are_those_of_stacked_rows(spark, n):
    rng = random.Random(n)
    rows = [(f"t{t}", pos, *[None if rng.random() < 0.1 else round(rng.uniform(-1, 1.5), 3) for _ in "ab"]) for t in range(40) for pos in range(1 + t % 12)]
    wide = spark.createDataFrame(rows, "scenario_id string, pos long, a__net double, b__net double")
    made = ("all_negative", "recent_sum", "convex_rise")
    got = {(r.scenario_id, s, r.pos): tuple(r[f"{s}__{k}"] for k in made)
           for r in episodes.signals_of(wide, {"a": "a__net", "b": "b__net"}, n, ["scenario_id"]).collect() for s in "ab"}
    long = wide.select("scenario_id", "pos", F.expr("stack(2, 'a', a__net, 'b', b__net) AS (strategy, p)"))
    same = lambda x: (x[0] or 0, None if x[1] is None else round(x[1], 9), x[2])
    want = {(r.scenario_id, r.strategy, r.pos): tuple(r[k] for k in made) for r in episodes.path_signals(long, "p", n, None).collect()}
    assert {k: same(v) for k, v in got.items()} == {k: same(v) for k, v in want.items()} and len(got) > 300


def test_largest_zscore_so_far_by_start(spark):
    """Against a loop; two trades that start together and a window shorter than the longer one."""
    x = [3.0, 5.0, 4.0, 9.0, 1.0, 7.0, 7.5, 2.0]
    days = spark.createDataFrame([("e", i + 1, v) for i, v in enumerate(x)], "exposure_id string, pos long, spot double")
    trades = spark.createDataFrame([("e", 1, 7), ("e", 1, 3), ("e", 4, 4)], "exposure_id string, pos0 long, pos1 long")
    got = {r.pos0: r.z_peaks for r in episodes.zscore_peaks(trades, days, "spot", 4).collect()}

    def z(values):
        mean = sum(values) / len(values)
        return (values[-1] - mean) / max((sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5, 1e-12)
    for first, last in ((1, 7), (4, 4)):
        each = [z(x[max(first - 1, i - 3):i + 1]) for i in range(first - 1, last)]
        assert got[first] == pytest.approx([max(each[:i + 1]) for i in range(len(each))])


def test_episodes_sum_before_they_are_stacked(spark):
    """Trades and not days are stacked: the rows that meet the strategies are already one for each trade. Same rows as from the stacked step log."""
    keys = ["scenario_id", "scenario_kind", "exposure_id"]
    wide = episodes.episode_summaries(base.steps(spark, SF), keys, base.STRATEGIES)
    for df in (wide, QUERIES["A21_overall_means"](spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.index("explode(array(") < plan.rindex("HashAggregate") and len(sorts(df)) == 1
    long = episodes.episode_summary(base.step_log(spark, SF), [*keys, "strategy"])
    rows = lambda df: sorted(tuple(v if v is None or isinstance(v, str) else round(float(v), 6) for v in r) for r in df.select(*long.columns).collect())
    assert rows(wide) == rows(long)


def test_company_trades_are_summed_without_a_sort(spark):
    """One row per trade is neither sorted nor exchanged, and the two digests of a company's month are not computed once more for each day."""
    df = QUERIES["G2_company_trades"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not sorts(df) and "SortAggregate" not in plan
    assert "transform(array(concat(sha2(" in plan


def test_company_trades_take_more_tasks_for_more_companies(spark, monkeypatch):
    monkeypatch.setattr(scenarios, "MONTHS_A_TASK", 10)
    day = spark.sql("SELECT 'e' AS exposure_id, explode(sequence(DATE'2020-01-01', DATE'2020-12-31')) AS d")
    firms = spark.range(100).select(F.concat(F.lit("C"), "id").alias("company_id"), F.lit("SMALL").alias("company_size"), F.lit("e").alias("exposure_id"))
    t = scenarios.company_trades(firms, day, windows.day_map(day), "s")
    assert "hashpartitioning(company_id" in t._jdf.queryExecution().executedPlan().toString() and t.rdd.getNumPartitions() == 120
    assert t.groupBy("company_id", "month").agg(F.count("*").alias("n"), F.count_distinct("start_date").alias("k")).where("n <> k OR n > 3").isEmpty()


def test_company_totals_are_sums_of_company_trades(spark):
    """No row per trade leaves a task's batch. Ids of several lengths, a company listed twice, one of no known size, one without an id, an exposure without days."""
    days = spark.sql("SELECT explode(array('e', '4-NOT SPECIFIED')) AS exposure_id, explode(sequence(DATE'2020-01-01', DATE'2020-12-31')) AS d").where("exposure_id = 'e' OR day(d) % 3 > 0")
    sizes = [*scenarios.TRADES_PER_MONTH, "OTHER"]
    firms = [("C" + str(7 ** k), sizes[k % 4], ("e", "4-NOT SPECIFIED")[k % 2]) for k in range(9)] + [("C1", "SMALL", "e")] * 2 + [("C5", "LARGE", "none"), (None, "MEDIUM", "e"), ("", "SMALL", "e")]
    firms = spark.createDataFrame(firms, "company_id string, company_size string, exposure_id string")
    ends = windows.day_map(days)
    keys = ["company_id", "company_size", "exposure_id"]
    want = scenarios.company_trades(firms, days, ends, "s").groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.count_distinct("month").alias("n_months"), F.sum("volume_bbl").alias("volume"),
        F.sum("horizon_days_target").alias("horizon"), F.min("scenario_id").alias("first_id"), F.max("scenario_id").alias("last_id"))
    got = scenarios.company_totals(firms, days, ends, "s")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "md5(" not in plan and "sha1(" not in plan
    rows = lambda df: sorted(map(tuple, df.select(want.columns).collect()), key=repr)
    assert rows(got) == rows(want) and len(rows(got)) == 11


def test_digests_of_many_texts():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 256, (7, size)).astype(np.uint8) for size in (30, 0, 55, 64, 119, 56, 120, 30)]
    raw = [row.tobytes() for t in texts for row in t]
    for words, name in ((digest.md5_words(*texts), "md5"), (digest.sha1_words(*texts), "sha1")):
        assert ["".join(f"{x:08x}" for x in column) for column in words.T] == [hashlib.new(name, x).hexdigest() for x in raw]


def test_hex_numbers_keep_order_and_digits(spark):
    rng = random.Random(3)
    texts = ["0" * 20, "f" * 20, "8" + "0" * 19, "0" * 19 + "1", "00000000000000f00000", *["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(200)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", hex_number(F.col("t"), 20))
    rows = df.withColumn("back", hex_text(F.col("n"), 20)).collect()
    assert all(r.t == r.back for r in rows) and [r.t for r in sorted(rows, key=lambda r: r.n)] == sorted(texts)
    short = spark.createDataFrame([("00ff",)], "t string").select(hex_text(hex_number(F.col("t"), 4), 4).alias("b")).first().b
    assert short == "00ff"


def test_last_runs_are_found_where_trades_were_summed(spark):
    """Result rows are not exchanged: the only exchange is that of the narrow trades, and no column is kept that the metrics do not read."""
    last = grains._last_plan(spark, SF)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Union" not in plan
    assert not {"company_id", "company_size", "start_date", "end_date", "n_days"} & set(last.columns)
    assert last.groupBy(*grains.ONCE).count().where("count > 1").isEmpty()
    n = F.substring("scenario_id", 2, 20).cast("long")
    assert last.where((n % 10 == 0) != (F.col("row_no") == 2)).isEmpty() and not last.where("row_no = 2").isEmpty()
