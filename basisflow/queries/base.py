"""Tables that many queries start from, built once per session and scale folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basisflow.operators import clean, hedge, pnl, roll, windows
from basisflow.plans.lineage import listing, written
from basisflow.sources import market

_KEPT: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a table once per session and state of the input's files; tables of an earlier session are not reused."""
    key = (spark.sparkContext.applicationId, sf_dir, hash(tuple(listing(spark, sf_dir))), name)
    if key not in _KEPT:
        _KEPT[key] = written(build(), name)
    return _KEPT[key]


def panel(spark, sf_dir):
    """(series_id, d, price), bounded by series x days, so it is written once and read back with its true size."""
    return _once(spark, sf_dir, "panel", lambda: market.prices(spark, sf_dir))


def raw_panel(spark, sf_dir):
    return market.dirty_prices(panel(spark, sf_dir))


def filled(spark, sf_dir):
    return _once(spark, sf_dir, "filled", lambda: clean.filled_panel(raw_panel(spark, sf_dir)))


def universe(spark, sf_dir):
    return clean.universe(filled(spark, sf_dir), list(market.EXPOSURES), market.FRONT, market.NEXT)


def futures(spark, sf_dir):
    return roll.futures_table(filled(spark, sf_dir), market.FRONT, market.NEXT)


def roll_table(spark, sf_dir):
    return _once(spark, sf_dir, "rolls", lambda: roll.roll_calendar(futures(spark, sf_dir)))


def series(spark, sf_dir):
    return roll.series_roll(futures(spark, sf_dir), roll_table(spark, sf_dir))


def calendar(spark, sf_dir):
    return _once(spark, sf_dir, "calendar",
                 lambda: windows.market_calendar(universe(spark, sf_dir), series(spark, sf_dir)))


def days(spark, sf_dir):
    return windows.valid_days(calendar(spark, sf_dir))


def day_map(spark, sf_dir):
    return _once(spark, sf_dir, "daymap", lambda: windows.day_map(calendar(spark, sf_dir)))


def realised(spark, sf_dir):
    return windows.realise_end(market.trade_requests(spark, sf_dir), day_map(spark, sf_dir))


def trades(spark, sf_dir):
    t = realised(spark, sf_dir).where(F.col("data_coverage_flag") != "REJECTED")
    return t.withColumns({
        "scenario_id": F.concat(F.lit("T"), F.col("trade_no").cast("string")),
        "scenario_kind": F.when(F.col("trade_no") % 2 == 0, "company").otherwise("baseline")})


STRATEGIES = [hedge.nohedge(), hedge.naive(), hedge.ols_static(), hedge.ols_roll()]
TRADE_KEYS = ["scenario_id", "exposure_id", "scenario_kind", "start_date", "end_date", "horizon_days_target",
              "horizon_days_realized", "company_id", "company_size", "volume_bbl"]


def strategy_days(spark, sf_dir):
    """Day table with the ratios of every calendar strategy."""
    def build():
        d = days(spark, sf_dir)
        for s in STRATEGIES:
            d = s.prepare(d)
        return d
    return _once(spark, sf_dir, "strategy_days", build)


def _prepared():
    """The strategies with their day columns already in ``strategy_days``."""
    from dataclasses import replace
    return [replace(s, prepare=lambda d: d) for s in STRATEGIES]


def trade_days(spark, sf_dir, cfg=pnl.PnlConfig()):
    return pnl.trade_days(trades(spark, sf_dir), calendar(spark, sf_dir), strategy_days(spark, sf_dir),
                          _prepared(), cfg)


def daily(spark, sf_dir, cfg=pnl.PnlConfig()):
    return pnl.daily_paths(trade_days(spark, sf_dir, cfg), STRATEGIES)


def steps(spark, sf_dir):
    """Trade days, strategies side by side, with the contract-correct P&L of a contract, nothing on the first day."""
    first = F.col("pos") == F.col("pos0")
    return trade_days(spark, sf_dir).withColumn("pnl_1c", F.when(first, 0.0).otherwise(F.coalesce("pnl_1c", F.lit(0.0))))


def step_log(spark, sf_dir):
    """Daily rows of every trade and strategy with the notional of the day before, 1 at least: the step log of the episode analytics.

    What is the same for all strategies is computed before they are stacked, on rows that lie in the order of their trade.
    """
    w = Window.partitionBy("scenario_id").orderBy("pos")
    rows = steps(spark, sf_dir).withColumn(
        "notional", F.greatest(F.abs((F.col("spot") - F.coalesce("d_spot", F.lit(0.0))) * F.col("volume_bbl")), F.lit(1.0)))
    rows = rows.withColumn("notional0", F.first("notional").over(w))
    return pnl.daily_paths(rows, STRATEGIES, ["pnl_1c", "scenario_kind", "notional", "notional0"])


def results_plan(spark, sf_dir, cfg=pnl.PnlConfig()):
    out = pnl.summaries(trade_days(spark, sf_dir, cfg), STRATEGIES, TRADE_KEYS, cfg)
    return out.withColumn("volume_bbl", F.col("volume_bbl").cast("double"))


def results(spark, sf_dir):
    """Trade summaries, the fact table of the reports, written once like any result table."""
    return _once(spark, sf_dir, "results", lambda: results_plan(spark, sf_dir))
