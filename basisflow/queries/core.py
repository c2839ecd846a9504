"""Queries of the cleaning, roll, window and P&L operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from basisflow.operators import clean, pnl, roll, windows
from basisflow.queries import base
from basisflow.queries.registry import query


@query("W1_forward_fill", "series_id:s d:d raw:f4 updated:i value:f4", "SELECT * FROM filled", "filled")
def _(spark, sf):
    return base.filled(spark, sf)


@query("W11_roll_mark", "instrument:s d:d f_mark:f4 pnl_1c:f4 roll_flag:i held_leg:s", "SELECT * FROM series", "series")
def _(spark, sf):
    return base.series(spark, sf)


@query("W10_roll_calendar", "instrument:s month:s anchor_25:d ltd:d roll_date:d", "SELECT * FROM rolls", "rolls")
def _(spark, sf):
    return base.roll_table(spark, sf)


@query("A8_trade_summary",
       "scenario_id:s exposure_id:s strategy:s n_days:i spot_pnl_total:f4 fut_pnl_total:f4 cost_trade_total:f4 "
       "cost_roll_total:f4 net_pnl_total:f4 turnover_contracts:f4 turnover_h:f6 roll_contracts:f4 "
       "max_abs_contracts:i mdd_equity:f4", "SELECT * FROM results", "results")
def _(spark, sf):
    return base.results_plan(spark, sf)
