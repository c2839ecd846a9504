"""Contracts, costs, daily P&L and trade summaries for many strategies in one pass."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.functions.core import clip, half_away, half_even
from basisflow.operators import paths
from basisflow.operators.hedge import Strategy
from basisflow.operators.windows import bounds, by_scenario, unfold


@dataclass(frozen=True)
class PnlConfig:
    side: int = 1                     # +1 owns the cargo, -1 is short of it
    dynamic: bool = True              # False freezes the first day's ratio
    roll_costs: bool = True
    cost_per_contract: float = 10.0
    contract_bbl: float = 1000.0
    h_limit: float | None = 3.0
    max_contracts: int | None = None
    rounding: str = "half_even"       # or half_away
    fut_pnl: str = "mark_diff"        # or pnl_1c, the contract-correct daily P&L


def contracts(h: Column, volume: Column, cfg: PnlConfig = PnlConfig()) -> Column:
    """Signed whole contracts held against the cargo."""
    if cfg.h_limit is not None:
        h = clip(h, -cfg.h_limit, cfg.h_limit)
    rnd = half_even if cfg.rounding == "half_even" else half_away
    n = (rnd(h * volume / cfg.contract_bbl).cast("long") * F.lit(-cfg.side)).cast("long")
    if cfg.max_contracts is not None:
        cap = F.lit(cfg.max_contracts).cast("long")
        n = F.greatest(-cap, F.least(cap, n))
    return n


def trade_cost(n_prev: Column, n: Column, per: float = 10.0) -> Column:
    return F.abs(n - n_prev) * F.lit(float(per))


def roll_cost(n_prev: Column, roll: Column, per: float = 10.0) -> Column:
    """Closing and reopening what was carried into the roll day."""
    return F.when(roll != 0, F.abs(n_prev) * F.lit(2.0 * per)).otherwise(0.0)


def _plan_columns(strategies: list[Strategy], cfg: PnlConfig) -> tuple[list[str], list[str], list[str]]:
    """Day columns read per trade day, and those read once at the first and the last day."""
    unique = lambda cols: list(dict.fromkeys(cols))
    move = "d_fut" if cfg.fut_pnl == "mark_diff" else "pnl_1c"
    cols = unique(["d_spot", move, "roll_flag", *(c for s in strategies if cfg.dynamic for c in s.day_cols)])
    start = unique(c for s in strategies for c in s.start_cols if s.on_trade or not cfg.dynamic)
    end = unique(c for s in strategies for c in s.end_cols)
    return cols, start, end


def _placed(trades: DataFrame, cal: DataFrame, days: DataFrame, strategies: list[Strategy],
            cfg: PnlConfig) -> DataFrame:
    """Trades with window positions and the ratios fixed per trade."""
    _, start, end = _plan_columns(strategies, cfg)
    b = bounds(trades, cal)
    if start:
        b = b.join(days.select("exposure_id", F.col("pos").alias("pos0"),
                               *[F.col(c).alias(f"start_{c}") for c in start]), ["exposure_id", "pos0"])
    if end:
        b = b.join(days.select("exposure_id", F.col("pos").alias("pos1"),
                               *[F.col(c).alias(f"end_{c}") for c in end]), ["exposure_id", "pos1"])
    return b.select(*dict.fromkeys(["exposure_id", *trades.columns]), "pos0", "pos1",
                    *[s.on_trade().alias(f"{s.name}__h0") for s in strategies if s.on_trade],
                    *[F.col(f"start_{c}") for c in start if not cfg.dynamic])


def _hold(h: Column, cfg: PnlConfig) -> Column:
    return clip(h, -cfg.h_limit, cfg.h_limit) if cfg.h_limit is not None else h


def trade_days(trades: DataFrame, cal: DataFrame, days: DataFrame, strategies: list[Strategy],
               cfg: PnlConfig = PnlConfig()) -> DataFrame:
    """Trade-day rows with position columns ``<strategy>__*`` side by side.

    The narrow trade rows are hashed by scenario before they unfold. When the calendar is small
    enough for Catalyst to broadcast, that placement survives the join, so the running sums per
    trade need no further exchange; the wide unfolded rows are never shuffled.
    """
    for s in strategies:
        days = s.prepare(days)
    cols, _, _ = _plan_columns(strategies, cfg)
    b = _placed(trades, cal, days, strategies, cfg)
    b = by_scenario(b)
    seen = [s for s in strategies if getattr(s, "paths", None)]
    if seen:
        b = paths.with_paths(b, days, seen)
    spread = tuple(f"{s.name}__path" for s in seen if cfg.dynamic)
    rows = unfold(b, days, list(dict.fromkeys(["spot", "fut", "pnl_1c", *cols])), spread)

    first = F.col("pos") == F.col("pos0")
    move = cols[1]
    d_fut = F.col(move) if move == "d_fut" else F.coalesce(F.col(move), F.lit(0.0)) / cfg.contract_bbl
    q = F.col("volume_bbl").cast("double")
    ratios = {}
    for s in strategies:
        now, before = (s.ratio(F.col), s.before(F.col)) if cfg.dynamic else (s.at_start(), s.at_start())
        ratios[f"{s.name}__h"] = _hold(now, cfg)
        ratios[f"{s.name}__hp"] = F.when(first, 0.0).otherwise(_hold(before, cfg))
    rows = rows.withColumns({
        "d_spot": F.when(first, 0.0).otherwise(F.col("d_spot")),
        "d_fut": F.when(first, 0.0).otherwise(d_fut),
        "roll": F.col("roll_flag") if cfg.roll_costs else F.lit(0), **ratios})
    free = replace(cfg, h_limit=None)
    rows = rows.withColumns({
        "spot_pnl": F.col("d_spot") * q,
        **{f"{s.name}__{b_}": contracts(F.col(f"{s.name}__{a}"), q, free)
           for s in strategies for a, b_ in (("h", "n"), ("hp", "np"))}})
    money = {}
    for s in strategies:
        n, np_ = F.col(f"{s.name}__n"), F.col(f"{s.name}__np")
        money[f"{s.name}__fut"] = np_ * F.col("d_fut") * cfg.contract_bbl
        money[f"{s.name}__ct"] = trade_cost(np_, n, cfg.cost_per_contract)
        money[f"{s.name}__cr"] = roll_cost(np_, F.col("roll"), cfg.cost_per_contract)
    rows = rows.withColumns(money)
    return rows.withColumns({f"{s.name}__net": F.col("spot_pnl") + F.col(f"{s.name}__fut")
                             - F.col(f"{s.name}__ct") - F.col(f"{s.name}__cr") for s in strategies})


def equity(rows: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """Running net P&L and its peak per trade, side by side."""
    w = Window.partitionBy("scenario_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{s.name}__eq": F.sum(f"{s.name}__net").over(w) for s in strategies})
    return rows.withColumns({f"{s.name}__pk": F.max(f"{s.name}__eq").over(w) for s in strategies})


def stack(df: DataFrame, keep: list[str], strategies: list[Strategy], fields: dict[str, str]) -> DataFrame:
    """Side-by-side strategy columns to one row per strategy."""
    each = [F.struct(F.lit(s.name).alias("strategy"),
                     *[F.col(f"{s.name}__{src}").alias(out) for src, out in fields.items()]) for s in strategies]
    return df.select(*keep, F.explode(F.array(*each)).alias("_s")).select(*keep, "_s.*")


#: daily columns of a strategy, side by side (``<strategy>__<key>``) and stacked
DAILY = {"h": "h_t", "hp": "h_prev", "n": "n_t", "np": "n_prev", "fut": "fut_pnl", "ct": "cost_trade", "cr": "cost_roll", "net": "net_pnl", "eq": "equity", "pk": "peak"}


def side(strategy: Strategy):
    """Column of a strategy in side-by-side rows by the name it has once stacked; columns that all strategies share keep theirs."""
    own = {out: f"{strategy.name}__{src}" for src, out in DAILY.items()}
    return lambda name: F.col(own.get(name, name))


def daily_paths(rows: DataFrame, strategies: list[Strategy], keep: list[str] = ()) -> DataFrame:
    """Daily path per trade and strategy."""
    rows = equity(rows, strategies)
    base = ["scenario_id", "exposure_id", "pos", "pos0", "d", "spot", "fut", "d_spot", "d_fut", "volume_bbl",
            "roll_flag", "spot_pnl", *keep]
    out = stack(rows, base, strategies, DAILY)
    return out.withColumns({
        "turnover_contracts": F.abs(F.col("n_t") - F.col("n_prev")).cast("double"),
        "turnover_h": F.abs(F.col("h_t") - F.col("h_prev"))})


def summaries(rows: DataFrame, strategies: list[Strategy], keys: list[str], cfg: PnlConfig = PnlConfig()) -> DataFrame:
    """One summary row per trade and strategy from ``trade_days`` rows.

    ``keys`` are trade columns, constant per scenario; grouping by them too keeps the placement.
    """
    rows = equity(rows, strategies)
    aggs: list[Column] = [F.count("*").alias("n_days"), F.sum("spot_pnl").alias("spot_pnl_total")]
    for s in strategies:
        c = lambda x: F.col(f"{s.name}__{x}")
        n, np_ = c("n"), c("np")
        aggs += [
            F.sum(c("fut")).alias(f"{s.name}__a"), F.sum(c("ct")).alias(f"{s.name}__b"),
            F.sum(c("cr")).alias(f"{s.name}__c"), F.sum(c("net")).alias(f"{s.name}__d"),
            F.sum(F.abs(n - np_)).cast("double").alias(f"{s.name}__e"),
            F.sum(F.abs(c("h") - c("hp"))).alias(f"{s.name}__f"),
            F.sum(F.when(F.col("roll") != 0, 2.0 * F.abs(n)).otherwise(0.0)).alias(f"{s.name}__g"),
            F.max(F.abs(n)).alias(f"{s.name}__i"),
            F.min(c("eq") - c("pk")).alias(f"{s.name}__j")]
    flat = rows.groupBy("scenario_id", *[k for k in keys if k != "scenario_id"]).agg(*aggs)
    out = stack(flat, [*keys, "n_days", "spot_pnl_total"], strategies, {
        "a": "fut_pnl_total", "b": "cost_trade_total", "c": "cost_roll_total", "d": "net_pnl_total",
        "e": "turnover_contracts", "f": "turnover_h", "g": "roll_contracts", "i": "max_abs_contracts",
        "j": "mdd_equity"})
    return out.withColumns({
        "trade_contracts": F.col("turnover_contracts"),
        "dynamic": F.lit(int(cfg.dynamic)), "mode_roll": F.lit(int(cfg.roll_costs))})


def drawdown(equity: Column, w, start: float | None = None) -> Column:
    """Equity minus its running peak (<= 0). ``start`` is an opening level the peak begins from."""
    peak = F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if start is not None:
        peak = F.greatest(peak, F.lit(float(start)))
    return equity - peak
