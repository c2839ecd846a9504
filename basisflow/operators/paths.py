"""Strategies that see a whole trade path.

A column strategy (``hedge.py``) reads its ratio from the calendar. A path strategy gets the complete days of a trade, in order, and returns a ratio for each:
it may restart a model inside the window, react to what the trade has been through, or call any array code. The days of a trade are brought
together where the trade is placed by its scenario id, many trades go through one function call in a ragged Arrow
batch, and the ratios come back as one array per trade, so the wide trade-day rows are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basisflow.operators.hedge import Strategy, register
from basisflow.operators.recursion import sigma_columns
from basisflow.operators.windows import unfold

PATH_COLS = ("d_spot", "d_fut", "spot", "fut")


class Trades:
    """Days of several trades, one after the other: flat columns (missing is NaN), ``days`` since 1970 and ``starts``, where each trade begins, and the end."""

    def __init__(self, columns: dict[str, np.ndarray], days: np.ndarray, starts: np.ndarray):
        self.columns, self.days, self.starts = columns, days, starts

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def padded(self, values: np.ndarray, fill: float = np.nan) -> np.ndarray:
        """A row per day of the trade, a column per trade; shorter trades end in ``fill``."""
        size = np.diff(self.starts)
        out = np.full((size.max(initial=0), len(self)), fill)
        out[np.arange(len(values)) - np.repeat(self.starts[:-1], size), np.repeat(np.arange(len(self)), size)] = values
        return out

    def flat(self, padded: np.ndarray) -> np.ndarray:
        size = np.diff(self.starts)
        return padded[np.arange(size.sum()) - np.repeat(self.starts[:-1], size), np.repeat(np.arange(len(self)), size)]

    def each(self) -> Iterator[dict[str, np.ndarray]]:
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            yield {**{k: v[a:b] for k, v in self.columns.items()}, "days": self.days[a:b]}


@dataclass(frozen=True)
class PathStrategy(Strategy):
    """``paths`` maps trades to flat ratios. ``features`` are columns of the day table it needs besides differences and prices."""

    paths: Callable[[Trades], np.ndarray] | None = None
    features: tuple[str, ...] = ()


def path_strategy(name: str, paths: Callable[[Trades], np.ndarray], features: tuple[str, ...] = (),
                  prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> PathStrategy:
    """A strategy from a function of trades; where the function gives no finite ratio the trade holds nothing."""
    held = lambda c: F.coalesce(c, F.lit(0.0))
    return PathStrategy(name, lambda day: held(day(f"{name}__path_now")), lambda day: held(day(f"{name}__path_before")),
                        lambda: held(F.get(f"{name}__path", F.lit(0))), prepare, paths=paths, features=tuple(features))


def one_by_one(fn: Callable[[dict[str, np.ndarray]], np.ndarray]) -> Callable[[Trades], np.ndarray]:
    """A function of one trade's columns as one of many trades."""
    def run(trades: Trades) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[np.asarray(fn(t), float) for t in trades.each()]])
    return run


def day_by_day(h: Callable[[int, dict[str, np.ndarray]], float]) -> Callable[[Trades], np.ndarray]:
    """A ratio for day t from the columns up to t alone, asked for one day at a time."""
    return one_by_one(lambda t: [h(i, {k: v[:i + 1] for k, v in t.items()}) for i in range(len(t["days"]))])


def check_features(days: DataFrame, strategies: list[Strategy]) -> None:
    """Raise before any job if a day table lacks what a path strategy declares."""
    for s in strategies:
        missing = [f for f in getattr(s, "features", ()) if f not in days.columns]
        if missing:
            raise ValueError(f"strategy {s.name} needs day columns {missing}; there are {sorted(days.columns)}")


def with_paths(placed: DataFrame, days: DataFrame, strategies: list[PathStrategy]) -> DataFrame:
    """``placed`` (a row per trade, hashed by scenario_id, with pos0 and pos1) with an array of ratios ``<name>__path`` for each path strategy.

    A trade's days are collected by its id, which its hash placement already serves; a trade is as long as its window, so a row is bounded.
    """
    check_features(days, strategies)
    numbers = list(dict.fromkeys([*PATH_COLS, *(f for s in strategies for f in s.features)]))
    rows = unfold(placed.select("scenario_id", "exposure_id", "pos0", "pos1"), days, numbers)
    first = F.col("pos") == F.col("pos0")
    number = lambda c: F.when(first & F.lit(c in ("d_spot", "d_fut")), 0.0).otherwise(F.col(c).cast("double"))
    day = F.struct("pos", F.unix_date("d").alias("_day"), *[number(c).alias(c) for c in numbers])
    whole = rows.groupBy("scenario_id").agg(F.array_sort(F.collect_list(day)).alias("days"))
    lists = whole.select("scenario_id", "days._day", *[f"days.`{c}`" for c in numbers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {n: batch.column(n).flatten() for n in ["_day", *numbers]}
            starts = np.concatenate([[0], np.cumsum(batch.column("_day").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            columns = {n: flat[n].to_numpy(zero_copy_only=False).astype(float) for n in numbers}
            trades = Trades(columns, flat["_day"].to_numpy(zero_copy_only=False), starts)
            out = [batch.column("scenario_id")]
            for s in strategies:
                h = np.asarray(s.paths(trades), float)
                if len(h) != starts[-1]:
                    raise ValueError(f"strategy {s.name} gave {len(h)} ratios for {starts[-1]} days")
                out.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(h, mask=~np.isfinite(h))))
            yield pa.RecordBatch.from_arrays(out, ["scenario_id", *[f"{s.name}__path" for s in strategies]])

    key = dict(placed.dtypes)["scenario_id"]
    ratios = lists.mapInArrow(run, f"scenario_id {key}, " + ", ".join(f"`{s.name}__path` array<double>" for s in strategies))
    return placed.join(ratios, "scenario_id", "left")


def window_correlation(trades: Trades, z1: np.ndarray, z2: np.ndarray, a: float, b: float, window: int) -> np.ndarray:
    """Dynamic correlation that starts anew in every trade: all trades of a batch take each day's step together.

    q' = (1 - a - b) S + a z z' + b q from q = S, S being the moments of the trade's first ``window`` complete pairs; an incomplete pair leaves q.
    NaN on a trade's first day and in trades with fewer than five complete pairs.
    """
    x, y = trades.padded(z1), trades.padded(z2)
    ok = np.isfinite(x) & np.isfinite(y)
    used = ok & (np.cumsum(ok, axis=0) <= (window or len(ok)))
    n = np.maximum(used.sum(0), 1)
    mean = lambda v: np.where(used, v, 0.0).sum(0) / n
    dx, dy = x - mean(x), y - mean(y)
    fixed = np.array([mean(dx * dx), mean(dy * dy), mean(dx * dy)])
    moments = np.where(ok, np.array([x * x, y * y, x * y]), 0.0)
    q, rho = fixed.copy(), np.full(x.shape, np.nan)
    with np.errstate(all="ignore"):
        for t in range(1, len(x)):
            q = np.where(ok[t - 1], (1 - a - b) * fixed + a * moments[:, t - 1] + b * q, q)
            rho[t] = np.where((q[0] > 0) & (q[1] > 0), np.clip(q[2] / np.sqrt(q[0] * q[1]), -0.999, 0.999), np.nan)
    rho[:, ok.sum(0) < 5] = np.nan
    return trades.flat(rho)


def dcc_window(a: float = 0.01, b: float = 0.98, window: int = 252, fitted: bool = False, fallback: float = 0.0, limit: float = 3.0) -> PathStrategy:
    """The dynamic-correlation strategy that knows no return from before the trade: sigma_s / sigma_f * rho, ``fallback`` where undefined."""

    def paths(trades: Trades) -> np.ndarray:
        begins = trades.starts[:-1][np.diff(trades.starts) > 0]

        def returns(price: np.ndarray) -> np.ndarray:
            out = np.full(len(price), np.nan)
            with np.errstate(all="ignore"):
                out[1:] = price[1:] / price[:-1] - 1
            out[begins] = np.nan
            return np.where(np.isfinite(out), out, np.nan)

        rs, rf, ss, sf = returns(trades["spot"]), returns(trades["fut"]), trades["sigma_s"], trades["sigma_f"]
        live = np.isfinite(rs) & np.isfinite(rf) & (ss > 0) & (sf > 0) & np.isfinite(ss) & np.isfinite(sf)
        with np.errstate(all="ignore"):
            rho = window_correlation(trades, np.where(live, rs / ss, np.nan), np.where(live, rf / sf, np.nan), a, b, window)
            h = np.where(live & np.isfinite(rho), np.clip(ss / sf * rho, -limit, limit), fallback)
        return h

    return path_strategy("dcc_window", paths, ("sigma_s", "sigma_f"), lambda d: sigma_columns(d, fitted))


register("dcc_window", dcc_window)
