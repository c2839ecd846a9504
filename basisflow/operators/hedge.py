"""Hedge strategies as a registry of column builders.

A strategy adds per-day columns to the calendar once, for all trades that share the exposure, and
says how a trade-day row reads its ratio from them. A strategy that only knows the state at the
start of a trade reads ``start_*`` columns instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.functions.core import clip
from basisflow.operators.returns import regression_ratio, rolling_slope, slope
from basisflow.operators.windows import HISTORY_ROWS

# fixed values: exposures hedged with their own futures, whose regressions have no intercept
DIRECT = ("WTI_SPOT", "WTI")


def default_intercept(exposure: Column, direct: tuple[str, ...] = DIRECT) -> Column:
    return ~F.upper(exposure).isin(*[d.upper() for d in direct])


Day = Callable[[str], Column]


@dataclass(frozen=True)
class Strategy:
    """``prepare`` extends the day table; ``ratio`` and ``before`` read today's and yesterday's ratio.

    They get a reader of day columns, since a day is either a row or an element of a trade's array.
    ``on_trade`` is a ratio fixed per trade; it is computed on the narrow trade rows and read by
    ``ratio`` as the column ``<name>__h0``.
    """

    name: str
    ratio: Callable[[Day], Column]
    before: Callable[[Day], Column]
    at_start: Callable[[], Column]
    prepare: Callable[[DataFrame], DataFrame] = lambda days: days
    day_cols: tuple[str, ...] = ()
    start_cols: tuple[str, ...] = ()
    end_cols: tuple[str, ...] = ()
    on_trade: Callable[[], Column] | None = None


def constant(name: str, h: float, hold: tuple[float, float] | None = None) -> Strategy:
    x = float(min(max(h, hold[0]), hold[1]) if hold else h)
    lit = lambda day: F.lit(x)
    return Strategy(name, lit, lit, lambda: F.lit(x))


def nohedge() -> Strategy:
    return constant("nohedge", 0.0)


def naive(h: float = 1.0, clip_to: tuple[float, float] | None = None) -> Strategy:
    return constant("naive", h, clip_to)


def by_day(name: str, prepare: Callable[[DataFrame], DataFrame], col: str) -> Strategy:
    """A ratio that depends on exposure and day only: one column, and its value the day before."""
    def add(days: DataFrame) -> DataFrame:
        w = Window.partitionBy("exposure_id").orderBy("pos")
        return prepare(days).withColumn(f"{col}_before", F.lag(col).over(w))
    return Strategy(name, lambda day: day(col), lambda day: day(f"{col}_before"), lambda: F.col(f"start_{col}"),
                    add, (col, f"{col}_before"), (col,))


def ols_roll(window: int = 120, min_obs: int = 30, intercept: bool | None = None,
             direct: tuple[str, ...] = DIRECT) -> Strategy:
    col = f"h_ols_roll_{window}"

    def prepare(days: DataFrame) -> DataFrame:
        use = default_intercept(F.col("exposure_id"), direct) if intercept is None else intercept
        d = rolling_slope(days, "r_f", "r_s", "exposure_id", "pos", window, min_obs, use, col)
        return d.withColumn(col, regression_ratio(F.col(col)))
    return by_day("ols_roll", prepare, col)


_SUMS = ("n", "x", "y", "xx", "xy")


def history_sums(days: DataFrame) -> DataFrame:
    """Running totals of complete return pairs: before today, up to today, and up to the history start."""
    w = Window.partitionBy("exposure_id").orderBy("pos")
    ok = F.col("r_s").isNotNull() & F.col("r_f").isNotNull()
    x, y = F.when(ok, F.col("r_f")), F.when(ok, F.col("r_s"))
    terms = {"n": F.when(ok, 1.0), "x": x, "y": y, "xx": x * x, "xy": x * y}
    upto = lambda off: w.rowsBetween(Window.unboundedPreceding, off)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return days.withColumns({
        **{f"c0_{k}": zero(F.sum(t).over(upto(-1))) for k, t in terms.items()},
        **{f"c1_{k}": zero(F.sum(t).over(upto(0))) for k, t in terms.items()},
        **{f"cb_{k}": zero(F.sum(t).over(upto(-HISTORY_ROWS))) for k, t in terms.items()}})


def ols_static(min_obs: int = 60, intercept: bool | None = None, sees_window: bool = False,
               direct: tuple[str, ...] = DIRECT) -> Strategy:
    """One slope per trade from the last HISTORY_ROWS days.

    By default only days before the start count. ``sees_window=True`` also includes the trade's own
    window, which is what the original system computes although it calls the ratio static.
    The sums are differences of running totals on the calendar, so no history is joined.
    """
    name = "ols_static"
    base = [f"cb_{k}" for k in _SUMS]
    top = [f"{'c1' if sees_window else 'c0'}_{k}" for k in _SUMS]
    side = "end" if sees_window else "start"

    def h() -> Column:
        n, x, y, xx, xy = [F.col(f"{side}_{t}") - F.col(f"start_{b}") for t, b in zip(top, base)]
        use = default_intercept(F.col("exposure_id"), direct) if intercept is None else intercept
        b = slope(n, x, y, xx, xy, use)
        return regression_ratio(F.when(n >= min_obs, b))
    read = lambda day: F.col(f"{name}__h0")
    return Strategy(name, read, read, lambda: F.col(f"{name}__h0"), history_sums, (), tuple(base if sees_window else base + top),
                    tuple(top if sees_window else ()), h)


def precomputed(name: str, col: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d,
                fallback: float = 0.0, limit: float = 3.0) -> Strategy:
    """A ratio column of the calendar, carried forward inside the trade window only.

    The day table keeps the last value and where it was seen; a trade uses it only if that is not
    before its own first day.
    """
    last, seen = f"{col}_last", f"{col}_seen"

    def add(days: DataFrame) -> DataFrame:
        w = Window.partitionBy("exposure_id").orderBy("pos")
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        d = prepare(days).withColumns({
            last: F.last(col, ignorenulls=True).over(run),
            seen: F.last(F.when(F.col(col).isNotNull(), F.col("pos")), ignorenulls=True).over(run)})
        return d.withColumns({f"{c}_before": F.lag(c).over(w) for c in (last, seen)})

    def read(v: Column, s: Column) -> Column:
        kept = F.when(s >= F.col("pos0"), v)
        return clip(F.coalesce(kept, F.lit(float(fallback))), -limit, limit)
    first = lambda: clip(F.coalesce(F.col(f"start_{col}"), F.lit(float(fallback))), -limit, limit)
    return Strategy(name, lambda day: read(day(last), day(seen)),
                    lambda day: read(day(f"{last}_before"), day(f"{seen}_before")), first,
                    add, (last, seen, f"{last}_before", f"{seen}_before"), (col,))


_FACTORIES: dict[str, Callable[..., Strategy]] = {
    "nohedge": nohedge, "naive": naive, "ols_static": ols_static, "ols_roll": ols_roll}
_ALIASES = {"ols": "ols_static", "mvhr": "ols_static", "rolling_ols": "ols_roll", "ols_rolling": "ols_roll",
            "ccc": "ccc_garch", "cccgarch": "ccc_garch", "dcc": "dcc_garch", "dccgarch": "dcc_garch"}


def register(name: str, factory: Callable[..., Strategy]) -> None:
    _FACTORIES[name] = factory


def available_strategies() -> list[str]:
    return sorted(_FACTORIES)


def make_strategy(name: str, **kw) -> Strategy:
    key = name.strip().lower()
    key = _ALIASES.get(key, key)
    if key not in _FACTORIES:
        raise ValueError(f"unknown strategy {name!r}; available: {available_strategies()}")
    return _FACTORIES[key](**kw)
