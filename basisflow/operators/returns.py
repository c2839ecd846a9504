"""Returns, rolling statistics and the lagged feature set, all as window expressions per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.functions.core import clip, ratio_minus_one
from basisflow.plans.sliding import correlation, pair_moments, slope_of


def diff0(x: Column, w) -> Column:
    """Difference to the row before, 0 on the first row."""
    return F.coalesce(x - F.lag(x).over(w), F.lit(0.0))


def simple_return(x: Column, w) -> Column:
    return F.try_divide(x, F.lag(x).over(w)) - 1


def log_return(x: Column, w) -> Column:
    p = F.lag(x).over(w)
    return F.when((x > 0) & (p > 0), F.log(x / p))


def hybrid_return(x: Column, w) -> tuple[Column, Column]:
    """Log return, else simple return; and a flag for rows that had to use the simple one."""
    lr, sr = log_return(x, w), simple_return(x, w)
    return F.coalesce(lr, sr), F.when(lr.isNull() & sr.isNotNull(), 1).otherwise(0)


def damped_return(x: Column, w) -> Column:
    """Log return with fallback sign(r) * log1p(|r|) of the simple return."""
    r = simple_return(x, w)
    return F.coalesce(log_return(x, w), F.signum(r) * F.log1p(F.abs(r)))


def safe_log_return(x: Column, w) -> Column:
    return F.coalesce(log_return(x, w), F.lit(0.0))


def past_sum(x: Column, w, n: int) -> Column:
    """Sum over rows t-n..t-1, missing as 0."""
    return F.coalesce(F.sum(x).over(w.rowsBetween(-n, -1)), F.lit(0.0))


def past_mean(x: Column, w, n: int) -> Column:
    return F.coalesce(F.avg(x).over(w.rowsBetween(-n, -1)), F.lit(0.0))


def running_totals(terms: dict[str, Column], w) -> dict[str, Column]:
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return {k: F.coalesce(F.sum(v).over(run), F.lit(0.0)) for k, v in terms.items()}


def rolling_corrs(df: DataFrame, a: str, b: str, key: str, order: str, windows: dict[str, int]) -> DataFrame:
    """A column per window: Pearson over the last rows, at least max(20, window // 2) complete pairs; NULL where a side is constant."""
    d = pair_moments(df, key, order, sorted(set(windows.values())), a, b)
    need = F.greatest(F.lit(20), F.floor(F.col("window") / 2))
    d = d.select("key", "at", "row", "window", F.when(F.col("m.n") >= need, correlation()).alias("r"))
    wide = d.groupBy("key", "at").agg(F.any_value("row").alias("row"), *[F.max(F.when(F.col("window") == n, F.col("r"))).alias(c) for c, n in windows.items()])
    return wide.select("row.*", *windows)


def rolling_corr(df: DataFrame, a: str, b: str, key: str, order: str, window: int, out: str) -> DataFrame:
    d = pair_moments(df, key, order, [window], a, b)
    return d.select("row.*", F.when(F.col("m.n") >= max(20, window // 2), correlation()).alias(out))


def slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, intercept: Column | bool) -> Column:
    """Least-squares slope of y on x from sums; NULL when x does not vary."""
    plain = F.when(sxx != 0, sxy / sxx)
    dx = sxx - sx * sx / n
    centred = F.when((n > 0) & (dx != 0), (sxy - sx * sy / n) / dx)
    if isinstance(intercept, bool):
        return centred if intercept else plain
    return F.when(intercept, centred).otherwise(plain)


def rolling_slope(df: DataFrame, x: str, y: str, key: str, order: str, window: int, min_obs: int,
                  intercept: Column | bool, out: str) -> DataFrame:
    """Slope over the last ``window`` rows (invalid rows count towards the frame); NULL below min_obs. ``intercept`` may be a column of ``df``."""
    kept = df if isinstance(intercept, bool) else df.withColumn("_intercept", intercept)
    d = pair_moments(kept, key, order, [window], x, y)
    use = intercept if isinstance(intercept, bool) else F.col("row._intercept")
    return d.select(*[F.col(f"row.`{c}`") for c in df.columns], F.when(F.col("m.n") >= min_obs, slope_of(use)).alias(out))


def regression_ratio(b: Column) -> Column:
    """A slope as hedge ratio: missing is 0, held in +-2."""
    return clip(F.coalesce(b, F.lit(0.0)), -2, 2)


def spread_features(df: DataFrame, w, spot="spot", cl1="cl1", cl2="cl2", cl4="cl4") -> DataFrame:
    d = df.withColumns({
        "spread_12": F.col(cl1) - F.col(cl2), "spread_14": F.col(cl1) - F.col(cl4),
        "basis": F.col(spot) - F.col(cl1)})
    return d.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in ("spread_12", "spread_14", "basis")})


def momentum_features(df: DataFrame, key: str = "exposure_id", order: str = "d") -> DataFrame:
    """Lagged momentum, moving-average gaps and basis features; row t only sees rows up to t-1.

    Needs spot, fut and tradable. Returns are zero on days without an update.
    """
    w = series_window_of(key, order)
    live = lambda r: F.when(F.col("tradable") > 0, r).otherwise(0.0)
    d = df.withColumns({
        "rs": live(safe_log_return(F.col("spot"), w)), "rf": live(safe_log_return(F.col("fut"), w)),
        "basis": F.col("spot") - F.col("fut")})
    d = d.withColumn("basis_ret", diff0(F.col("basis"), w))
    f = {"basis_lag1": F.coalesce(F.lag("basis").over(w), F.lit(0.0)),
         "basis_change_lag1": F.coalesce(F.lag("basis_ret").over(w), F.lit(0.0))}
    for n in (3, 5, 10, 20):
        f[f"spot_mom_{n}d_lag1"] = past_sum(F.col("rs"), w, n)
        f[f"fut_mom_{n}d_lag1"] = past_sum(F.col("rf"), w, n)
    for side, c in (("spot", "spot"), ("fut", "fut")):
        ma = {n: past_mean(F.col(c), w, n) for n in (5, 10, 20)}
        f[f"{side}_ma_5_20_gap_lag1"] = ratio_minus_one(ma[5], ma[20])
        f[f"{side}_ma_10_20_gap_lag1"] = ratio_minus_one(ma[10], ma[20])
    for n in (5, 10):
        f[f"basis_mom_{n}d_lag1"] = past_sum(F.col("basis_ret"), w, n)
    d = d.withColumns(f)
    return d.withColumns({f"spot_minus_fut_mom_{n}d_lag1":
                          F.col(f"spot_mom_{n}d_lag1") - F.col(f"fut_mom_{n}d_lag1") for n in (5, 10)})


def series_window_of(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)
