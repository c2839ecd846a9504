"""Data-quality tables over a long panel (series_id, d, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.operators.metrics import sample_kurtosis, sample_skew

WARN, HIGH = 0.05, 0.20
OUTLIER_Z = 6.0
QS = {"q01": 0.01, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99}


def coverage(df: DataFrame, value: str, key: str = "series_id", total: Column | None = None) -> DataFrame:
    """First and last day, count and missing share. ``total`` is the row count if not the group's own."""
    there = F.col(value).isNotNull()
    n = F.count(value)
    miss = 1 - n / (total if total is not None else F.count("*"))
    out = df.groupBy(key).agg(
        F.min(F.when(there, F.col("d"))).alias("start_date"), F.max(F.when(there, F.col("d"))).alias("end_date"),
        n.alias("n_obs"), miss.alias("missing_pct"))
    m = F.col("missing_pct")
    return out.withColumn("missing_flag", F.when(m >= HIGH, "HIGH").when(m >= WARN, "WARN").otherwise("OK"))


def describe(df: DataFrame, value: str, key: str = "series_id") -> DataFrame:
    """Moments and quantiles per series. A series has one row per day, so the built-in exact
    percentile holds at most a calendar of values per group."""
    x = F.col(value)
    return df.groupBy(key).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.percentile(x, F.array(*[F.lit(q) for q in QS.values()])).alias("_q"), F.max(x).alias("max"),
        sample_skew(x).alias("skew"), sample_kurtosis(x).alias("kurtosis_excess"),
    ).select(key, "n", "mean", "std", "min", *[F.col("_q")[i].alias(c) for i, c in enumerate(QS)], "max", "skew",
             "kurtosis_excess")


def trading_days(flags: DataFrame, tradable: str, key: str) -> DataFrame:
    off = F.col(tradable) == 0
    weekend = F.weekday("d") >= 5
    n = F.count("*")
    return flags.groupBy(key).agg(
        n.alias("total_days"), F.count_if(~off).alias("tradable_days"), F.count_if(off).alias("non_tradable_days"),
        F.count_if(off & weekend).alias("non_tradable_weekend"),
        F.count_if(off & ~weekend).alias("non_tradable_weekday"), (F.count_if(off) / n).alias("non_tradable_pct"))


def outliers(df: DataFrame, value: str, key: str = "series_id", limit: int | None = None) -> DataFrame:
    """Days whose z-score within the series reaches 6; ``limit`` keeps the first so many of each series."""
    w = Window.partitionBy(key)
    sd = F.stddev_samp(value).over(w)
    z = df.where(F.col(value).isNotNull()).withColumn(
        "zscore", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))
    hit = z.where(F.abs("zscore") >= OUTLIER_Z)
    if limit is None:
        return hit
    return hit.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("d"))).where(F.col("_rn") <= limit).drop("_rn")


def acf(df: DataFrame, value: str, nlags: int, key: str = "series_id") -> DataFrame:
    """Biased autocorrelations of lags 1..k over the present values; none if n < k + 5."""
    wk = Window.partitionBy(key)
    x = df.where(F.col(value).isNotNull()).select(key, "d", F.col(value).alias("x"))
    x = x.withColumn("c", F.col("x") - F.avg("x").over(wk))
    w = Window.partitionBy(key).orderBy("d")
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("c") * F.lag("c", k).over(w)).alias("p"))
                     for k in range(1, nlags + 1)])
    each = x.select(key, "c", lags.alias("ls"))
    sums = each.select(key, "c", F.explode("ls").alias("l")).groupBy(key, F.col("l.lag").alias("lag")).agg(
        F.sum("l.p").alias("s"), F.sum(F.col("c") * F.col("c")).alias("v"), F.count("*").alias("n"))
    return sums.where(F.col("n") >= nlags + 5).select(
        key, "lag", F.try_divide(F.coalesce("s", F.lit(0.0)), "v").alias("acf"))


def pacf(acfs: DataFrame, key: str = "series_id") -> DataFrame:
    """Partial autocorrelations from the k autocorrelations of each series (Levinson recursion)."""
    import numpy as np
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.concatenate([[1.0], pdf.sort_values("lag")["acf"].to_numpy()])
        out, phi = [], np.zeros(0)
        for k in range(1, len(r)):
            a = (r[k] - phi @ r[k - 1:0:-1]) / (1.0 - phi @ r[1:k]) if k > 1 else r[1]
            phi = np.append(phi - a * phi[::-1], a)
            out.append(a)
        return pd.DataFrame({key: pdf[key].iloc[0], "lag": range(1, len(r)), "pacf": out})
    return acfs.groupBy(key).applyInPandas(solve, f"{key} string, lag int, pacf double")
