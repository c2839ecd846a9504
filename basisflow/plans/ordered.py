"""Dedupe and selection with an explicit order.

``dropDuplicates`` keeps an arbitrary row. These keep the first or the last one by order columns
and do it with ``min_by`` / ``max_by``, which combine on the map side: a key that owns a third of
all rows still sends only one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisflow.plans.keys import _join_keys


def _pick(df: DataFrame, keys: list[str], order: list[str | Column], last: bool) -> DataFrame:
    by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    chosen = (F.max_by if last else F.min_by)(whole, by)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select("_row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return _pick(df, keys, order, last=True)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return _pick(df, keys, order, last=False)


def sub_buckets(df: DataFrame, groups: list[str], order: str, out: str = "_b", cuts: int = 64, least: int = 100_000) -> DataFrame:
    """Bucket numbers that rise with ``order`` inside each group, so that a large group can be ordered piece by piece.

    Cut points are approximate quantiles of the order column, of its first seven bytes if it is text. Equal values share a bucket. Groups of at most
    ``least`` rows stay whole.
    """
    large = df.groupBy(*groups).agg(F.count("*").alias("_rows")).where(F.col("_rows") > least).drop("_rows")
    if least and large.isEmpty():
        return df.withColumn(out, F.lit(0))
    if dict(df.dtypes)[order] == "string":
        at = F.conv(F.rpad(F.hex(F.substring(F.col(order).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    else:
        at = F.col(order).cast("double")
    d = df.withColumn("_at", F.coalesce(at, F.lit(float("-inf"))))
    inside = _join_keys(d, large.withColumn("_large", F.lit(True)), groups, "inner") if least else d
    points = inside.groupBy(*groups).agg(F.array_distinct(F.percentile_approx("_at", [i / cuts for i in range(1, cuts)], 1000)).alias("_points"))
    below = F.coalesce(F.size(F.filter("_points", lambda p: p < F.col("_at"))), F.lit(0))
    return _join_keys(d, points, groups).withColumn(out, F.when(F.col("_points").isNull(), 0).otherwise(below)).drop("_at", "_points")
