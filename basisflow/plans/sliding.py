"""Moments of sliding row windows in linear time.

The rows of a series are cut into blocks as long as the window. Inside each block values are summed from its first row on, and over the rows behind each
row; a window is the head of one block and what follows the same place in the block before, so two additions give it, whatever its length.
Nothing is subtracted from a running total, so no digits are lost, and extremes work the same way, which tells exactly when a window is
constant. Several window lengths share one exchange and one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUMS, _ENDS = ("n", "x", "y", "xx", "yy", "xy"), ("min_x", "max_x", "min_y", "max_y")


def pair_moments(df: DataFrame, key: str, order: str, windows: Sequence[int], x: str, y: str) -> DataFrame:
    """Moments of the pairs (x, y) that are complete, over the last rows of a series, for each window length.

    Rows: ``row`` (struct of the input row), ``at`` (its number, from 0), ``window``, and ``m``: n, ref_x, ref_y, x, y, xx, yy, xy (sums of x - ref_x and
    so on), min_x, max_x, min_y, max_y. The reference is the last complete pair before the current block, close to the data, so centred moments keep
    their digits.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    pair = F.when(ok, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    series = Window.partitionBy("key").orderBy("order")
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    d = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{order}`").alias("order"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), pair.alias("pair"))
    d = d.select("key", "order", "row", "pair", (F.row_number().over(series) - 1).alias("at"), F.last("pair", ignorenulls=True).over(upto).alias("seen"))
    d = d.select("key", "row", "pair", "at", "seen", F.lag("seen").over(series).alias("before"))
    # by itself: next to a window function Spark would multiply the rows first
    d = d.select("*", F.explode(F.array(*map(F.lit, windows))).alias("window"))
    d = d.select("*", F.floor(F.col("at") / F.col("window")).alias("block"), (F.col("at") % F.col("window")).alias("place"))
    block = Window.partitionBy("key", "window", "block")
    head = block.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    behind = block.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)

    def totals(frame, ref: str) -> Column:
        v = {f: F.col(f"pair.{f}") - F.coalesce(F.col(f"{ref}.{f}"), F.lit(0.0)) for f in "xy"}
        made = {"n": F.count("pair"), "x": F.sum(v["x"]), "y": F.sum(v["y"]), "xx": F.sum(v["x"] * v["x"]), "yy": F.sum(v["y"] * v["y"]), "xy": F.sum(v["x"] * v["y"]),
                "min_x": F.min("pair.x"), "max_x": F.max("pair.x"), "min_y": F.min("pair.y"), "max_y": F.max("pair.y")}
        return F.struct(*[a.over(frame).alias(k) for k, a in made.items()])

    d = d.withColumn("ref", F.first("before").over(head)).withColumn("head", totals(head, "ref"))
    # what the block behind will use as its reference: the last pair up to the end of this block
    d = d.withColumn("end", F.first("seen").over(block.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("behind", totals(behind, "end"))
    d = d.withColumn("far", F.lag("behind").over(Window.partitionBy("key", "window", "place").orderBy("block")))
    zero = F.lit(0.0)
    m = [(F.coalesce(f"head.{k}", zero) + F.coalesce(f"far.{k}", zero)).alias(k) for k in _SUMS]
    m += [(F.least if k.startswith("min") else F.greatest)(f"head.{k}", f"far.{k}").alias(k) for k in _ENDS]
    m += [F.coalesce(f"ref.{f}", zero).alias(f"ref_{f}") for f in "xy"]
    return d.select("key", "at", "row", "window", F.struct(*m).alias("m"))


def correlation(m: str = "m") -> Column:
    """Pearson from moments; NULL where a side does not vary."""
    c = lambda k: F.col(f"{m}.{k}")
    sxy, sxx, syy = (c(k) - F.try_divide(c(k[0]) * c(k[1]), c("n")) for k in ("xy", "xx", "yy"))
    varies = (c("min_x") < c("max_x")) & (c("min_y") < c("max_y"))
    return F.when(varies & (sxx > 0) & (syy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy)))))


def slope_of(intercept: Column | bool, m: str = "m") -> Column:
    """Least-squares slope of y on x from moments; NULL when x does not vary (with intercept) or is zero throughout (without)."""
    c = lambda k: F.col(f"{m}.{k}")
    centred = F.when(c("min_x") < c("max_x"), F.try_divide(c("xy") - F.try_divide(c("x") * c("y"), c("n")), c("xx") - F.try_divide(c("x") * c("x"), c("n"))))
    raw_xx = c("xx") + 2 * c("ref_x") * c("x") + c("n") * c("ref_x") * c("ref_x")
    raw_xy = c("xy") + c("ref_x") * c("y") + c("ref_y") * c("x") + c("n") * c("ref_x") * c("ref_y")
    plain = F.when((c("min_x") != 0) | (c("max_x") != 0), F.try_divide(raw_xy, raw_xx))
    if isinstance(intercept, bool):
        return centred if intercept else plain
    return F.when(intercept, centred).otherwise(plain)
