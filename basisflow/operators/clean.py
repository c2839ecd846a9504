"""Panel cleaning: casts, zero handling, update flags, calendar alignment, forward fill, universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.functions.core import finite


def series_window(key: str = "series_id", order: str = "d"):
    return Window.partitionBy(key).orderBy(order)


def to_double(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast columns to double; what cannot be read becomes NULL, and so do NaN and infinities."""
    return df.withColumns({c: finite(F.col(c).try_cast("double")) for c in cols})


def updated_flag(c: Column) -> Column:
    """1 when the raw value is there and not zero."""
    return F.when(c.isNotNull() & (c != 0), 1).otherwise(0).cast("int")


def zero_to_missing(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def changed_flag(c: Column, w) -> Column:
    """1 when a value is present and differs from the row before (a missing one counts as different)."""
    prev = F.lag(c).over(w)
    return F.when(c.isNotNull() & (prev.isNull() | (c != prev)), 1).otherwise(0).cast("int")


def forward_fill(c: Column, w, limit: int | None = None) -> Column:
    """Last value present so far; with a limit, carried over at most that many rows."""
    last = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if limit is None:
        return last
    rn = F.row_number().over(w)
    seen = F.last(F.when(c.isNotNull(), rn), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(rn - seen <= limit, last)


def align_calendar(panel: DataFrame) -> DataFrame:
    """Rows for each series on every panel day since its first one.

    The day list is bounded by the calendar. Each series unfolds its own span of days, so no
    product of two tables is formed.
    """
    days = panel.select("d").distinct()
    last_day = panel.agg(F.max("d")).scalar()
    spans = panel.groupBy("series_id").agg(F.min("d").alias("d0"))
    grid = (spans.select("series_id", F.explode(F.sequence("d0", last_day)).alias("d"))
            .join(days, "d", "left_semi"))
    return grid.join(panel, ["series_id", "d"], "left")


def filled_panel(panel: DataFrame, limit: int | None = None) -> DataFrame:
    """Aligned panel with update flag (taken from the raw value), zeros dropped, gaps carried forward."""
    w = series_window()
    clean = align_calendar(panel).withColumns({
        "updated": updated_flag(F.col("price")), "core": zero_to_missing(F.col("price"))})
    return clean.select("series_id", "d", F.col("price").alias("raw"), "updated",
                        forward_fill(F.col("core"), w, limit).alias("value"))


def universe(filled: DataFrame, exposures: list[str], front: str, second: str | None) -> DataFrame:
    """(exposure_id, d, spot, cl1, cl2, flags): days on which spot and front month exist."""
    cl1 = filled.where(F.col("series_id") == front).select(
        "d", F.col("value").alias("cl1"), F.col("updated").alias("cl1_updated"))
    spot = filled.where(F.col("series_id").isin(*exposures)).select(
        F.col("series_id").alias("exposure_id"), "d", F.col("value").alias("spot"),
        F.col("updated").alias("spot_updated"))
    out = spot.where(F.col("spot").isNotNull()).join(cl1.where(F.col("cl1").isNotNull()), "d")
    if second:
        cl2 = filled.where(F.col("series_id") == second).select("d", F.col("value").alias("cl2"))
        out = out.join(cl2, "d", "left")
    else:
        out = out.withColumn("cl2", F.lit(None).cast("double"))
    return out.select("exposure_id", "d", "spot", "cl1", "cl2", "spot_updated", "cl1_updated",
                      F.col("cl1_updated").alias("tradable"))


def exposure_lookup(names: DataFrame, known: DataFrame) -> DataFrame:
    """Resolve asked-for names to exposure ids.

    Order: exact id, id ignoring case, exact price column, price column ignoring case. Each rule is
    one equi-join on its own spelling; the best rule wins.
    """
    n = names.select(F.trim("asked").alias("asked")).distinct()
    rules = [(F.col("asked"), F.col("exposure_id")), (F.lower("asked"), F.lower("exposure_id")),
             (F.col("asked"), F.col("price_column")), (F.lower("asked"), F.lower("price_column"))]
    tries = n.select("asked", F.posexplode(F.array(*[a for a, _ in rules])).alias("rule", "spelling"))
    have = known.select("exposure_id", F.posexplode(F.array(*[b for _, b in rules])).alias("rule", "spelling"))
    found = tries.join(have, ["rule", "spelling"])
    best = found.groupBy("asked").agg(F.min_by("exposure_id", F.struct("rule", "exposure_id")).alias("exposure_id"))
    return n.join(best, "asked", "left")


def missing_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"isnan_{c}": F.col(c).isNull().cast("int") for c in cols})
