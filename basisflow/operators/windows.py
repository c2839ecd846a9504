"""Market calendar, day maps and the join of trades with their daily rows.

Positions on the calendar replace date ranges: a trade looks up its first and last position by
equi-join, unfolds the positions in between and fetches each day by equi-join again. No range
condition reaches the join planner, and the calendar side is bounded by exposures x days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basisflow.operators.returns import diff0

MIN_REALIZED = 15
HISTORY_ROWS = 2520
DAYS_A_TASK = 250_000


def market_calendar(uni: DataFrame, series: DataFrame) -> DataFrame:
    """Universe and futures series on common days, numbered.

    ``idx`` numbers all rows of an exposure, ``pos`` only those with spot and futures present.
    """
    s = series.select("d", F.col("f_mark").alias("fut"), "pnl_1c", "roll_flag")
    m = uni.join(s, "d")
    w = Window.partitionBy("exposure_id").orderBy("d")
    valid = F.col("spot").isNotNull() & F.col("fut").isNotNull()
    return m.withColumns({
        "valid": F.when(valid, 1).otherwise(0),
        "idx": F.row_number().over(w),
    }).withColumn("pos", F.sum("valid").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def valid_days(cal: DataFrame) -> DataFrame:
    """Usable rows with daily differences and simple returns against the usable row before."""
    w = Window.partitionBy("exposure_id").orderBy("pos")
    v = cal.where(F.col("valid") == 1)
    return v.withColumns({
        "d_spot": diff0(F.col("spot"), w), "d_fut": diff0(F.col("fut"), w),
        "r_s": F.try_divide("spot", F.lag("spot").over(w)) - 1,
        "r_f": F.try_divide("fut", F.lag("fut").over(w)) - 1})


def day_map(cal: DataFrame, key: str = "exposure_id") -> DataFrame:
    """Every calendar day with the last trading day on or before it (backward as-of, precomputed)."""
    span = cal.groupBy(key).agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    dense = span.select(key, F.explode(F.sequence("d0", "d1")).alias("cal_d"))
    have = cal.select(key, F.col("d").alias("cal_d"), F.col("d").alias("trade_d"))
    w = Window.partitionBy(key).orderBy("cal_d").rowsBetween(Window.unboundedPreceding, 0)
    return dense.join(have, [key, "cal_d"], "left").withColumn(
        "trade_d", F.last("trade_d", ignorenulls=True).over(w))


def realise_end(trades: DataFrame, days: DataFrame, min_days: int = MIN_REALIZED, more: tuple[str, ...] = ()) -> DataFrame:
    """End date and coverage flag of trades asked for as (start_date, horizon_days_target); ``more`` names further columns of the day map to take along."""
    t = trades.withColumn("_target", F.date_add("start_date", F.col("horizon_days_target")))
    m = days.select("exposure_id", F.col("cal_d").alias("_target"), F.col("trade_d").alias("_end"), *more)
    j = t.join(m, ["exposure_id", "_target"], "left")
    realised = F.datediff(F.coalesce("_end", "_target"), "start_date")
    return j.withColumns({
        "end_date": F.coalesce("_end", "_target"),
        "horizon_days_realized": realised,
        "data_coverage_flag": F.when(F.col("_end").isNull() | (realised < min_days), "REJECTED")
        .when(realised == F.col("horizon_days_target"), "OK").otherwise("SHORTENED"),
    }).drop("_target", "_end")


def bounds(trades: DataFrame, cal: DataFrame, start_cols: list[str] = (), end_cols: list[str] = ()) -> DataFrame:
    """Trades whose two dates are both calendar days, with their positions and dropped-row count."""
    first = F.col("pos") + 1 - F.col("valid")
    s = cal.select("exposure_id", F.col("d").alias("start_date"), F.col("idx").alias("_i0"),
                   first.alias("pos0"), *[F.col(c).alias(f"start_{c}") for c in start_cols])
    e = cal.select("exposure_id", F.col("d").alias("end_date"), F.col("idx").alias("_i1"),
                   F.col("pos").alias("pos1"), *[F.col(c).alias(f"end_{c}") for c in end_cols])
    j = trades.join(s, ["exposure_id", "start_date"]).join(e, ["exposure_id", "end_date"])
    j = j.where(F.col("_i1") >= F.col("_i0"))
    n, kept = F.col("_i1") - F.col("_i0") + 1, F.col("pos1") - F.col("pos0") + 1
    j = j.withColumns({"window_dropped_nan_rows": n - kept, "window_rows": kept})
    return j.where((F.col("window_dropped_nan_rows") == 0) | (F.col("window_rows") >= 2)).drop("_i0", "_i1")


def by_scenario(trades: DataFrame, most: int | None = None) -> DataFrame:
    """Narrow trade rows with pos0 and pos1, hashed by scenario into as many tasks as keep each at about ``most`` unfolded days.

    A task sorts the days of its trades, once more for every strategy where these are stacked: it should hold them in memory whatever the size of the table.
    """
    n = trades.agg(F.sum(F.col("pos1") - F.col("pos0") + 1)).first()[0] or 0
    least = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return trades.repartition(max(least, -(-n // (most or DAYS_A_TASK))), "scenario_id")


def unfold(trades: DataFrame, days: DataFrame, cols: list[str], paths: tuple[str, ...] = ()) -> DataFrame:
    """One row per trade and usable day in its window.

    Sorted as soon as a trade has its days, before the columns of the strategies widen the rows (a sort below the join would be dropped by Catalyst), so
    running sums per trade need no later sort. Of each array column in ``paths`` a day gets its own element (``_now``) and the one before (``_before``).
    """
    day = F.col("pos") - F.col("pos0")
    each = trades.withColumn("pos", F.explode(F.sequence("pos0", "pos1"))).withColumns(
        {f"{p}_{when}": F.get(p, (day - back).cast("int")) for p in paths for when, back in (("now", 0), ("before", 1))})
    rows = each.drop(*paths).join(days.select("exposure_id", "pos", "d", *cols), ["exposure_id", "pos"])
    return rows.sortWithinPartitions("scenario_id", "pos")


def history_bounds(trades: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """Positions of the last ``rows`` usable days strictly before the start."""
    return trades.withColumns({
        "hist1": F.col("pos0") - 1,
        "hist0": F.greatest(F.lit(1), F.col("pos0") - rows)})


def date_positions(asked: DataFrame, cal: DataFrame, at: str = "d") -> DataFrame:
    """Exact position of a date (or -1), first position at or after it, last one at or before it."""
    w = Window.partitionBy("exposure_id").orderBy("_t", "_q")
    u = (cal.select("exposure_id", F.col("d").alias("_t"), F.lit(1).alias("_q"), (F.col("idx") - 1).alias("i"))
         .unionByName(asked.select("exposure_id", F.col(at).alias("_t"), F.lit(2).alias("_q")).distinct(),
                      allowMissingColumns=True))
    before = F.last("i", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    day = F.last(F.when(F.col("_q") == 1, F.col("_t")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    u = u.withColumns({"_b": before, "_bd": day}).where(F.col("_q") == 2)
    exact = F.col("_bd") == F.col("_t")
    return u.select(
        "exposure_id", F.col("_t").alias(at),
        F.when(exact, F.col("_b")).otherwise(-1).alias("exact_idx"),
        F.when(exact, F.col("_b")).otherwise(F.coalesce(F.col("_b") + 1, F.lit(0))).alias("left_idx"),
        F.coalesce("_b", F.lit(-1)).alias("back_idx"))
