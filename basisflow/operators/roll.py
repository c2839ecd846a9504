"""Roll calendar, roll-aware futures marks and per-contract P&L."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basisflow.operators.clean import changed_flag

ANCHOR_DAY = 25
LTD_BACK, ROLL_BACK = 3, 2
CONTRACT_BBL = 1000


def tradable_days(fut: DataFrame, key: str = "instrument") -> DataFrame:
    """Numbered days on which the front month was really updated (key, d, pos from 0)."""
    w = Window.partitionBy(key).orderBy("d")
    t = fut.withColumn("_t", changed_flag(F.col("cl1"), w)).where(F.col("_t") == 1)
    return t.select(key, "d", (F.row_number().over(w) - 1).alias("pos"))


def as_of(asked: DataFrame, have: DataFrame, keys: list[str], at: str, on: str, take: list[str]) -> DataFrame:
    """Backward as-of: for each (keys, at) the row of ``have`` with the largest ``on`` <= ``at``.

    Both sides meet in one union sorted per key, so no range condition is joined. Both are calendar
    tables here, at most one row per key and day.
    """
    a = asked.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_q"))
    h = have.select(*keys, F.col(on).alias("_t"), F.lit(0).alias("_q"), *take)
    w = Window.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    u = h.unionByName(a, allowMissingColumns=True)
    last = F.last(F.when(F.col("_q") == 0, F.struct(*take)), ignorenulls=True).over(w)
    return (u.withColumn("_m", last).where(F.col("_q") == 1)
            .select(*keys, F.col("_t").alias(at), *[F.col(f"_m.{c}").alias(c) for c in take]))


def nth_previous_tradable(asked: DataFrame, days: DataFrame, n: int, at: str = "d",
                          key: str = "instrument", out: str = "prev_d") -> DataFrame:
    """The n-th tradable day before the last one <= the asked day; the first day when too early."""
    q = asked.select(key, at).distinct()
    p = as_of(q, days, [key], at, "d", ["pos"])
    p = p.withColumn("pos", F.greatest(F.coalesce("pos", F.lit(0)) - n, F.lit(0)))
    d = days.select(key, "pos", F.col("d").alias(out))
    return p.join(d, [key, "pos"]).select(key, at, out)


def roll_calendar(fut: DataFrame, key: str = "instrument") -> DataFrame:
    """One row per month: anchor (25th), last trading day three tradable days back, roll two more back."""
    days = tradable_days(fut, key)
    span = fut.groupBy(key).agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    live = days.groupBy(key).agg(F.min("d").alias("t0"), F.max("d").alias("t1"))
    months = (span.join(live, key)
              .select(key, "d0", "d1", "t0", "t1", F.explode(
                  F.expr("sequence(trunc(d0, 'MM'), trunc(d1, 'MM'), interval 1 month)")).alias("m"))
              .withColumn("anchor_25", F.date_add("m", ANCHOR_DAY - 1))
              .where((F.col("anchor_25") >= F.col("t0")) & (F.col("anchor_25") <= F.col("t1"))))
    at = as_of(months, days, [key], "anchor_25", "d", ["pos"])
    pick = lambda back, name: days.select(key, F.col("pos").alias(f"_{name}"), F.col("d").alias(name))
    at = at.withColumn("_ltd", F.greatest(F.col("pos") - LTD_BACK, F.lit(0)))
    at = at.withColumn("_roll_date", F.greatest(F.col("_ltd") - ROLL_BACK, F.lit(0)))
    out = at.join(pick(LTD_BACK, "ltd"), [key, "_ltd"]).join(pick(ROLL_BACK, "roll_date"), [key, "_roll_date"])
    out = out.join(span, key).where((F.col("roll_date") >= F.col("d0")) & (F.col("roll_date") <= F.col("d1")))
    return out.select(key, F.date_format("anchor_25", "yyyy-MM").alias("month"), "anchor_25", "ltd", "roll_date")


def series_no_roll(fut: DataFrame, key: str = "instrument", size: int = CONTRACT_BBL) -> DataFrame:
    w = Window.partitionBy(key).orderBy("d")
    return fut.select(key, "d", F.col("cl1").alias("f_mark"),
                      ((F.col("cl1") - F.lag("cl1").over(w)) * size).alias("pnl_1c"),
                      F.lit(0).alias("roll_flag"), F.lit("CL1").alias("held_leg"))


def series_roll(fut: DataFrame, rolls: DataFrame, key: str = "instrument", size: int = CONTRACT_BBL) -> DataFrame:
    """Roll-aware mark and daily P&L of one contract, in closed form.

    On a roll day the P&L still runs on the front month and the mark then moves to the next month.
    Days without a front month are passed over; the first row neither rolls nor earns.
    """
    w = Window.partitionBy(key).orderBy("d")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    flags = rolls.select(key, F.col("roll_date").alias("d"), F.lit(True).alias("_r")).distinct()
    d = fut.select(key, "d", "cl1", "cl2").join(flags, [key, "d"], "left").withColumn("_rn", F.row_number().over(w))
    there = F.col("cl1").isNotNull()
    rolling = there & (F.col("_rn") > 1) & F.col("_r").isNotNull()
    d = d.withColumn("roll_flag", F.when(rolling, 1).otherwise(0))
    d = d.withColumn("f_mark", F.when(F.col("roll_flag") == 1, F.coalesce("cl2", "cl1")).otherwise(F.col("cl1")))
    before = F.last("f_mark", ignorenulls=True).over(past)
    return d.select(
        key, "d", "f_mark",
        F.when(F.col("_rn") > 1, (F.col("cl1") - F.coalesce(before, F.col("cl1"))) * size).alias("pnl_1c"),
        "roll_flag",
        F.when((F.col("roll_flag") == 1) & F.col("cl2").isNotNull(), "CL2").otherwise("CL1").alias("held_leg"))


def futures_table(filled: DataFrame, front: str, second: str, instrument: str = "CL") -> DataFrame:
    """(instrument, d, cl1, cl2) from a long filled panel."""
    pair = filled.where(F.col("series_id").isin(front, second))
    return (pair.groupBy("d").agg(
        F.max(F.when(F.col("series_id") == front, F.col("value"))).alias("cl1"),
        F.max(F.when(F.col("series_id") == second, F.col("value"))).alias("cl2"))
        .select(F.lit(instrument).alias("instrument"), "d", "cl1", "cl2"))
