"""Train, validation and test windows and the assignment of rows to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.plans.intervals import points_in_intervals


def _span(df: DataFrame, at: str) -> DataFrame:
    return df.agg(F.min(at).alias("d0"), F.max(at).alias("d1"))


def walk_forward_years(df: DataFrame, at: str, train: int, val: int, test: int, step: int) -> DataFrame:
    """Half-open windows [t0, t1) train, [t1, t2) validation, [t2, t3) test, moved by ``step`` years."""
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.year("d1") - F.year("d0")), F.lit(step)))
    w = _span(df, at).select("d1", "d0", k.alias("k"))
    cut = lambda years: F.add_months("d0", (F.col("k") + years) * 12)
    w = w.select("d1", (F.col("k") / step + 1).cast("int").alias("window_id"), cut(0).alias("train_start"),
                 cut(train).alias("val_start"), cut(train + val).alias("test_start"), cut(train + val + test).alias("test_end"))
    return w.where(F.col("test_end") <= F.col("d1")).drop("d1")


def calendar_year_windows(df: DataFrame, at: str, mode: str, initial: int, longest: int, step: int = 1) -> DataFrame:
    """Whole-year windows with one validation and one test year; the train part rolls, expands, or
    expands up to ``longest`` years."""
    w = _span(df, at).select(F.year("d0").alias("y0"), F.year("d1").alias("y1"))
    w = w.where(F.col("y0") + initial + 1 <= F.col("y1")).select(
        "y0", F.explode(F.sequence(F.col("y0") + initial - 1, F.col("y1") - 2, F.lit(max(step, 1)))).alias("train_y1"))
    start = {"rolling": F.col("train_y1") - initial + 1, "expanding": F.col("y0"),
             "hybrid_expanding": F.greatest(F.col("y0"), F.col("train_y1") - longest + 1)}[mode]
    w = w.select(start.alias("train_y0"), "train_y1", (F.col("train_y1") + 1).alias("val_y"), (F.col("train_y1") + 2).alias("test_y"))
    return w.withColumn("window_name", F.format_string("WF_train%d-%d_val%d_test%d", "train_y0", "train_y1", "val_y", "test_y"))


def rolling_day_windows(df: DataFrame, at: str, train: int, val: int, test: int, step: int) -> DataFrame:
    """Windows of so many days, moved by ``step`` days, as long as the test part fits."""
    w = _span(df, at).where(F.date_add("d0", train + val + test) <= F.col("d1") + F.expr("interval 1 day"))
    k = F.explode(F.sequence(F.lit(0), F.datediff("d1", "d0") + 1 - (train + val + test), F.lit(step)))
    at_ = lambda n: F.date_add("d0", F.col("k") + n)
    return w.select("d0", k.alias("k")).select(
        (F.col("k") / step + 1).cast("int").alias("window_id"), at_(0).alias("train_start"), at_(train).alias("val_start"),
        at_(train + val).alias("test_start"), at_(train + val + test).alias("test_end"))


def expanding_index_windows(n: DataFrame, count: str, first: float, val: float, test: float, step: float) -> DataFrame:
    """Index windows by fractions of the row count: train from 0 and growing, then validation, then test."""
    k = F.explode(F.sequence(F.lit(0), F.lit(int((1.0 - first - val - test) / step + 1e-9))))
    cut = lambda f: F.floor(F.col(count) * (f + F.col("k") * step) + 1e-9).cast("long")
    return n.select("*", k.alias("k")).select(*n.columns, (F.col("k") + 1).alias("window_id"), F.lit(0).cast("long").alias("train_start"),
                                                cut(first).alias("val_start"), cut(first + val).alias("test_start"),
                                                cut(first + val + test).alias("test_end"))


def segments(windows: DataFrame) -> DataFrame:
    """One row per (window, segment) with a half-open interval."""
    s = lambda name, a, b: F.struct(F.lit(name).alias("segment"), F.col(a).alias("seg_start"), F.col(b).alias("seg_end"))
    return windows.select("window_id", F.explode(F.array(
        s("train", "train_start", "val_start"), s("val", "val_start", "test_start"), s("test", "test_start", "test_end"))).alias("s")
    ).select("window_id", "s.*")


def assign(df: DataFrame, segs: DataFrame, at: str) -> DataFrame:
    """Rows in each half-open segment they fall into, however many segments there are."""
    return points_in_intervals(df, at, segs, "seg_start", "seg_end").select(*df.columns, "window_id", "segment", "seg_start", "seg_end")


def snap_to_days(windows: DataFrame, days: DataFrame, at: str) -> DataFrame:
    """First and last available day of each year range (y0, y1), from one row per year."""
    per_year = days.groupBy(F.year(at).alias("y")).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    e = windows.withColumn("y", F.explode(F.sequence("y0", "y1"))).join(per_year, "y")
    return e.groupBy(*windows.columns).agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"))


def percentile_split(idx: Column, n: Column, a: float = 0.70, b: float = 0.85) -> Column:
    """train / val / test by position: first 70 %, up to 85 %, rest."""
    return (F.when(idx < F.floor(n * a + 1e-9), "train").when(idx < F.floor(n * b + 1e-9), "val").otherwise("test"))


def date_split(d: Column, val_start: str, test_start: str) -> Column:
    return (F.when(d < F.lit(val_start).cast("date"), "train").when(d < F.lit(test_start).cast("date"), "val").otherwise("test"))


def window_audit(assigned: DataFrame, segs: DataFrame) -> DataFrame:
    """Rows per window and segment; a window with an empty segment is not accepted."""
    n = assigned.groupBy("window_id", "segment").agg(F.count("*").alias("n"))
    full = segs.select("window_id", "segment").join(n, ["window_id", "segment"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.groupBy("window_id").agg(
        *[F.max(F.when(F.col("segment") == s, F.col("n"))).alias(f"n_{s}") for s in ("train", "val", "test")],
        F.when(F.min("n") > 0, "accepted").otherwise("empty").alias("status"))


def fixed_length(cal: DataFrame, length: int, stride: int, start: int = 0, key: str = "exposure_id") -> DataFrame:
    """Index scenarios [start_idx, end_idx) of fixed length every ``stride`` rows with enough tradable days."""
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(0, length - 1)
    last = F.max("idx").over(Window.partitionBy(key))
    d = cal.withColumns({"tradable_days": F.sum("tradable").over(w), "_last": last, "end_d": F.last("d").over(w)})
    i = F.col("idx") - 1
    return d.where((i >= start) & (F.pmod(i - start, F.lit(stride)) == 0) & (i + length <= F.col("_last"))
                   & (F.col("tradable_days") >= max(2, length // 2))).select(
        key, i.alias("start_idx"), (i + length).alias("end_idx"), F.col("d").alias("start_date"), F.col("end_d").alias("end_date"),
        "tradable_days")
