"""Interval joins, relational division and many-column quantiles: results against brute force, and the shape of their plans."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basisflow.operators import report, splits
from basisflow.plans import intervals, quantiles

D0 = dt.date(1969, 6, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_in_intervals_equal_the_loop(spark):
    r = random.Random(1)
    spans = [(k, r.randrange(0, 900), r.choice([0, 1, 2, 7, 64, 400])) for k in range(200)]
    rows = [(f"s{k}", "ab"[k % 2], day(a), day(a + n)) for k, a, n in spans] + [("none", "a", None, day(5)), ("back", "a", day(9), day(3)), ("nokey", None, day(0), day(900))]
    points = [(i, "ab"[i % 2], day(r.randrange(-5, 1000))) for i in range(300)] + [(900, "a", None), (901, None, day(5))] + [(902, "a", day(100))] * 3
    segs = spark.createDataFrame(rows, "name string, g string, lo date, hi date")
    pts = spark.createDataFrame(points, "id int, g string, at date")
    got = sorted((x.id, x.name) for x in intervals.points_in_intervals(pts, "at", segs, "lo", "hi", ("g",)).collect())
    assert got == sorted((i, n) for i, g, at in points for n, h, lo, hi in rows if at and lo and g is not None and g == h and lo <= at < hi)


@pytest.mark.parametrize("kind", ["long", "timestamp"])
def test_points_of_other_types(spark, kind):
    cast = (lambda c: F.col(c).cast("long")) if kind == "long" else (lambda c: F.timestamp_seconds(c))
    pts = spark.createDataFrame([(i,) for i in (-70, -64, -1, 0, 1, 63, 64, 1000, 10 ** 9)], "at long").select(cast("at").alias("at"), F.col("at").alias("v"))
    rows = [("p", -64, 64), ("q", 0, 1), ("r", -10 ** 6, 10 ** 10), ("s", 63, 1001)]
    segs = spark.createDataFrame(rows, "name string, lo long, hi long").select("name", cast("lo").alias("lo"), cast("hi").alias("hi"))
    got = sorted((x.v, x.name) for x in intervals.points_in_intervals(pts, "at", segs, "lo", "hi").collect())
    assert got == sorted((v, n) for v in (-70, -64, -1, 0, 1, 63, 64, 1000, 10 ** 9) for n, lo, hi in rows if lo <= v < hi)


def test_a_hundred_thousand_segments_need_no_nested_loop(spark):
    segs = spark.range(100_000).select(F.col("id").alias("window_id"), F.lit("train").alias("segment"), F.date_add(F.lit(D0), (F.col("id") % 9000).cast("int")).alias("seg_start"))
    segs = segs.withColumn("seg_end", F.date_add("seg_start", (F.col("window_id") % 40).cast("int")))
    days = spark.range(500).select(F.date_add(F.lit(D0), (F.col("id") * 17).cast("int")).alias("d"))
    got = splits.assign(days, segs, "d")
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    ids = np.arange(100_000)
    lo = ids % 9000
    hi = lo + ids % 40
    assert got.count() == sum(int(((lo <= at) & (at < hi)).sum()) for at in range(0, 8500, 17))


def test_common_scenarios_equal_set_intersection(spark):
    r = random.Random(3)
    rows = [(b, s, f"t{i}" if i else None, float(i)) for b in ("x", "y", None) for s in ("p", "q", "r") for i in range(12) if r.random() < 0.8]
    rows += [("one", "p", "t1", 0.0), ("apart", "p", "t1", 0.0), ("apart", "q", "t2", 0.0), ("noid", "p", None, 0.0), ("noid", "q", "t1", 1.0), ("noid", "q", "t1", 1.0)]
    df = spark.createDataFrame(rows, "b string, strategy string, scenario_id string, v double")
    out = report.common_scenarios(df, ["b"])
    want = []
    for b in {x[0] for x in rows}:
        part = [x for x in rows if x[0] == b]
        by = {s: {x[2] for x in part if x[1] == s and x[2]} for s in {x[1] for x in part}}
        sets = [v for v in by.values() if v]
        common = set.intersection(*sets) if sets and len(by) > 1 else set()
        want += [x for x in part if not common or x[2] in common]
    assert sorted(map(str, (tuple(x) for x in out.collect()))) == sorted(map(str, want))


def test_common_scenarios_plan(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("b"), (F.col("id") % 4).cast("string").alias("strategy"), F.col("id").cast("string").alias("scenario_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(report.common_scenarios(df, ["b"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    made = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    # of these, adaptive execution turns those for the few buckets into broadcasts
    assert len(made) <= 6 and "NestedLoop" not in plan, plan


def columns_of(rng, n):
    return {"a": np.round(rng.normal(size=n) * 100, 1), "b": rng.normal(size=n) ** 3, "c": np.where(rng.random(n) < 0.7, 4.0, rng.normal(size=n))}


@pytest.mark.parametrize("most", [40, 10 ** 9])
def test_quantiles_of_many_columns(spark, most):
    """Large and small groups, heavy ties, NULL keys and values; with a bound so low that cuts are moved several times."""
    rng = np.random.default_rng(5)
    parts = {"hot": columns_of(rng, 50_000), "edge": columns_of(rng, 10_001), "small": columns_of(rng, 9), "one": columns_of(rng, 1), None: columns_of(rng, 30)}
    parts["small"]["b"][:4] = np.nan
    pdf = pd.concat([pd.DataFrame({"g": g, **c}) for g, c in parts.items()])
    pdf["g"] = pdf["g"].astype(object).where(pdf["g"].notna(), None)
    df = spark.createDataFrame(pdf, "g string, a double, b double, c double").repartition(7)
    probs = [0.0, 0.01, 0.05, 0.5, 0.95, 1.0]
    got = {(r.g, r["column"], r.p): r for r in quantiles.quantile_tables(df, ["g"], ["a", "b", "c"], probs, most).collect()}
    assert len(got) == len(parts) * 3 * len(probs)
    for g, cols in parts.items():
        for c, x in cols.items():
            x = x[~np.isnan(x)]
            for p in probs:
                r, q = got[g, c, p], np.quantile(x, p)
                assert r.n == len(x)
                assert r.q == pytest.approx(q, rel=1e-12, abs=1e-12)
                assert r.mean_below == pytest.approx(x[x <= q * (1 + 1e-15 * np.sign(q))].mean(), rel=1e-9, abs=1e-9)
                assert r.mean_above == pytest.approx(x[x >= q * (1 - 1e-15 * np.sign(q))].mean(), rel=1e-9, abs=1e-9)


def test_quantiles_read_the_rows_twice_whatever_the_columns(spark, tmp_path):
    """Once for the cuts (a table of its own) and once for the counts."""
    path = str(tmp_path / "rows")
    spark.range(1000).select((F.col("id") % 5).alias("g"), *[(F.col("id") * k % 77).cast("double").alias(f"v{k}") for k in range(6)]).write.parquet(path)
    out = quantiles.quantile_tables(spark.read.parquet(path), ["g"], [f"v{k}" for k in range(6)], [0.05, 0.5])
    assert plan_of(out).count(str(tmp_path)) == 1
