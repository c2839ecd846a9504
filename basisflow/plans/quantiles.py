"""Exact quantiles and tail means of many columns and groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one task. Here a mergeable sketch proposes, for each wanted rank, two cuts that hold it
by the sketch's own error bound; one more read of the rows counts them, value by value between the cuts and as single sums elsewhere, all on the map
side first. What is then ordered per group is the values between the cuts, about ``6 / ACCURACY`` of it. Where that is still more than ``MOST`` rows, the cuts
are moved together by exact counts over a grid of new ones, until it is not or one value is left. All value columns share these passes: they are stacked
on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.plans.keys import _join_keys
from basisflow.plans.lineage import written

ACCURACY = 10_000
MOST = 2_000_000
_GRID = 256


def _stacked(df: DataFrame, keys: list[str], values: Sequence[str]) -> DataFrame:
    """keys, _c (number of the value column) and _v, without NULL and NaN."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    if len(values) == 1:
        x = df.select(*keys, F.lit(0).alias("_c"), number(values[0]).alias("_v"))
    else:
        each = F.array(*[F.struct(F.lit(i).alias("_c"), number(c).alias("_v")) for i, c in enumerate(values)])
        x = df.select(*keys, F.explode(each).alias("_x")).select(*keys, "_x._c", "_x._v")
    return x.where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def _rank(p: Column, n: Column) -> Column:
    """Position p * (n - 1); one that float noise puts just off a whole number is that number."""
    r = p * (n - 1)
    near = F.rint(r)
    return F.when(F.abs(r - near) < 1e-9 * F.greatest(F.lit(1.0), near), near).otherwise(r)


def _first_cuts(x: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """(groups, _n, _pairs): an array of (lo, hi) per group, each holding the ranks of one probability; all values of a small group."""
    off = 2.0 / ACCURACY
    around = [min(1.0, max(0.0, p + s)) for p in probs for s in (-off, off)]
    cuts = x.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                  F.percentile_approx("_v", around, ACCURACY).alias("_cuts"))
    # of few rows the sketch knows every one, but a rank of the wanted one may still differ by one
    small = F.col("_n") <= ACCURACY
    ends = [F.struct(F.when(small | F.lit(p - off <= 0), F.col("_min")).otherwise(F.get("_cuts", F.lit(2 * i))).alias("lo"),
                     F.when(small | F.lit(p + off >= 1), F.col("_max")).otherwise(F.get("_cuts", F.lit(2 * i + 1))).alias("hi")) for i, p in enumerate(probs)]
    return cuts.select(*groups, "_n", F.array(*ends).alias("_pairs"))


def _narrowed(x: DataFrame, pairs: DataFrame, groups: list[str], probs: list[float], most: int) -> DataFrame:
    """Move the cuts of each (group, probability) together until at most ``most`` rows lie between them, or one value does."""
    one = pairs.select(*groups, "_n", F.posexplode("_pairs").alias("_i", "_pair")).select(*groups, "_n", "_i", "_pair.lo", "_pair.hi")
    state = written(one.withColumn("_in", F.col("_n")), "cuts")
    while state.where((F.col("_in") > most) & (F.col("lo") < F.col("hi"))).limit(1).count():
        rows = _join_keys(x, state, groups, "inner")
        inside = rows.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        grid = inside.groupBy(*groups, "_i").agg(F.percentile_approx("_v", [j / _GRID for j in range(1, _GRID)], ACCURACY).alias("_grid"))
        tagged = _join_keys(rows, grid, [*groups, "_i"], "inner")
        # cells: below, up to each grid value, the rest, above
        cell = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), _GRID + 1).otherwise(F.size(F.filter("_grid", lambda g: g < F.col("_v"))))
        counts = tagged.groupBy(*groups, "_i", "_n", cell.alias("_cell")).agg(F.count("*").alias("_m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        w = Window.partitionBy(*groups, "_i").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_to", F.sum("_m").over(w))
        p = F.element_at(F.array(*[F.lit(q) for q in probs]), F.col("_i") + 1)
        k = F.floor(_rank(p, F.col("_n")))
        k1 = F.least(k + 1, F.col("_n") - 1)
        hit = counts.where((F.col("_to") > k) & (F.col("_to") - F.col("_m") <= k1))
        moved = hit.groupBy(*groups, "_n", "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("_m").alias("_in"))
        before, state = state, written(moved, "cuts")
        same = _join_keys(state.withColumnRenamed("_in", "_now"), before.select(*groups, "_i", "_in"), [*groups, "_i"], "inner")
        if not same.where("_now < _in").limit(1).count():
            break
    pair = F.array_sort(F.collect_list(F.struct("_i", "lo", "hi")))
    return state.groupBy(*groups, "_n").agg(pair.alias("_pairs")).select(*groups, "_n", F.transform("_pairs", lambda q: F.struct(q["lo"], q["hi"])).alias("_pairs"))


def quantile_tables(df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Sequence[float], most: int = MOST) -> DataFrame:
    """One row per (group, column, p): ``column``, n, q and the means of the values <= q and >= q.

    q interpolates linearly between order statistics, as NumPy does by default. NULL and NaN values are left out.
    """
    keys, probs = list(keys), sorted(set(float(p) for p in probs))
    groups = [*keys, "_c"]
    x = _stacked(df, keys, values)
    pairs = written(_first_cuts(x, groups, probs), "cuts")
    if pairs.where(F.col("_n") * (6.0 / ACCURACY) > most).limit(1).count():
        pairs = written(_narrowed(x, pairs, groups, probs, most), "cuts")

    tagged = _join_keys(x, pairs, groups, "inner")
    v, many = F.col("_v"), F.col("_n") > ACCURACY
    at = lambda i: F.get("_pairs", F.lit(i))
    # a small group has one pair for all, so the first test settles it
    narrow = ~many
    passed = F.lit(0)
    for i in range(len(probs)):
        narrow = narrow | ((v >= at(i)["lo"]) & (v <= at(i)["hi"]))
        passed = passed + F.when(v > at(i)["hi"], 1).otherwise(0)
    counted = tagged.groupBy(*groups, F.when(narrow, v).alias("_x"), F.when(~narrow, passed).alias("_gap")).agg(
        F.count("*").alias("_m"), F.sum("_v").alias("_s"), F.min("_v").alias("_lo"))
    run = Window.partitionBy(*groups).orderBy("_lo")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    ordered = counted.select(*groups, "_m", "_lo", F.sum("_m").over(upto).alias("_cn"), F.sum("_s").over(upto).alias("_cs"),
                             F.sum("_m").over(whole).alias("_nt"), F.sum("_s").over(whole).alias("_st"))
    wanted = ordered.select("*", F.explode(F.array(*[F.lit(p) for p in probs])).alias("_p"))
    rank = _rank(F.col("_p"), F.col("_nt"))
    wanted = wanted.select("*", F.floor(rank).alias("_k"), (rank - F.floor(rank)).alias("_frac")).withColumn("_k1", F.least(F.col("_k") + 1, F.col("_nt") - 1))
    holds = lambda r: (F.col(r) < F.col("_cn")) & (F.col(r) >= F.col("_cn") - F.col("_m"))
    of = lambda r, c: F.max(F.when(holds(r), F.col(c)))
    picked = wanted.where(holds("_k") | holds("_k1")).groupBy(*groups, "_p").agg(
        F.max("_nt").alias("n"), F.max("_st").alias("_st"), F.max("_frac").alias("_frac"), of("_k", "_lo").alias("_vk"), of("_k1", "_lo").alias("_vk1"),
        of("_k", "_cn").alias("_cn"), of("_k", "_cs").alias("_csum"), of("_k", "_m").alias("_mk"))
    q = F.col("_vk") + (F.col("_vk1") - F.col("_vk")) * F.col("_frac")
    incl = F.when((F.col("_frac") == 0) | (F.col("_vk") == F.col("_vk1")), 1).otherwise(0)
    up_n = F.col("n") - F.col("_cn") + incl * F.col("_mk")
    up_s = F.col("_st") - F.col("_csum") + incl * F.col("_mk") * F.col("_vk")
    names = F.element_at(F.array(*[F.lit(c) for c in values]), F.col("_c") + 1)
    return picked.select(*keys, names.alias("column"), F.col("_p").alias("p"), "n", q.alias("q"), (F.col("_csum") / F.col("_cn")).alias("mean_below"),
                         F.try_divide(up_s, up_n).alias("mean_above"))


def quantile_table(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """``quantile_tables`` of one column: one row per (group, p)."""
    return quantile_tables(df, keys, [value], probs).drop("column")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    named: dict[str, float], tails: dict[str, tuple[float, str]] | None = None) -> DataFrame:
    """One row per group with a column per named quantile.

    ``tails`` maps a column to (p, 'below' | 'above'): the mean of the values on that side of q.
    """
    return exact_quantiles_of(df, keys, {value: (named, tails or {})})


def exact_quantiles_of(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[dict[str, float], dict[str, tuple[float, str]]]]) -> DataFrame:
    """``exact_quantiles`` of several value columns in the same passes: value column -> (named, tails)."""
    probs = [p for named, tails in wanted.values() for p in [*named.values(), *[p for p, _ in tails.values()]]]
    table = quantile_tables(df, keys, list(wanted), probs)
    out = []
    for value, (named, tails) in wanted.items():
        at = lambda p, c, value=value: F.max(F.when((F.col("column") == value) & (F.abs(F.col("p") - F.lit(float(p))) < 1e-12), F.col(c)))
        out += [at(p, "q").alias(c) for c, p in named.items()] + [at(p, f"mean_{side}").alias(c) for c, (p, side) in tails.items()]
    return table.groupBy(*keys).agg(*out)
