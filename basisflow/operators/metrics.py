"""Risk metrics of P&L groups.

Groups can be of any size: moments combine on the map side and every quantile comes from
``plans.quantiles``, which never gathers a group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.plans.keys import _join_keys
from basisflow.plans.lineage import written
from basisflow.plans.ordered import sub_buckets
from basisflow.plans.quantiles import exact_quantiles, quantile_table

NO_HEDGE = ("nohedge", "no_hedge", "no-hedge", "no hedge")


def sample_skew(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def lpm(x: Column, tau: float = 0.0, order: int = 2) -> Column:
    """Lower partial moment: mean of max(tau - x, 0) ** order."""
    short = F.when(x.isNotNull(), F.greatest(F.lit(float(tau)) - x, F.lit(0.0)))
    return F.avg(short if order == 1 else F.pow(short, F.lit(order)))


def omega(x: Column, tau: float = 0.0, no_loss: float | None = None) -> Column:
    """Mean gain over mean loss around tau; ``no_loss`` is the value without any loss."""
    up = F.sum(F.greatest(x - tau, F.lit(0.0)))
    down = F.sum(F.greatest(F.lit(float(tau)) - x, F.lit(0.0)))
    return F.when(down > 0, up / down).when(F.count(x) > 0, F.lit(no_loss).cast("double"))


def effectiveness(var: Column, base: Column) -> Column:
    """1 - var / base; NULL unless base > 0."""
    return F.when(base > 0, 1 - var / base)


def tail_metrics(df: DataFrame, keys: list[str], value: str, convention: str = "signed", alpha: float = 0.95) -> DataFrame:
    """VaR and ES per group.

    signed: quantile and mean of the lower tail; positive: both with the sign turned; losses: upper
    tail of -x; order: the k-th smallest and the mean of the first k, k = floor((1 - alpha) * n).
    """
    p = round(1.0 - alpha, 10)
    if convention in ("signed", "positive"):
        t = exact_quantiles(df, keys, value, {"var": p}, {"es": (p, "below")})
        return t if convention == "signed" else t.withColumns({"var": -F.col("var"), "es": -F.col("es")})
    if convention == "losses":
        neg = df.withColumn("_loss", -F.col(value))
        return exact_quantiles(neg, keys, "_loss", {"var": alpha}, {"es": (alpha, "above")})
    if convention == "order":
        return _order_tail(df, keys, value, p)
    raise ValueError(convention)


def _order_tail(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The k-th smallest value and the mean of the k smallest, k = floor(p * n), one at least.

    The largest value v up to the exact p-quantile has k or fewer values below it and k or more up to it, so the values beyond the
    k-th in the sum up to v are all v itself. Everything is a sum per group; no group is ordered.
    """
    x = df.select(*keys, F.col(value).alias("_v"))
    n = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    q = _join_keys(exact_quantiles(df, keys, value, {"_q": p}), n, keys).withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * p)))
    upto = _join_keys(x, q, keys, "inner").where(F.col("_v") <= F.col("_q")).groupBy(*keys).agg(
        F.count("*").alias("_c"), F.sum("_v").alias("_s"), F.max("_v").alias("_top"), F.max("_k").alias("_k"))
    under = _join_keys(x, upto.select(*keys, "_top"), keys, "inner").where(F.col("_v") < F.col("_top")).groupBy(*keys).agg(
        F.count("*").alias("_less"), F.max("_v").alias("_next"))
    out = _join_keys(upto, under, keys)
    return out.select(*keys, F.when(F.col("_k") > F.coalesce("_less", F.lit(0)), F.col("_top")).otherwise(F.col("_next")).alias("var"),
                      ((F.col("_s") - (F.col("_c") - F.col("_k")) * F.col("_top")) / F.col("_k")).alias("es"))


MEANS = {"mean_spot": "spot_pnl_total", "mean_fut": "fut_pnl_total", "mean_cost_trade": "cost_trade_total",
         "mean_cost_roll": "cost_roll_total", "mean_total_cost": "total_cost", "mean_gross": "gross_pnl_total",
         "mdd_equity_mean": "mdd_equity", "turnover_contracts_mean": "turnover_contracts",
         "turnover_h_mean": "turnover_h", "trade_contracts_mean": "trade_contracts",
         "roll_contracts_mean": "roll_contracts", "max_abs_contracts_mean": "max_abs_contracts"}


def with_gross(df: DataFrame) -> DataFrame:
    return df.withColumns({"gross_pnl_total": F.col("spot_pnl_total") + F.col("fut_pnl_total"),
                           "total_cost": F.col("cost_trade_total") + F.col("cost_roll_total")})


def distinct_ids(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Distinct count in two steps, so that no key keeps its ids in one task."""
    return df.select(*keys, col).distinct().groupBy(*keys).agg(F.count(col).alias(out))


def group_metrics(df: DataFrame, keys: list[str], alpha: float = 0.95, tau: float = 0.0,
                  convention: str = "signed", no_loss: float | None = None) -> DataFrame:
    """The full metric row of each group."""
    d = with_gross(df)
    x = F.col("net_pnl_total")
    m = d.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.avg(x).alias("mean_net"), F.stddev_samp(x).alias("std_net"),
        F.min(x).alias("min_net"), F.max(x).alias("max_net"), F.var_samp(x).alias("var_net"),
        F.var_samp("gross_pnl_total").alias("var_gross"), F.var_samp("spot_pnl_total").alias("var_spot"),
        lpm(x, tau, 1).alias("lpm1"), lpm(x, tau, 2).alias("lpm2"), omega(x, tau, no_loss).alias("omega"),
        F.avg((x > 0).cast("double")).alias("prob_profit"), sample_skew(x).alias("skew"),
        sample_kurtosis(x).alias("kurtosis_excess"), F.min("mdd_equity").alias("mdd_equity_min"),
        *[F.avg(c).alias(a) for a, c in MEANS.items()])
    p = round(1.0 - alpha, 10)
    q = exact_quantiles(d, keys, "net_pnl_total",
                        {"var95": p, "median_net": 0.5, "_q05": 0.05, "_q95": 0.95}, {"es95": (p, "below")})
    out = _join_keys(m, q, keys)
    out = _join_keys(out, distinct_ids(d, keys, "scenario_id", "n_scenarios"), keys)
    dd = F.sqrt("lpm2")
    sign = -1 if convention == "positive" else 1
    return out.withColumns({
        "cv": F.when(F.abs("mean_net") > 1e-12, F.col("std_net") / F.abs("mean_net")),
        "downside_dev": dd, "root_lpm2": dd,
        "var95": F.col("var95") * sign, "es95": F.col("es95") * sign,
        "tail_ratio": F.when(F.col("_q05") != 0, F.abs("_q95") / F.abs("_q05")),
        "sortino_tau0": F.when(dd > 0, (F.col("mean_net") - tau) / dd)}).drop("_q05", "_q95")


def add_effectiveness(m: DataFrame, bench_keys: list[str], fallback_keys: list[str] | None = None) -> DataFrame:
    """Variance of the unhedged strategy in the same bucket, its fallback average, and effectiveness.

    The metric rows, one per group, are written first: a second evaluation may add up a variance in another order, and the unhedged
    strategy would then differ from itself in the last digit.
    """
    m = written(m, "metrics")
    parts = ("net", "gross", "spot")
    no = m.where(F.lower("strategy").isin(*NO_HEDGE))
    base = no.groupBy(*bench_keys).agg(*[F.avg(f"var_{p}").alias(f"var_unhedged_{p}") for p in parts])
    out = _join_keys(m, base, bench_keys)
    if fallback_keys:
        fb = no.groupBy(*fallback_keys).agg(*[F.avg(f"var_{p}").alias(f"_fb_{p}") for p in parts])
        out = _join_keys(out, fb, fallback_keys)
        out = out.withColumns({f"var_unhedged_{p}": F.coalesce(f"var_unhedged_{p}", f"_fb_{p}") for p in parts})
        out = out.drop(*[f"_fb_{p}" for p in parts])
    return out.withColumns({f"he_{p}_vs_nohedge": effectiveness(F.col(f"var_{p}"), F.col(f"var_unhedged_{p}"))
                            for p in parts})


def quick_score(m: DataFrame, bucket: list[str]) -> DataFrame:
    """Weighted z-scores inside a bucket. The drawdown mean is negative and is negated once more, as
    the original score does. Rows here are strategy variants, few per bucket."""
    w = Window.partitionBy(*bucket)

    def z(c: str) -> Column:
        sd = F.stddev_samp(c).over(w)
        return F.when(sd > 0, (F.col(c) - F.avg(c).over(w)) / sd)
    if "mdd_equity_mean" not in m.columns:
        return m.withColumn("score_quick", 0.45 * z("he_net_vs_nohedge") - 0.30 * z("es95") + 0.25 * z("mean_net"))
    return m.withColumn("score_quick", 0.35 * z("he_net_vs_nohedge") - 0.25 * z("es95")
                        - 0.25 * z("mdd_equity_mean") + 0.15 * z("mean_net"))


def metric_ranks(m: DataFrame, bucket: list[str]) -> DataFrame:
    """Dense ranks, best first; NULL metrics stay unranked.

    Values that agree to twelve digits share a rank: further digits depend on the order in which a sum was taken.
    """
    def rank(c: str) -> Column:
        w = Window.partitionBy(*bucket, F.col(c).isNull()).orderBy(F.format_string("%.11e", F.col(c)).try_cast("double").desc())
        return F.when(F.col(c).isNotNull(), F.dense_rank().over(w))
    return m.withColumns({"rank_by_he": rank("he_net_vs_nohedge"), "rank_by_es": rank("es95"),
                          "rank_by_mdd": rank("mdd_equity_mean")})


def average_rank(c: str, keys: list[str], descending: bool = False) -> Column:
    """Rank with ties sharing their mean rank; NULL unranked."""
    order = F.desc(c) if descending else F.asc(c)
    w = Window.partitionBy(*keys, F.col(c).isNull()).orderBy(order)
    ties = F.count("*").over(Window.partitionBy(*keys, c))
    return F.when(F.col(c).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def tail_curve(df: DataFrame, keys: list[str], value: str, alphas: list[float], min_rows: int = 5) -> DataFrame:
    """VaR and ES at each confidence level for groups of at least ``min_rows``."""
    probs = sorted({round(1.0 - a, 10) for a in alphas})
    t = quantile_table(df, keys, value, probs).where(F.col("n") >= min_rows)
    return t.select(*keys, F.round(1 - F.col("p"), 10).alias("alpha"), "n", F.col("q").alias("var"),
                    F.col("mean_below").alias("es"))


def normal_aic(x: Column) -> Column:
    """AIC of a normal fit with the ddof-1 sigma; NULL below 30 values."""
    n = F.count(x)
    s2 = F.greatest(F.var_samp(x), F.lit(1e-24))
    ll = -n / 2 * F.log(2 * F.pi() * s2) - (n - 1) * F.var_samp(x) / (2 * s2)
    return F.when(n >= 30, 4 - 2 * ll)


def pooled(m: DataFrame, keys: list[str], cols: list[str], labels: list[str]) -> DataFrame:
    """One row per key: n-weighted means, pooled deviation, and the single label or 'ALL'."""
    n = F.greatest(F.coalesce(F.col("n_scenarios").cast("double"), F.lit(1.0)), F.lit(1.0))
    d = m.withColumn("_w", n)
    both = F.col("mean_net").isNotNull() & F.col("std_net").isNotNull()
    wb = F.when(both, F.col("_w"))
    mean_b = F.sum(wb * F.col("mean_net")) / F.sum(wb)
    within = F.sum(F.when(both, (F.col("_w") - 1) * F.col("std_net") ** 2))
    square = F.sum(wb * F.col("mean_net") ** 2) - F.sum(wb) * mean_b ** 2
    return d.groupBy(*keys).agg(
        F.sum("_w").cast("long").alias("n_scenarios"),
        *[(F.try_divide(F.sum(F.col("_w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("_w"))))).alias(c)
          for c in cols if c not in ("std_net",)],
        F.sqrt((within + square) / F.greatest(F.sum(wb) - 1, F.lit(1.0))).alias("std_net"),
        *[F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit("ALL")).alias(c) for c in labels])


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, lo: float | None = None,
              hi: float | None = None, range_keys: list[str] | None = None) -> DataFrame:
    """Density per bin between two quantiles (or min and max) of the bucket given by ``range_keys``.

    Where the two quantiles are one value, the range is the bucket's min to max, and +-1 around it if that is one value, too.
    """
    rk = range_keys if range_keys is not None else keys
    rng = df.groupBy(*rk).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    if lo is not None:
        rng = _join_keys(rng, exact_quantiles(df, rk, value, {"lo": lo, "hi": hi}), rk)
        tied = F.col("lo") == F.col("hi")
        rng = rng.withColumns({"lo": F.when(tied, F.col("_min")).otherwise(F.col("lo")), "hi": F.when(tied, F.col("_max")).otherwise(F.col("hi"))})
    else:
        rng = rng.withColumnsRenamed({"_min": "lo", "_max": "hi"})
    same = F.col("lo") == F.col("hi")
    rng = rng.select(*rk, F.when(same, F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"),
                     F.when(same, F.col("hi") + 1).otherwise(F.col("hi")).alias("hi"))
    j = _join_keys(df.select(*keys, F.col(value).alias("_v")), rng, rk, "inner")
    inside = j.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col("_v") - F.col("lo")) / width), F.lit(bins - 1))
    c = inside.groupBy(*keys, "lo", "hi", b.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return c.withColumn("density", F.col("n") / (total * width))


def ecdf(df: DataFrame, keys: list[str], value: str, cuts: int = 256) -> DataFrame:
    """Distinct values with their rank (rows up to the value) and share of the group.

    Cut points split a group into buckets; counts of whole buckets carry over, so only a bucket is ordered in one task.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("_m"))
    at = c.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("value", [i / cuts for i in range(1, cuts)], 10_000)).alias("_cuts"), F.sum("_m").alias("_n"))
    d = _join_keys(c, at, keys)
    d = d.withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("value")))).drop("_cuts")
    per = d.groupBy(*keys, "_b").agg(F.sum("_m").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    d = _join_keys(d.withColumn("_in", F.sum("_m").over(inside)), carry, [*keys, "_b"])
    rank = F.col("_carry") + F.col("_in")
    return d.select(*keys, "value", rank.alias("rank"), (rank / F.col("_n")).alias("share"))


def running_lpm(df: DataFrame, keys: list[str], at: str, tie: str, value: str, tau: float = 0.0, order: int = 2) -> DataFrame:
    """Cumulative downside over trades ordered by date, and its root.

    Totals per (key, date, piece of the date) carry over; only the rows of one piece are summed in their own order.
    """
    d = df.select(*keys, at, tie, F.pow(F.greatest(tau - F.col(value), F.lit(0.0)), F.lit(order)).alias("_d"))
    d = sub_buckets(d, [*keys, at], tie)
    per = d.groupBy(*keys, at, "_b").agg(F.sum("_d").alias("_t"))
    before = Window.partitionBy(*keys).orderBy(at, "_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.withColumn("_carry", F.coalesce(F.sum("_t").over(before), F.lit(0.0))).drop("_t")
    inside = Window.partitionBy(*keys, at, "_b").orderBy(tie).rowsBetween(Window.unboundedPreceding, 0)
    out = _join_keys(d.withColumn("_in", F.sum("_d").over(inside)), carry, [*keys, at, "_b"])
    cum = F.col("_carry") + F.col("_in")
    return out.select(*keys, at, tie, cum.alias("cum_lpm"), F.pow(cum, F.lit(1.0 / order)).alias("cum_root_lpm"))
