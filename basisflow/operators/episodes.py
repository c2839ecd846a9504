"""Analytics of step logs: one row per trade (episode), day and policy.

An episode lasts as long as a trade, so its window is short; nothing here sorts more than one
episode at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.operators import pnl
from basisflow.operators.hedge import Strategy
from basisflow.plans.keys import _join_keys
from basisflow.plans.ordered import sub_buckets
from basisflow.plans.quantiles import exact_quantiles, exact_quantiles_of

EP = ["scenario_id", "strategy"]
LEAST_NOTIONAL = 1.0


def _w(keys=EP, order="pos"):
    return Window.partitionBy(*keys).orderBy(order)


def _upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def day_counters(log: DataFrame) -> DataFrame:
    """Day number in the episode and the elapsed and remaining share."""
    w = _w()
    n = F.count("*").over(Window.partitionBy(*EP))
    k = F.row_number().over(w) - 1
    d = F.greatest(n - 1, F.lit(1))
    return log.withColumns({"day_in_episode": k, "elapsed_frac": k / d, "remaining_frac": 1 - k / d})


def risk_attribution(log: DataFrame, target: float = 0.0, order: int = 2, weights=(0.50, 0.35, 0.15), scale: float = 1.0,
                     limit: float | None = None) -> DataFrame:
    """Path-dependent risk components from pnl, notional, notional0 and decision_cost.

    Downside is taken on the cumulative return, so recovering lowers it; its level and its change mix
    70 / 30; squared returns and costs accumulate.
    """
    w = _w()
    run = _upto(w)
    d = log.withColumns({
        "portfolio_return": F.col("pnl") / F.greatest("notional", F.lit(LEAST_NOTIONAL)),
        "cum_return": F.sum("pnl").over(run) / F.greatest("notional0", F.lit(LEAST_NOTIONAL)),
        "cum_cost": F.sum("decision_cost").over(run) / F.greatest("notional0", F.lit(LEAST_NOTIONAL))})
    short = F.greatest(F.lit(float(target)) - F.col("cum_return"), F.lit(0.0))
    d = d.withColumn("episode_lpm", short if order <= 1 else F.pow(short, F.lit(order)))
    d = d.withColumns({"delta_lpm": F.col("episode_lpm") - F.coalesce(F.lag("episode_lpm").over(w), F.lit(0.0)),
                       "running_vol": F.sum(F.col("portfolio_return") ** 2).over(run)})
    total = sum(weights)
    wl, wv, wc = [x / total for x in weights]
    mixed = 0.70 * F.col("episode_lpm") + 0.30 * F.col("delta_lpm")
    d = d.withColumns({"part_lpm": wl * mixed, "part_vol": wv * F.col("running_vol"), "part_cost": wc * F.col("cum_cost")})
    score = -(F.col("part_lpm") + F.col("part_vol") + F.col("part_cost")) * scale
    if limit is not None:
        score = F.greatest(F.lit(-limit), F.least(F.lit(limit), score))
    return d.withColumn("score", score)


def rolling_risk(log: DataFrame, r: str, window: int = 20, target: float = 0.0, order: int = 2) -> DataFrame:
    """Variance of the last ``window`` step returns (0 below two) and the downside of each step."""
    w = _w().rowsBetween(-(max(window, 2) - 1), 0)
    short = F.greatest(target - F.col(r), F.lit(0.0))
    return log.withColumns({
        "roll_var": F.when(F.count(r).over(w) >= 2, F.var_samp(r).over(w)).otherwise(0.0),
        "step_lpm": short if order <= 1 else F.pow(short, F.lit(order))})


def zscore(x: str, keys=EP, rows: int = 253) -> Column:
    """Distance from the mean of the last ``rows`` days of the episode in their deviations."""
    z = _w(keys).rowsBetween(-(rows - 1), 0)
    return (F.col(x) - F.avg(x).over(z)) / F.greatest(F.stddev_pop(x).over(z), F.lit(1e-12))


def zscore_peaks(trades: DataFrame, days: DataFrame, x: str, rows: int = 253) -> DataFrame:
    """Largest z-score of a trade so far, for each start (exposure_id, pos0) that trades have: an array by days since the start.

    Trades that start together share their days, so the rows are bounded by the calendar and the longest trade, not by the number of trades.
    """
    starts = trades.groupBy("exposure_id", "pos0").agg(F.max("pos1").alias("pos1"))
    each = starts.withColumn("pos", F.explode(F.sequence("pos0", "pos1"))).join(days.select("exposure_id", "pos", x), ["exposure_id", "pos"])
    key = ["exposure_id", "pos0"]
    each = each.withColumn("_z", zscore(x, key, rows)).withColumn("_top", F.max("_z").over(_upto(_w(key))))
    z = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_top"))), lambda r: r["_top"])
    return each.groupBy(*key).agg(z.alias("z_peaks"))


def signals_of(rows: DataFrame, columns: dict[str, str], n: int, keys: list[str]) -> DataFrame:
    """``path_signals`` of several P&L columns side by side, as ``<name>__all_negative``, ``<name>__recent_sum`` and ``<name>__convex_rise``.

    The last n values are looked up once, in the order of the trade; no frame is gone through again for each row.
    """
    w = _w(keys)
    rows = rows.withColumns({f"{name}__lag{i}": F.lag(p, i).over(w) for name, p in columns.items() for i in range(1, n)})
    out = {}
    for name, p in columns.items():
        last = [F.col(p), *[F.col(f"{name}__lag{i}") for i in range(1, n)]]
        some = lambda cs: reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
        total = lambda cs: F.when(some(cs) > 0, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in reversed(cs)]))
        of = lambda f, cs: f(*cs) if len(cs) > 1 else cs[0]
        enough, gains = some(last) >= n, last[:n - 1]
        out |= {f"{name}__all_negative": (enough & (of(F.greatest, last) < 0)).cast("int"), f"{name}__recent_sum": total(last),
                f"{name}__convex_rise": F.coalesce(enough & (of(F.least, gains) > 0) & (F.col(p) >= total(gains) / some(gains)), F.lit(False)).cast("int")}
    return rows.withColumns(out).drop(*[f"{name}__lag{i}" for name in columns for i in range(1, n)])


def path_signals(log: DataFrame, pnl: str, n: int, z_of: str | None, z_rows: int = 253) -> DataFrame:
    """Last n losses in a row, recent sum, convex rise of the cumulative P&L (its last n - 1 steps are
    gains and the latest is at least their mean), and a z-score, unless the log has it already."""
    w = _w()
    f = w.rowsBetween(-(n - 1), 0)
    enough = F.count(pnl).over(f) >= n
    g = w.rowsBetween(-(n - 2), 0)
    signals = {"zscore": zscore(z_of, rows=z_rows)} if z_of else {}
    return log.withColumns({
        **signals, "all_negative": (enough & (F.max(pnl).over(f) < 0)).cast("int"), "recent_sum": F.sum(pnl).over(f),
        "convex_rise": F.coalesce((enough & (F.min(pnl).over(g) > 0) & (F.col(pnl) >= F.avg(pnl).over(g))), F.lit(False)).cast("int")})


def _own_totals(c) -> dict[str, Column]:
    """What an episode summary adds up per strategy; ``c`` gives the column of a name."""
    h, dh, dn = c("h_t"), F.abs(c("h_t") - c("h_prev")), F.abs(c("n_t") - c("n_prev"))
    return {
        "total_pnl": F.sum(c("net_pnl")), "futures_pnl": F.sum(c("fut_pnl")), "decision_cost": F.sum(c("cost_trade")), "roll_cost": F.sum(c("cost_roll")),
        "mean_h": F.avg(h), "max_h": F.max(h), "min_h": F.min(h), "h_std": F.stddev_pop(h), "h_abs_mean": F.avg(F.abs(h)),
        "h_nonzero_share": F.avg((h != 0).cast("double")), "turnover_h": F.sum(dh), "turnover_contracts": F.sum(dn).cast("double"),
        "final_equity": F.max_by(c("equity"), F.col("pos")), "mdd": F.min(c("equity") - c("peak")),
        "win_vs_naive": F.avg((c("net_pnl") > F.col("spot_pnl") + _naive_fut()).cast("double"))}


def _naive_fut() -> Column:
    return -F.rint(F.col("volume_bbl") / 1000) * F.col("pnl_1c")


def _shared_totals() -> dict[str, Column]:
    """What is the same for all strategies."""
    return {"steps": F.count("*"), "physical_pnl": F.sum("spot_pnl"), "roll_days": F.sum("roll_flag"), "no_hedge_pnl": F.sum("spot_pnl"),
            "naive_fut_pnl": F.sum(_naive_fut()), "naive_pnl": F.sum(F.col("spot_pnl") + _naive_fut())}


def episode_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row per episode with its unhedged and naive benchmarks, in a single aggregate.

    Episodes sum on the map side; the last equity is taken by position, so no order is assumed.
    """
    return log.groupBy(*keys).agg(*[v.alias(k) for k, v in (_shared_totals() | _own_totals(F.col)).items()])


def episode_summaries(rows: DataFrame, keys: list[str], strategies: list[Strategy]) -> DataFrame:
    """``episode_summary`` of side-by-side trade days: summed per trade first, so that trades and not days are stacked.

    ``keys`` are columns of a trade; a row has them and ``strategy``.
    """
    rows = pnl.equity(rows, strategies)
    own = [v.alias(f"{s.name}__{k}") for s in strategies for k, v in _own_totals(pnl.side(s)).items()]
    flat = rows.groupBy(*keys).agg(*[v.alias(k) for k, v in _shared_totals().items()], *own)
    return pnl.stack(flat, [*keys, *_shared_totals()], strategies, {k: k for k in _own_totals(F.col)})


def action_statistics(log: DataFrame, keys: list[str], action: str) -> DataFrame:
    """Per episode: how often each action was taken, as a JSON map in the order of the actions, how many different ones, and the share of the most frequent.

    Steps are counted per action on the map side; what comes together for an episode is one number per action.
    """
    counts = log.where(F.col(action).isNotNull()).groupBy(*keys, F.col(action).alias("_a")).agg(F.count("*").alias("_n"))
    per = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_a", "_n"))).alias("_c"), F.sum("_n").alias("_t"), F.max("_n").alias("_top"))
    pairs = F.transform("_c", lambda c: F.concat(F.lit('"'), c["_a"].cast("string"), F.lit('": '), c["_n"].cast("string")))
    text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return per.select(*keys, text.alias("action_counts"), F.size("_c").alias("n_actions"), (F.col("_top") / F.col("_t")).alias("top_share"))


def policy_evaluation(days: DataFrame, keys: list[str], target: float = 0.0) -> DataFrame:
    """Fast evaluation with contract-correct futures P&L: daily return mean, variance, VaR and ES of losses.

    ``days`` has one row per episode day after the first with pnl, cost, dn and notional. An episode is
    short, so its sorted returns fit the row that evaluates them.
    """
    r = F.col("pnl") / F.greatest(F.col("notional"), F.lit(1e-9))
    w = _upto(_w(keys))
    d = days.withColumns({"r": r, "eq": F.sum("pnl").over(w)})
    d = d.withColumn("dd", F.greatest(F.max("eq").over(w), F.lit(0.0)) - F.col("eq"))
    g = d.groupBy(*keys).agg(
        F.sum("pnl").alias("pnl_net_sum"), F.sum("cost").alias("cost_sum"), F.sum("dn").alias("turnover_contract"), F.max("dd").alias("mdd"),
        F.avg("r").alias("mean_daily_return"), F.var_samp("r").alias("var_daily"),
        F.sqrt(F.avg(F.pow(F.least(F.col("r") - target, F.lit(0.0)), F.lit(2)))).alias("dd_daily"), F.percentile(-F.col("r"), 0.95).alias("var95_loss"),
        F.collect_list(-F.col("r")).alias("_l"))
    tail = F.filter("_l", lambda x: x >= F.col("var95_loss"))
    return g.withColumn("es95_loss", F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)).drop("_l")


def versus_naive(eps: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, ES95 and effectiveness of each run against naive, with flags and their count."""
    es = exact_quantiles_of(eps, keys, {"total_pnl": ({}, {"es95": (0.05, "below")}), "naive_pnl": ({}, {"naive_es95": (0.05, "below")})})
    m = eps.groupBy(*keys).agg(
        F.count("*").alias("n_scenarios"), F.avg("total_pnl").alias("mean_pnl"), F.avg("naive_pnl").alias("naive_mean_pnl"),
        F.var_samp("total_pnl").alias("_v"), F.var_samp("naive_pnl").alias("_vn"), F.var_samp("no_hedge_pnl").alias("_v0"),
        F.avg("mean_h").alias("mean_h"), F.avg("turnover_h").alias("turnover_h"))
    m = _join_keys(m, es, keys)
    he = lambda v: F.when(F.col("_v0") > 0, 1 - F.col(v) / F.col("_v0"))
    m = m.withColumns({"he": he("_v"), "naive_he": he("_vn")}).drop("_v", "_vn", "_v0")
    pairs = {"mean_pnl": ("mean_pnl", "naive_mean_pnl"), "es95": ("es95", "naive_es95"), "he": ("he", "naive_he")}
    m = m.withColumns({f"diff_{k}": F.col(a) - F.col(b) for k, (a, b) in pairs.items()})
    m = m.withColumns({f"flag_{k}": F.coalesce((F.col(f"diff_{k}") > 0), F.lit(False)).cast("int") for k in pairs})
    return m.withColumn("flags_total", sum((F.col(f"flag_{k}") for k in pairs), F.lit(0)))


def action_entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Entropy of action counts, also divided by its maximum, and the number of actions."""
    total = counts.groupBy(*keys).agg(F.sum(n).alias("_t"), F.count("*").alias("unique_actions"))
    j = _join_keys(counts, total, keys)
    p = F.coalesce(F.try_divide(F.col(n), F.col("_t")), F.lit(0.0))  # no action at all: entropy 0
    e = j.groupBy(*keys, "unique_actions").agg((-F.sum(p * F.log(p + 1e-12))).alias("entropy"))
    return e.withColumn("entropy_norm", F.when(F.col("unique_actions") > 1, F.col("entropy") / F.log(F.col("unique_actions").cast("double"))).otherwise(0.0))


def merged_counts(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Sum JSON maps of counts per key; unreadable texts are skipped."""
    m = df.select(*keys, F.explode(F.from_json(col, "map<string,long>")).alias("action", "n"))
    return m.groupBy(*keys, "action").agg(F.sum("n").alias("n"))


def trial_scores(t: DataFrame) -> DataFrame:
    """Reject reasons and penalised score of trials from their mean columns."""
    c = F.col
    ratio = c("mean_cost") / (F.abs(c("mean_pnl")) + 1.0)
    why = F.concat_ws(";", F.when(c("unique_actions") < 2, "unique_actions<2"), F.when(c("mean_h_std") < 0.02, "mean_h_std<0.02"),
                      F.when(c("mean_turnover_h") < 0.05, "mean_turnover_h<0.05"), F.when(c("mean_turnover_h") > 3.0, "mean_turnover_h>3.0"),
                      F.when(ratio > 0.20, "cost_ratio>20pct"))
    d = t.withColumns({"mean_cost_ratio": ratio, "reject_reasons": why}).withColumn("reject", (F.col("reject_reasons") != "").cast("int"))
    score = (c("mean_pnl") - 0.65 * F.abs(c("mean_mdd")) - 0.35 * c("mean_cost") + 350_000.0 * c("entropy_norm")
             + 1_250_000.0 * F.least(c("mean_h_std"), F.lit(0.25)) - 150_000.0 * F.greatest(c("mean_turnover_h") - 1.25, F.lit(0.0)))
    return d.withColumn("score", score - 10_000_000.0 * c("reject"))


def best_trial(trials: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Best accepted trial, else the best one; ties by name."""
    return trials.groupBy(*keys).agg(F.max_by(F.struct(name, "score", "reject"), F.struct(1 - F.col("reject"), "score", name)).alias("b")).select(*keys, "b.*")


def validation_score(eps: DataFrame, keys: list[str]) -> DataFrame:
    """Outside score: mean P&L less drawdown, tail loss and boundary share, in millions."""
    q = exact_quantiles(eps, keys, "total_pnl", {"_q": 0.05}, {"cvar": (0.05, "below")}).drop("_q")
    top = eps.groupBy(*keys).agg(F.max("h_abs_mean").alias("_mx"), F.avg("total_pnl").alias("pnl_mean"), F.avg(F.abs("mdd")).alias("mdd_abs"))
    j = _join_keys(eps, top, keys)
    b = j.groupBy(*keys).agg(F.first("pnl_mean").alias("pnl_mean"), F.first("mdd_abs").alias("mdd_abs"), F.coalesce(
        F.avg(F.when(F.col("_mx") > 0, (F.col("h_abs_mean") > 0.95 * F.col("_mx")).cast("double"))), F.lit(0.0)).alias("boundary"))
    m = _join_keys(b, q, keys)
    score = (F.col("pnl_mean") / 1e6 - 0.45 * F.col("mdd_abs") / 1e6 - 0.40 * F.greatest(F.lit(0.0), -F.col("cvar")) / 1e6
             - 0.20 * F.col("boundary"))
    return m.withColumn("score", score)


def composite_score(pnl: Column, mdd: Column, var: Column, es: Column) -> Column:
    f = lambda c: F.coalesce(c, F.lit(-1e9))
    return f(pnl) + 0.5 * f(mdd) + 0.3 * f(var) + 0.3 * f(es)


def seed_stability(scores: DataFrame, config: str, score: str) -> DataFrame:
    """Mean and deviation of the score over seeds, mean less half the deviation, and its rank."""
    g = scores.groupBy(config).agg(F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_std"))
    g = g.withColumn("stable_score", F.col("score_mean") - 0.5 * F.coalesce("score_std", F.lit(0.0)))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("stable_score"), config)))


def first_full_year(trades: DataFrame, n: int, seed: str, key: str = "exposure_id") -> DataFrame:
    """Earliest year with at least n trades (else the first year) and a reproducible sample of n."""
    y = trades.withColumn("year", F.year("start_date"))
    c = y.groupBy(key, "year").agg(F.count("*").alias("c"))
    pick = c.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("c") >= n, F.col("year"))), F.min("year")).alias("year"))
    rows = y.join(pick, [key, "year"], "left_semi")
    h = F.md5(F.concat_ws("|", F.lit(seed), "scenario_id").cast("binary"))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(h, "scenario_id"))).where(F.col("_rn") <= n).drop("_rn")


def _first_of(df: DataFrame, digits: Column, n: int) -> tuple[DataFrame, DataFrame]:
    """Of rows ordered by ``digits`` (few distinct values): those surely among the first n, and those of the value where n falls, with ``_left``, how many of
    them belong. Counts per value settle it; the table of counts has as many rows as there are values."""
    d = df.withColumn("_range", digits)
    counts = d.groupBy("_range").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("_range", (upto - F.col("_m")).alias("_before"), upto.alias("_upto"))
    sure = d.join(placed.where(F.col("_upto") <= n).select("_range"), "_range", "left_semi").drop("_range")
    edge = placed.where((F.col("_before") < n) & (F.col("_upto") > n)).select("_range", (F.lit(n) - F.col("_before")).alias("_left"))
    return sure, d.join(edge, "_range").drop("_range")


def seeded_sample(df: DataFrame, n: int, seed: str, name: str) -> DataFrame:
    """n rows in hash order: the same rows for the same seed, whatever the partitioning.

    The first four digits of the hash tell for all rows but those of one range whether they are among the first n, four more for all but about one row in
    four billion; only those are ordered. n may be any share of the table.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(name).cast("string")).cast("binary")))
    sure, edge = _first_of(hashed, F.substring("_h", 1, 4), n)
    left = edge.select("_left").limit(1).collect()
    parts = [sure]
    if left:
        more, rest = _first_of(edge.drop("_left"), F.substring("_h", 5, 4), left[0]["_left"])
        last = F.row_number().over(Window.partitionBy(F.substring("_h", 1, 8)).orderBy("_h", name))
        parts += [more, rest.withColumn("_rn", last).where(F.col("_rn") <= F.col("_left")).drop("_rn", "_left")]
    return reduce(DataFrame.unionByName, parts).drop("_h")


def numbered(df: DataFrame, coarse: str, fine: list[str], out: str = "position") -> DataFrame:
    """Position of each row in the order (coarse, fine), from 0, without sorting everything in one task.

    Counts per coarse value (a date) and piece of it carry over; inside a piece rows are numbered on their own.
    """
    pieces = sub_buckets(df, [coarse], fine[0])
    per = pieces.groupBy(coarse, "_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy(coarse, "_b").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as dates times pieces
    carry = per.select(coarse, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy(coarse, "_b").orderBy(*fine)
    d = _join_keys(pieces.withColumn("_in", F.row_number().over(w) - 1), carry, [coarse, "_b"])
    return d.withColumn(out, F.col("_before") + F.col("_in")).drop("_in", "_before", "_b")


def spread_pick(df: DataFrame, coarse: str, fine: list[str], share: float) -> DataFrame:
    """An evenly spread share of the rows, first and last included."""
    d = numbered(df, coarse, fine, "_p")
    n = df.agg(F.count("*")).scalar()
    d = d.withColumn("_nt", n).withColumn("_m", F.greatest(F.lit(1), F.least(F.col("_nt"), F.ceil(F.col("_nt") * share))))
    i = F.ceil(F.try_divide(F.col("_p") * (F.col("_m") - 1), (F.col("_nt") - 1)))
    back = F.floor(F.try_divide(i * (F.col("_nt") - 1), F.col("_m") - 1))
    hit = F.when(F.col("_m") == 1, F.col("_p") == 0).otherwise(back == F.col("_p"))
    return d.where(hit).drop("_p", "_nt", "_m")


def chunked(df: DataFrame, coarse: str, fine: list[str], size: int) -> DataFrame:
    """Chunk numbers of ``size`` consecutive rows."""
    return numbered(df, coarse, fine, "_p").withColumn("chunk", F.floor(F.col("_p") / size)).drop("_p")
