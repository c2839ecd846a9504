"""Report tables: names and run settings read from text, enrichment, coverage alignment, run grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.functions.core import null_text
from basisflow.operators.metrics import average_rank
from basisflow.plans.keys import _join_keys
from basisflow.plans.ordered import keep_first, keep_last

# ---- fixed values: spellings and patterns that decide how old result files are read ----
STRATEGY_NAMES = {
    "NoHedge": ("nohedge", "no_hedge"),
    "Naive": ("naive", "naivehedge", "naive_hedge"),
    "OLSStatic": ("olsstatic", "ols_static", "static_ols"),
    "OLSRolling": ("olsrolling", "ols_roll", "rolling_ols"),
    "Policy": ("rl", "rl_ppo", "ppo", "ppo_rl", "sac", "rl_sac", "sac_lpm", "rl_sac_lpm"),
}
WINDOW_PATTERNS = (r"(?i)__w(\d+|NA)__", r"(?i)(?:^|[|_\-])w(\d{2,4})(?:[|_\-]|$)", r"(?i)(?:window|win)[_=\-]?(\d{2,4})")
MODE_PATTERN = r"(?i)__(dynamic|static)__"
ROLL_PATTERN = r"(?i)__(roll|noroll|no_roll|no-roll)__"
KIND_RULES = (
    ("oracle_universe", ("univ",)),
    ("oracle_all", ("test:all", "oracle_all", "oracle all")),
    ("baseline", ("test:base", "baseline", "base_")),
    ("company", ("company",)),
)
NET_COLUMNS = ("net_pnl_total", "pnl_net_sum", "pnl_net_total", "pnl_net", "net_pnl", "net_pnl_sum", "pnl_sum")
COST_COLUMNS = ("cost_trade_total", "cost_sum", "cost_total", "cost", "cost_trade")
FREQUENCIES = ("DAILY", "WEEKLY", "MONTHLY", "QUARTERLY")
ROLL_WORDS = ("1", "1.0", "true", "t", "yes", "y", "roll")
NOROLL_WORDS = ("0", "0.0", "false", "f", "no", "n", "noroll", "no-roll")
NUMBER = r"([-+0-9.eE]+)"
# patterns of a run folder's name, and the settings their groups give; one pattern's settings are found together or not at all
RUN_FOLDER = (
    (r"_T(\d+)_", ("timesteps",)),
    (f"hmin{NUMBER}_hmax{NUMBER}_dh{NUMBER}_", ("h_min", "h_max", "delta_h")),
    (f"wLPM{NUMBER}_wVOL{NUMBER}_wCOST{NUMBER}_tau{NUMBER}", ("w_lpm", "w_volatility", "w_cost", "lpm_target")),
)
CONFIG_KEY = ("w_lpm", "w_volatility", "w_cost", "delta_h", "gamma", "timesteps", "lpm_target")
PATH_ASSETS = (("OPEC", "OPEC_BASKET"), ("BRENT", "BRENT_SPOT"), ("WTI", "WTI_SPOT"))
# ---- end of fixed values ----


def strategy_name(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), " ", "_")
    out = F
    for name, spellings in STRATEGY_NAMES.items():
        out = out.when(s.isin(*spellings), name)
    out = out.when(s.contains("garch") & s.contains("ccc"), "CCCGarchProxyStrategy")
    return out.when(s.contains("garch") & s.contains("dcc"), "DCCGarchStrategy").otherwise(c)


def _capture(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", hit)


def window_of(text: Column, explicit: Column | None = None) -> Column:
    """Look-back window; the first pattern that matches decides, 'NA' means none."""
    hit = F.coalesce(*[_capture(text, p) for p in WINDOW_PATTERNS])
    w = F.when(F.upper(hit) != "NA", hit.try_cast("int"))
    return F.coalesce(explicit.cast("int"), w) if explicit is not None else w


def mode_of(text: Column, dynamic: Column | None = None) -> Column:
    parsed = F.lower(_capture(text, MODE_PATTERN))
    if dynamic is None:
        return parsed
    return F.when(dynamic.isNotNull(), F.when(dynamic != 0, "dynamic").otherwise("static")).otherwise(parsed)


def roll_flag(c: Column) -> Column:
    """roll / noroll of an explicit flag, a number or a word; NULL if it says neither."""
    t = F.regexp_replace(F.lower(F.trim(c.cast("string"))), "_", "-")
    return F.when(t.isin(*ROLL_WORDS), "roll").when(t.isin(*NOROLL_WORDS), "noroll")


def roll_of(text: Column, flag: Column | None = None) -> Column:
    t = F.regexp_replace(F.lower(_capture(text, ROLL_PATTERN)), "_", "-")
    parsed = F.when(t == "roll", "roll").when(t.isNotNull(), "noroll")
    return parsed if flag is None else F.coalesce(roll_flag(flag), parsed)


def kind_of(text: Column) -> Column:
    s = F.lower(F.trim(text))
    out = F
    for kind, words in KIND_RULES:
        out = out.when(reduce(lambda a, b: a | b, [s.contains(w) for w in words]), kind)
    return out.otherwise("unknown")


def exposure_of(path: Column) -> Column:
    """Exposure named anywhere in a path, the first of the list that occurs, else "unknown"."""
    out = F
    for word, exposure in PATH_ASSETS:
        out = out.when(F.contains(F.upper(path), F.lit(word)), exposure)
    return out.otherwise("unknown")


def asset_of(path: Column, assets: list[str]) -> Column:
    """The first path part that is a known asset."""
    hits = F.filter(F.split(path, "/"), lambda p: p.isin(*assets))
    return F.try_element_at(hits, F.lit(1))


def oracle_parts(series: Column) -> tuple[Column, Column, Column]:
    """(pool, freq, label) by position: first part, second part, last part if BEST or WORST."""
    t = null_text(series)
    parts = F.filter(F.split(F.upper(t), "_"), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    return (F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)),
            F.when(last.isin("BEST", "WORST"), last))


def oracle_words(series: Column) -> tuple[Column, Column, Column]:
    """(pool, freq, label) by keyword, 'unknown' where none occurs."""
    parts = F.split(F.upper(F.coalesce(null_text(series), F.lit(""))), r"[_\-\s]+")
    def pick(words):
        out = F
        for w in words:
            out = out.when(F.array_contains(parts, w), w)
        return out.otherwise("unknown")
    return pick(("EXTREME", "FEASIBLE")), pick(FREQUENCIES), pick(("BEST", "WORST"))


def oracle_kind(series: Column) -> Column:
    s = F.lower(F.trim(series))
    return (F.when(series.isNull() | (s == ""), None).when(s.contains("extreme"), "oracle_extreme")
            .when(s.contains("feasible"), "oracle_feasible").otherwise("oracle_other"))


def canonical_oracle(df: DataFrame) -> DataFrame:
    """Fill label and pool from any of the text fields and move labelled rows to their own kind."""
    cols = ("scenario_kind", "oracle_series", "oracle_pool", "label", "tag")
    d = df.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in cols})
    text = F.regexp_replace(F.upper(F.concat_ws("__", *cols)), "[- ]", "_")
    d = d.withColumn("_t", text)
    gone = lambda c: null_text(F.col(c)).isNull()
    t = F.col("_t")
    d = d.withColumns({
        "label": F.when(gone("label") & t.contains("WORST"), "WORST").when(gone("label") & t.contains("BEST"), "BEST")
        .otherwise(F.col("label")),
        "oracle_pool": F.when(gone("oracle_pool") & t.contains("EXTREME"), "EXTREME")
        .when(gone("oracle_pool") & t.contains("FEASIBLE"), "FEASIBLE").otherwise(F.col("oracle_pool"))})
    k = F.regexp_replace(F.lower(F.trim("scenario_kind")), "[- ]", "_")
    full = F.upper(F.concat_ws("__", k, F.col("oracle_series"), F.col("oracle_pool"), F.col("tag"), F.col("label")))
    return d.withColumn("scenario_kind", F.when(full.contains("EXTREME"), "oracle_extreme")
                        .when(full.contains("FEASIBLE"), "oracle_feasible")
                        .when(k.startswith("oracle_all"), "oracle_all").otherwise(F.col("scenario_kind"))).drop("_t")


def run_key() -> Column:
    w = F.coalesce(F.col("window").cast("string"), F.lit("NA"))
    return F.concat_ws("|", "exposure_id", "scenario_kind", "strategy", F.concat(F.lit("w"), w), "mode", "roll")


def run_folder_settings(df: DataFrame, name: str) -> DataFrame:
    """Settings of a run as read from its folder's name, where a column of ``df`` does not state them already; NULL if neither does.

    The last part of a path is the folder's name. Steps are whole numbers; what a pattern finds but no number can be read from is NULL.
    """
    folder = F.element_at(F.split(F.regexp_replace(F.col(name), "/+$", ""), "/"), -1)
    out = {}
    for pattern, settings in RUN_FOLDER:
        for i, c in enumerate(settings, 1):
            found = F.regexp_extract(folder, pattern, i).try_cast("bigint" if c == "timesteps" else "double")
            out[c] = F.coalesce(F.col(c).try_cast("double"), found) if c in df.columns else found
    if "gamma" not in df.columns:
        out["gamma"] = F.lit(None).cast("double")
    return df.withColumns(out)


def rank_runs(summary: DataFrame, order: list[str | Column]) -> DataFrame:
    """Runs against naive, ranked: the last row of each configuration by ``order``, ``rank_score`` (four average ranks added up), ``position`` (more flags first,
    then the smaller score) and ``flagged``, whether any flag is set. Configurations are the same if their numbers agree to ten digits.

    A row is a run, so there are as many as configurations were tried.
    """
    rounded = {f"_k_{c}": F.round(F.col(c).cast("double"), 10) if c != "timesteps" else F.col(c).cast("double").cast("bigint") for c in CONFIG_KEY}
    last = keep_last(summary.withColumns(rounded), list(rounded), order).drop(*rounded)
    score = sum((average_rank(c, [], descending=True) for c in ("diff_mean_pnl", "diff_es95", "diff_he")), average_rank("turnover_h", []))
    ranked = last.withColumn("rank_score", score).withColumn("flagged", F.col("flags_total") > 0)
    return ranked.withColumn("position", F.row_number().over(Window.orderBy(F.desc("flags_total"), F.asc_nulls_last("rank_score"), *CONFIG_KEY)))


def config_key(floats: list[str], ints: list[str]) -> Column:
    """Grid point identity: floats to ten digits, whole step counts."""
    return F.concat_ws("|", *[F.format_string("%.10f", F.col(c).cast("double")) for c in floats],
                       *[F.col(c).cast("long").cast("string") for c in ints])


def report_schema(df: DataFrame) -> DataFrame:
    """Map result columns of other writers. The first column that exists wins, as a whole."""
    first = lambda names: next((c for c in names if c in df.columns), None)
    net, cost = first(NET_COLUMNS), first(COST_COLUMNS)
    legs = {"spot_pnl_total", "fut_pnl_total"} <= set(df.columns)
    if net is None and not legs:
        raise ValueError(f"no net P&L column; give one of {NET_COLUMNS}")
    num = lambda c: F.col(c).try_cast("double")
    zero = F.lit(None).cast("double")
    trade = num(cost) if cost else zero
    roll = num("cost_roll_total") if "cost_roll_total" in df.columns else (
        num("cost_roll") if "cost_roll" in df.columns else F.lit(0.0))
    spot = num("spot_pnl_total") if "spot_pnl_total" in df.columns else zero
    fut = num("fut_pnl_total") if "fut_pnl_total" in df.columns else zero
    return df.withColumns({
        "spot_pnl_total": spot, "fut_pnl_total": fut, "cost_trade_total": trade, "cost_roll_total": roll,
        "net_pnl_total": num(net) if net else spot + fut - trade - roll,
        "gross_pnl_total": spot + fut, "total_cost": trade + roll})


def metadata_probe(df: DataFrame) -> DataFrame:
    """Whether run settings are mostly unreadable: window known < 10 %, mode and roll unknown > 80 %."""
    known = F.avg(F.col("window").isNotNull().cast("double"))
    lost = lambda c: F.avg(null_text(F.col(c)).isNull().cast("double"))
    return df.agg(known.alias("window_known"), lost("mode").alias("mode_unknown"), lost("roll").alias("roll_unknown"),
                  ((known < 0.10) & (lost("mode") > 0.80) & (lost("roll") > 0.80)).cast("int").alias("needs_rebuild"))


def enrich(df: DataFrame, meta: DataFrame, key: str, cols: list[str], order: list[str]) -> DataFrame:
    """Fill only missing values from the first metadata row of each id, first by the columns ``order``."""
    m = keep_first(meta.select(key, *dict.fromkeys([*cols, *order])), [key], order)
    m = m.select(key, *[F.col(c).alias(f"_m_{c}") for c in cols])
    j = df.join(m, key, "left")
    text = dict(df.dtypes)
    own = lambda c: null_text(F.col(c)) if text.get(c) == "string" else F.col(c)
    return j.withColumns({c: F.coalesce(own(c) if c in text else F.lit(None), F.col(f"_m_{c}")) for c in cols}).drop(
        *[f"_m_{c}" for c in cols])


def fill_ids(df: DataFrame, known: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Fill missing scenario ids by a composite key, first known trade wins."""
    first = keep_first(known.where("scenario_id IS NOT NULL").select("scenario_id", *keys, *[c for c in order if c not in keys]),
                       keys, order)
    first = first.select(*keys, F.col("scenario_id").alias("_id"))
    return df.join(first, keys, "left").withColumn("scenario_id", F.coalesce("scenario_id", "_id")).drop("_id")


def split_by_label(df: DataFrame, labels: DataFrame, order: list[str]) -> DataFrame:
    """Split kind oracle_all by the row's own label, else by the last label of its (exposure, id) in ``order``."""
    known = labels.where(F.col("oracle_series") != "")
    last = keep_last(known, ["exposure_id", "scenario_id"], order).select("exposure_id", "scenario_id", F.col("oracle_series").alias("_o"))
    j = df.join(last, ["exposure_id", "scenario_id"], "left")
    if "oracle_series" in df.columns:
        j = j.withColumn("_o", F.coalesce(F.nullif(F.col("oracle_series"), F.lit("")), "_o"))
    return j.withColumn("scenario_kind", F.when(F.col("scenario_kind") == "oracle_all",
                        F.coalesce(oracle_kind(F.col("_o")), F.col("scenario_kind"))).otherwise(F.col("scenario_kind"))).drop("_o")


def restrict_to_reference(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows whose trade occurs in the reference: by record id if both have it, without the kind if
    the reference knows no kind at all."""
    keys = ["exposure_id", "scenario_kind", "scenario_id"]
    if "scenario_record_id" in df.columns and "scenario_record_id" in reference.columns:
        keys = [*keys, "scenario_record_id"]
    elif "scenario_kind" not in reference.columns or reference.where(
            null_text(F.col("scenario_kind")).isNotNull()).isEmpty():
        keys = ["exposure_id", "scenario_id"]
    return df.join(reference.select(*keys), keys, "left_semi")


def common_scenarios(df: DataFrame, bucket: list[str]) -> DataFrame:
    """Trades covered by every strategy of their bucket.

    A bucket with one strategy, or with no common trade, stays as it is; strategies without ids do not count. A trade's strategies are gathered
    in one narrow aggregate, which tells the buckets that have a common trade, and once more in the only exchange of the rows themselves.
    """
    has_id = F.col("scenario_id").isNotNull()
    facts = df.groupBy(*bucket).agg(F.size(F.collect_set(F.when(has_id, F.col("strategy")))).alias("_need"), F.size(F.collect_set("strategy")).alias("_all"))
    per_trade = df.where(has_id).groupBy(*bucket, "scenario_id").agg(F.size(F.collect_set("strategy")).alias("_n"))
    tight = _join_keys(per_trade, facts.where("_all > 1"), bucket, "inner").where("_n = _need").groupBy(*bucket).agg(F.max("_need").alias("_full"))
    # rows without an id are spread, they are no trade
    salt = F.when(~has_id, F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    same_trade = Window.partitionBy(*bucket, "scenario_id", "_salt")
    counted = df.withColumn("_salt", salt).withColumn("_n", F.size(F.collect_set("strategy").over(same_trade))).drop("_salt")
    flagged = _join_keys(counted, tight, bucket)
    return flagged.where(F.col("_full").isNull() | (has_id & (F.col("_n") == F.col("_full")))).drop("_n", "_full")


def run_grid(exposures: DataFrame, kinds: list[str], windowed: dict[str, list[int]], plain: list[str]) -> DataFrame:
    """All runs to do. Each exposure unfolds the option lists; a strategy without a window has none,
    and a constant one has no dynamic variant."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    variants = [F.struct(F.lit(s).alias("strategy"), F.lit(w).cast("int").alias("window"))
                for s, ws in windowed.items() for w in ws]
    variants += [F.struct(F.lit(s).alias("strategy"), F.lit(None).cast("int").alias("window")) for s in plain]
    g = exposures.select("exposure_id", F.explode(lit(kinds)).alias("scenario_kind"))
    g = g.select("*", F.explode(F.array(*variants)).alias("v")).select("exposure_id", "scenario_kind", "v.*")
    g = g.select("*", F.explode(lit(["dynamic", "static"])).alias("mode")).select("*", F.explode(lit(["roll", "noroll"])).alias("roll"))
    return g.withColumn("mode", F.when(F.col("strategy").isin("nohedge", "naive"), "static").otherwise(F.col("mode"))).distinct()


def remaining_runs(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Runs of the grid without a finished result, by their full key."""
    return grid.withColumn("run_key", run_key()).join(done.select("run_key"), "run_key", "left_anti")


def with_default(df: DataFrame, policy: DataFrame, keys: list[str], col: str, default: float) -> DataFrame:
    return df.join(policy.select(*keys, col), keys, "left").withColumn(col, F.coalesce(col, F.lit(float(default))))
