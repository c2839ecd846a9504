"""Contract and consistency checks. Each check is one aggregate; results are small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the result contract ----
REQUIRED = ("exposure_id", "scenario_id", "scenario_kind", "strategy", "split", "window_id", "net_pnl_total",
            "spot_pnl_total", "fut_pnl_total", "cost_trade_total", "cost_roll_total", "turnover_contracts", "mdd_equity")
TEXTS = ("exposure_id", "scenario_id", "scenario_kind", "strategy", "split", "window_id")
DOUBLES = REQUIRED[6:]
ALIASES = {"exposure": "exposure_id", "scenario": "scenario_id", "kind": "scenario_kind", "scenario_type": "scenario_kind",
           "model": "strategy", "wf_window": "window_id", "pnl_net_total": "net_pnl_total", "pnl_total": "net_pnl_total",
           "spot_pnl": "spot_pnl_total", "fut_pnl": "fut_pnl_total", "cost_trade": "cost_trade_total",
           "cost_roll": "cost_roll_total", "turnover": "turnover_contracts", "mdd": "mdd_equity"}
SCENARIO_KINDS = ("baseline", "company", "oracle_universe", "oracle_all")
# ---- end of fixed values ----
TOLERANCE = 1e-6


def conform(df: DataFrame, strict: bool = True) -> tuple[DataFrame, dict]:
    """Rename aliases, fill defaults, cast and trim to the result contract.

    Returns the frame and a report of what was renamed, defaulted and is missing.
    """
    names = {c: ALIASES[c] for c in df.columns if c in ALIASES and ALIASES[c] not in df.columns}
    d = df.withColumnsRenamed(names)
    defaults = {c: v for c, v in (("split", "NA"), ("window_id", "full")) if c not in d.columns}
    d = d.withColumns({c: F.lit(v) for c, v in defaults.items()}) if defaults else d
    missing = [c for c in REQUIRED if c not in d.columns]
    report = {"ok": not missing, "missing_required": missing, "renamed": names, "defaulted": sorted(defaults)}
    if missing and strict:
        raise ValueError(f"missing required columns: {missing}")
    d = d.withColumns({c: F.trim(F.col(c).cast("string")) for c in TEXTS if c in d.columns})
    d = d.withColumns({c: F.col(c).try_cast("double") for c in DOUBLES if c in d.columns})
    return d.withColumn("window_id", F.coalesce("window_id", F.lit("full"))), report


def contract_notes(d: DataFrame) -> DataFrame:
    """One row: P&L identity violations and unlabelled oracle rows."""
    off = F.abs(F.col("net_pnl_total") - (F.col("spot_pnl_total") + F.col("fut_pnl_total")
                - F.col("cost_trade_total") - F.col("cost_roll_total"))) > TOLERANCE
    plain = not {"scenario_record_id", "scenario_id_with_label"} & set(d.columns)
    return d.agg(F.count("*").alias("n_rows"), F.count_if(off).alias("identity_violations"),
                 (F.count_if(F.col("scenario_kind") == "oracle_all") * F.lit(int(plain))).alias("oracle_rows_without_record_id"))


def _table(counts: DataFrame, checks: list[str]) -> DataFrame:
    """Rows (check, ok, n_bad, sample) of a one-row frame with a count and, under ``_<check>``, an offending key for each check."""
    sample = lambda c: F.col(f"`_{c}`") if f"_{c}" in counts.columns else F.lit(None).cast("string")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias("n_bad"), sample(c).alias("sample"))
                               for c in checks]))
    return counts.select(rows.alias("r")).select("r.check", (F.col("r.n_bad") == 0).cast("int").alias("ok"), "r.n_bad", "r.sample")


def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number of rows on keys that occur more than once; per-key counts combine before the shuffle."""
    g = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    bad = g.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(name), F.min(F.when(F.col("_n") > 1, text)).alias(f"_{name}"))
    return _table(bad, [name])


def scenario_checks(df: DataFrame, exposure: str | None = None) -> DataFrame:
    """(check, ok, n_bad, sample) of the row rules, unique ids and, for labelled trades, unique labels and record ids.

    The sample is the smallest offending id.
    """
    need = ["scenario_id", "exposure_id", "start_date", "end_date", "volume_bbl", "scenario_kind"]
    c = F.col
    rules: dict[str, Column] = {f"{k}_present": c(k).isNull() for k in need}
    rules |= {
        "kind_allowed": ~c("scenario_kind").isin(*SCENARIO_KINDS),
        "end_not_before_start": c("end_date") < c("start_date"),
        "realized_within_target": c("horizon_days_realized") > c("horizon_days_target"),
        "realized_within_span": c("horizon_days_realized") > F.datediff("end_date", "start_date") + 5}
    if exposure is not None:
        rules["exposure_matches"] = c("exposure_id") != exposure
    if "oracle_series" in df.columns:
        rules["label_present"] = (c("scenario_kind") == "oracle_all") & (F.trim(F.coalesce(c("oracle_series"), F.lit(""))) == "")
    if "scenario_record_id" in df.columns:
        rules["record_id_present"] = (c("scenario_kind") == "oracle_all") & (F.trim(F.coalesce(c("scenario_record_id"), F.lit(""))) == "")
    out = _table(df.agg(*[F.count_if(v).alias(k) for k, v in rules.items()],
                        *[F.min(F.when(v, c("scenario_id").cast("string"))).alias(f"_{k}") for k, v in rules.items()]), list(rules))
    if "scenario_record_id" in df.columns:
        known = df.where((c("scenario_kind") == "oracle_all") & c("scenario_record_id").isNotNull())
        out = out.unionByName(duplicates(known, ["scenario_record_id"], "record_id_unique"))
    if "oracle_series" in df.columns:
        lab = df.where(c("scenario_kind") == "oracle_all")
        out = out.unionByName(duplicates(lab, ["scenario_id", "oracle_series"], "label_unique"))
        df = df.where(c("scenario_kind") != "oracle_all")
    return out.unionByName(duplicates(df, ["scenario_id"], "id_unique"))


def result_checks(res: DataFrame, universe: DataFrame) -> DataFrame:
    """Kinds allowed, ids known, same trade count per strategy, unhedged variance above zero."""
    kinds = _table(res.agg(F.count_if(~F.col("scenario_kind").isin(*SCENARIO_KINDS)).alias("kinds_allowed")), ["kinds_allowed"])
    unknown = res.join(universe.select("scenario_id").distinct(), "scenario_id", "left_anti")
    ids = _table(unknown.agg(F.count("*").alias("ids_known")), ["ids_known"])
    per = res.select("exposure_id", "scenario_kind", "strategy", "scenario_id").distinct().groupBy(
        "exposure_id", "scenario_kind", "strategy").agg(F.count("*").alias("n"))
    uneven = per.groupBy("exposure_id", "scenario_kind").agg((F.min("n") != F.max("n")).alias("bad"))
    even = _table(uneven.agg(F.count_if(F.col("bad")).alias("strategies_even")), ["strategies_even"])
    var = res.where(F.col("strategy") == "nohedge").groupBy("exposure_id", "scenario_kind").agg(F.var_pop("net_pnl_total").alias("v"))
    flat = _table(var.agg(F.count_if(~F.coalesce(F.col("v") > 0, F.lit(False))).alias("nohedge_varies")), ["nohedge_varies"])
    return reduce(DataFrame.unionByName, [kinds, ids, even, flat])


def id_overlap(sets: DataFrame, label: str = "scenario_kind") -> DataFrame:
    """Shared ids per pair of files. Each id keeps the list of the few files that hold it."""
    held = sets.groupBy("scenario_id").agg(F.array_sort(F.collect_set(label)).alias("ls"))
    left = held.where(F.size("ls") > 1).select("ls", F.posexplode("ls").alias("i", "a"))
    pair = left.select("a", F.explode(F.slice("ls", F.col("i") + 2, F.greatest(F.size("ls") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return pair.groupBy("a", "b").agg(F.count("*").alias("n_shared"))
