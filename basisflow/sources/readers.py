"""Readers of master panels, price series, scenario sets, result sets and outside policy results."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basisflow.functions.core import null_text, to_day
from basisflow.operators.report import exposure_of, oracle_kind, strategy_name, window_of
from basisflow.plans.lineage import listing, written
from basisflow.plans.ordered import keep_first, keep_last

# ---- fixed values: file and column names in use ----
DATE_NAMES = ("Date", "date", "DATE", "datetime", "timestamp")
SCENARIO_RENAMES = {"start": "start_date", "end": "end_date", "Q": "volume_bbl", "horizon_days": "horizon_days_target"}
SCENARIO_FILES = {"baseline": ("baseline.parquet", "scenarios_baseline.parquet"),
                  "company": ("companies.parquet", "company.parquet", "scenarios_company.parquet"),
                  "oracle_universe": ("oracle_universe.parquet",), "oracle_all": ("oracle_all.parquet", "Oracle_all.parquet")}
DATASET_KINDS = {"test:univ": "oracle_universe", "val:univ": "oracle_universe", "train:univ": "oracle_universe",
                 "univ": "oracle_universe", "universe": "oracle_universe", "test:all": "oracle_all", "all": "oracle_all",
                 "test:base": "baseline", "base": "baseline"}
POLICY_COLUMNS = {
    "net_pnl_total": ("net_pnl_total", "pnl_net_sum", "episode_net_pnl", "episode_pnl", "net_pnl", "pnl_net", "pnl", "pnl_total",
                      "total_pnl", "final_net_pnl", "net_profit", "episode_profit", "profit", "equity_pnl", "final_pnl",
                      "total_net_pnl", "test_pnl", "realized_pnl", "portfolio_pnl"),
    "cost_trade_total": ("cost_trade_total", "cost_sum", "trade_cost", "trade_cost_total", "cost_trade", "transaction_cost", "total_cost"),
    "cost_roll_total": ("cost_roll_total", "roll_cost", "roll_cost_total", "cost_roll"),
    "turnover_contracts": ("turnover_contracts", "turnover_contract", "turnover", "contracts_turnover", "contract_turnover"),
    "turnover_h": ("turnover_h", "hedge_turnover", "h_turnover"),
    "max_abs_contracts": ("max_abs_contracts", "max_contracts", "max_abs_position"),
    "mdd_equity": ("mdd_equity", "mdd", "max_drawdown", "episode_mdd", "maximum_drawdown"),
    "spot_pnl_total": ("spot_pnl_total", "physical_pnl"), "fut_pnl_total": ("fut_pnl_total", "futures_pnl"),
}
# ---- end of fixed values ----
DEFAULT_VOLUME = 1_000_000.0
POLICY = "Policy"


def require(df: DataFrame, cols: list[str], what: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; found {df.columns}")


def date_column(columns: list[str]) -> str:
    """The date column: a usual name, else the first whose name contains 'date'."""
    for c in DATE_NAMES:
        if c in columns:
            return c
    for c in columns:
        if re.search("date", c, re.IGNORECASE):
            return c
    raise ValueError(f"no date column among {columns}")


def _decoded(name: str) -> str:
    """A header read byte by byte, as UTF-8 if it is that."""
    raw = name.encode("latin-1")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.removeprefix(b"\xef\xbb\xbf").decode("latin-1")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header as text columns; each file is UTF-8 (with or without its mark) if all of it is, else latin-1.

    The text is parsed once, one character per byte, which both encodings allow since separators, quotes and line ends are ASCII, and kept as
    Parquet with the file of each row. Whether a file is valid UTF-8 is then an aggregate per file, and its columns are read anew from their bytes.
    """
    text = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    names = [_decoded(c) for c in text.columns]
    columns = [F.col(f"`{c}`") for c in text.columns]
    raw = written(text.select(F.col("_metadata.file_path").alias("file"), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).alias("row")), "csv")
    latin = lambda c: F.encode(c, "ISO-8859-1")
    cells = [F.col(f"row.c{i}") for i in range(len(names))]
    valid = raw.groupBy("file").agg(F.bool_and(F.is_valid_utf8(latin(F.concat_ws("\n", *cells)))).alias("utf8"))
    both = raw.join(valid.withColumnRenamed("file", "_file"), F.col("file") == F.col("_file"))
    return both.select(*[F.when(F.col("utf8"), F.decode(latin(c), "UTF-8")).otherwise(c).alias(n) for c, n in zip(cells, names, strict=True)])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path) if ".csv" in path.lower() else spark.read.option("mergeSchema", True).parquet(path)


def csv_to_parquet(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Convert a CSV once and read the Parquet copy until the CSV changes.

    The copy lies under a name made from paths, sizes and times of the CSV's files, and counts only once its writer has finished.
    """
    source = listing(spark, path)
    if not source:
        raise FileNotFoundError(path)
    copy = f"{out}/{hashlib.sha256(repr(source).encode()).hexdigest()[:32]}"
    if not listing(spark, f"{copy}/_SUCCESS"):
        _csv(spark, path).write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)


def normalise_dates(df: DataFrame, col: str | None = None, out: str = "d") -> DataFrame:
    """Day column from any readable spelling; rows without a readable date are dropped."""
    c = col or date_column(df.columns)
    return df.withColumn(out, to_day(F.col(f"`{c}`"))).where(F.col(out).isNotNull())


def read_master(spark: SparkSession, path: str) -> DataFrame:
    df = normalise_dates(read_table(spark, path))
    values = [c for c in df.columns if c not in ("d", *[x for x in df.columns if x == date_column(df.columns)])]
    return df.select("d", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in values])


def wide_to_long(df: DataFrame, at: str = "d") -> DataFrame:
    """(series_id, d, price) from one column per series."""
    return df.unpivot([at], [c for c in df.columns if c != at], "series_id", "price")


def read_price_series(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    require(df, ["f_mark"], path)
    return normalise_dates(df).withColumn("f_mark", F.col("f_mark").try_cast("double"))


def clean_scenarios(df: DataFrame) -> DataFrame:
    """Canonical names, readable dates, end not before start."""
    d = df.withColumnsRenamed({a: b for a, b in SCENARIO_RENAMES.items() if a in df.columns and b not in df.columns})
    require(d, ["start_date", "end_date", "volume_bbl"], "scenarios")
    d = d.withColumns({c: to_day(F.col(c)) for c in ("start_date", "end_date")})
    return d.where("start_date IS NOT NULL AND end_date IS NOT NULL AND end_date >= start_date")


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return clean_scenarios(read_table(spark, path))


def read_scenario_root(spark: SparkSession, root: str, exposure: str, kinds: list[str]) -> DataFrame:
    """Scenario files of an exposure by kind: first existing name, defaults filled, first copy of an id wins.

    A file that exists but cannot be read is an error. Rows of the labelled file take their kind from their label.
    """
    frames = []
    for order, kind in enumerate(kinds):
        for name in SCENARIO_FILES[kind]:
            path = f"{root}/{exposure}/{name}"
            if not listing(spark, path):
                continue
            df = spark.read.parquet(path)
            df = clean_scenarios(df if "volume_bbl" in df.columns else df.withColumn("volume_bbl", F.lit(DEFAULT_VOLUME)))
            own = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)
            labelled = F.lit(kind)
            if kind == "oracle_all" and "oracle_series" in df.columns:
                labelled = F.coalesce(oracle_kind(F.col("oracle_series")), labelled)
            frames.append(df.withColumns({
                "scenario_kind": F.coalesce(F.col("scenario_kind"), labelled) if "scenario_kind" in df.columns and kind != "oracle_all" else labelled, "exposure_id": own("exposure_id", exposure),
                "volume_bbl": F.coalesce(F.col("volume_bbl").try_cast("double"), F.lit(DEFAULT_VOLUME)),
                "scenario_file": F.lit(name), "_o": F.lit(order)}))
            break
    if not frames:
        raise ValueError(f"no scenario files for {exposure} under {root}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return keep_first(out, ["scenario_id", "exposure_id", "scenario_kind"], ["_o", "start_date", "end_date"]).drop("_o")


def read_results(spark: SparkSession, paths: list[str], text: tuple[str, ...] = ("exposure_id", "scenario_kind")) -> DataFrame:
    """Result files of one layout with the file each row came from. Folder names of ``text`` columns are texts, whatever they look like."""
    found = spark.read.option("mergeSchema", True).parquet(*paths).schema
    schema = StructType([StructField(f.name, StringType()) if f.name in text else f for f in found.fields])
    df = spark.read.schema(schema).parquet(*paths)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The committed runs of ``sinks.write_part``: one run of each part, with the part's name as ``part``."""
    notes = [f for f, size, _ in listing(spark, f"{path}/_commits") if size]
    if not notes:
        raise FileNotFoundError(f"no committed part under {path}")
    # one short note per part
    told = spark.read.option("wholetext", True).text(notes).select(F.col("_metadata.file_name").alias("part"), F.trim("value").alias("run")).collect()
    folders = [f"{path}/part={r.part}/run={r.run}" for r in told]
    found = spark.read.option("basePath", path).option("mergeSchema", True).parquet(*folders)
    texts = ("exposure_id", "scenario_kind", "part", "run")
    schema = StructType([StructField(f.name, StringType()) if f.name in texts else f for f in found.schema.fields])
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).drop("run")


def union_windows(spark: SparkSession, parts: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Per-window outputs as one table; columns a part lacks take their default."""
    out = None
    for window, path in parts.items():
        df = spark.read.parquet(path).withColumn("window_id", F.lit(window))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v) for c, v in defaults.items()})


def dataset_kind(c: Column) -> Column:
    out = F
    for k, v in DATASET_KINDS.items():
        out = out.when(c == k, v)
    return out.otherwise(c)


def ingest_policy(df: DataFrame, order: list[str], default_window: Column | None = None) -> DataFrame:
    """Outside policy results in the report layout.

    The first candidate column that exists gives a target as a whole; dataset names become kinds; the
    last copy of a run wins by ``order``.
    """
    have = set(df.columns)
    first = {t: next((c for c in cands if c in have), None) for t, cands in POLICY_COLUMNS.items()}
    d = df.withColumns({t: F.col(c).try_cast("double") if c else F.lit(None).cast("double") for t, c in first.items()})
    kind = F.col("scenario_kind") if "scenario_kind" in have else (F.col("dataset") if "dataset" in have else F.lit("oracle_universe"))
    text = lambda c, v: F.coalesce(null_text(F.col(c)), F.lit(v)) if c in have else F.lit(v)
    window = F.col("window").try_cast("int") if "window" in have else (
        default_window if default_window is not None else (window_of(F.col("source_file")) if "source_file" in have else F.lit(None).cast("int")))
    if "exposure_id" not in have:
        d = d.withColumn("exposure_id", exposure_of(F.col("source_file")) if "source_file" in have else F.lit("unknown"))
    d = d.withColumns({
        "scenario_kind": dataset_kind(kind),
        "strategy": F.coalesce(strategy_name(F.col("strategy")), F.lit(POLICY)) if "strategy" in have else F.lit(POLICY),
        "window": window, "mode": text("mode", "dynamic"), "roll": text("roll", "roll"),
        "dynamic": F.coalesce(F.col("dynamic").cast("int"), F.lit(1)) if "dynamic" in have else F.lit(1)})
    return keep_last(d, ["scenario_id", "exposure_id", "scenario_kind", "strategy", "window", "mode", "roll"], order)
