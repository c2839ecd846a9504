"""Writers of result sets, report tables and portable Parquet."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basisflow.plans.lineage import put_text
from basisflow.sources.readers import read_results


def align_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` in its order; missing ones NULL, extra ones dropped."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _by_bucket(df: DataFrame, path: str, mode: str) -> None:
    # the hint gathers small buckets and lets Spark split large ones by size, so tasks follow the data
    (df.hint("rebalance", "exposure_id", "scenario_kind").write.mode(mode)
     .partitionBy("exposure_id", "scenario_kind").parquet(path))


def write_results(df: DataFrame, path: str) -> None:
    """One table split by (exposure, kind)."""
    _by_bucket(df, path, "overwrite")


def append_results(df: DataFrame, path: str) -> None:
    _by_bucket(align_columns(df, read_results(df.sparkSession, [path]).drop("source_file")), path, "append")


def write_part(df: DataFrame, path: str, part: str) -> None:
    """Add a part (a window, a run, a day) to a result table; the same part written again takes the place of the first.

    Rows go to a folder of their own, and only then a note names that folder as the part's run. A writer that dies leaves the part as it was; a
    retry writes a new folder; readers (``readers.read_parts``) follow the notes and see each part once and whole.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", part) or part.startswith(("_", ".")):
        raise ValueError(f"part name {part!r}: letters, digits, '_', '.' and '-' only, the first a letter or digit")
    run = uuid.uuid4().hex
    _by_bucket(df, f"{path}/part={part}/run={run}", "errorifexists")
    put_text(df.sparkSession, f"{path}/_commits/{part}", run)


def write_report_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A report table as CSV files in order: rows are dealt by ranges of the order columns, so part files follow each other and no task sorts them all;
    a small report ends up in one file."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def safe_names(columns: list[str], keep: str = "Date") -> dict[str, str]:
    """Column names any SQL viewer accepts; repeats get a number."""
    used: dict[str, int] = {}
    out = {}
    for c in columns:
        new = c if c == keep else (re.sub(r"_+", "_", re.sub(r"\W", "_", c, flags=re.ASCII)).strip("_") or "col")
        used[new] = used.get(new, 0) + 1
        out[c] = new if used[new] == 1 else f"{new}_{used[new]}"
    return out


def with_safe_names(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renamed frame and the name map as a table."""
    names = safe_names(df.columns)
    table = df.sparkSession.createDataFrame(list(names.items()), "original string, safe string")
    return df.toDF(*names.values()), table


def write_safe_parquet(df: DataFrame, path: str) -> None:
    """A wide table as Parquet with safe column names, and the names it had as ``<path>_names``."""
    renamed, names = with_safe_names(df)
    renamed.write.mode("overwrite").parquet(path)
    names.write.mode("overwrite").parquet(f"{path}_names")


def best_and_worst(m: DataFrame, bucket: list[str], by: str, tie: str, n: int = 10) -> DataFrame:
    """The first and the last n rows of each bucket by a metric, NULL left out; both sides are ranked filters that limit map tasks."""
    there = m.where(F.col(by).isNotNull())
    sides = [there.withColumns({"side": F.lit(side), "place": F.row_number().over(Window.partitionBy(*bucket).orderBy(order, tie))}).where(F.col("place") <= n)
             for side, order in (("best", F.desc(by)), ("worst", F.asc(by)))]
    return sides[0].unionByName(sides[1])


def raw_sample(df: DataFrame, bucket: list[str], name: list[str], n: int, seed: str) -> DataFrame:
    """n rows of each bucket in hash order of their name: the same rows whatever the partitioning."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *name).cast("binary"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*bucket).orderBy(h, *name))).where(F.col("place") <= n)


def top_slices(m: DataFrame, bucket: list[str], by: str, n: int = 15, ascending: bool = False) -> DataFrame:
    """First n rows per bucket by a metric; Spark limits each map task before the shuffle."""
    order = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    w = Window.partitionBy(*bucket).orderBy(order, "strategy")
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def main_slices(m: DataFrame, windows: list[int] = (120, 252)) -> DataFrame:
    """Comparison slices: primary (dynamic, roll), roll against no roll, static against dynamic."""
    w = F.col("window")
    near = w.isNull() | (w == windows[0])
    dyn, roll = F.col("mode") == "dynamic", F.col("roll") == "roll"
    tags = F.filter(F.array(
        F.when(dyn & roll & (w.isNull() | w.isin(*windows)), "primary"), F.when(dyn & near & F.col("roll").isin("roll", "noroll"), "roll_vs_noroll"),
        F.when(roll & near & F.col("mode").isin("static", "dynamic"), "static_vs_dynamic")), lambda t: t.isNotNull())
    return m.withColumn("slice", F.explode(tags))
