"""Market-shaped inputs read from the star-schema tables.

``prices`` is the base everything starts from: one row per (series, day), so a window over a
series is bounded by the calendar however many raw rows a series has. The raw rows are combined
by a partial aggregate before the shuffle, which also defuses a hot series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT, NEXT, SPOT = "A", "R", "N"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EXPOSURES = (SPOT, *PRIORITIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, d, price): volume-weighted unit price per return flag in hundreds, mean order
    value per priority in ten thousands, both cut to four decimals with whole-number arithmetic."""
    lots = (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("d"))
            .agg(F.sum(cents("l_extendedprice")).alias("c"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
            .select("series_id", "d", (F.expr("c div q") / F.lit(10000.0)).alias("price")))
    tickets = (table(spark, sf_dir, "orders")
               .groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("d"))
               .agg(F.sum(cents("o_totalprice")).alias("c"), F.count("*").alias("q"))
               .select("series_id", "d", (F.expr("c div (q * 100)") / F.lit(10000.0)).alias("price")))
    return lots.unionByName(tickets)


def dirty_prices(panel: DataFrame) -> DataFrame:
    """The panel with regular gaps, zeros and negative values."""
    n = F.unix_date("d")
    return panel.select("series_id", "d", (
        F.when(n % 11 == 0, None).when(n % 53 == 0, 0.0).when(n % 97 == 0, -F.col("price"))
        .otherwise(F.col("price"))).alias("price"))


def trade_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asked-for trade per order; every third goes to the one exposure 'N'."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("trade_no"),
        F.when(k % 3 == 0, SPOT).otherwise(F.col("o_orderpriority")).alias("exposure_id"),
        F.to_date("o_orderdate").alias("start_date"),
        (F.lit(20) + k % 21).cast("int").alias("horizon_days_target"),
        (F.lit(500000) + (k * 7919) % 1000001).cast("long").alias("volume_bbl"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("company_id"),
        F.element_at(F.array(F.lit("SMALL"), F.lit("MEDIUM"), F.lit("LARGE")),
                     (F.col("o_custkey") % 3 + 1).cast("int")).alias("company_size"))
