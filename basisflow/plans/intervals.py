"""Points in intervals by equi-joins.

Every half-open interval of whole numbers is cut into dyadic pieces, two per size at most: [node * 2**level, (node + 1) * 2**level). A point lies in one
piece of each size, so it finds all intervals that hold it by equality on (level, node): no range condition reaches the join planner, nothing depends on how
many intervals there are or how long they are, and no list passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sizes that can occur: days reach 2**20 (over 2,800 years), microseconds all of a long
_LEVELS = {"date": 21, "timestamp": 62, "timestamp_ntz": 62, "int": 32, "smallint": 16, "tinyint": 8, "bigint": 62}


def as_number(c: Column, kind: str) -> Column:
    """Whole numbers in the order of a date, timestamp or integer column."""
    if kind == "date":
        return F.unix_date(c).cast("long")
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("long")


def pieces(lo: Column, hi: Column, levels: int) -> Column:
    """array<struct<level, node>> that tiles [lo, hi); empty for an empty or NULL interval."""
    def at(level: Column) -> Column:
        # first and end node of this size that lie wholly inside
        a, b = -F.call_function("shiftright", -lo, level), F.call_function("shiftright", hi, level)
        piece = lambda node: F.struct(level.alias("level"), node.alias("node"))
        inside, odd = a < b, lambda x: F.pmod(x, F.lit(2)) == 1
        return F.array_compact(F.array(F.when(inside & odd(a), piece(a)), F.when(inside & odd(b), piece(b - 1))))

    return F.when(lo < hi, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def points_in_intervals(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``points`` with the columns of every interval [start, end) that holds ``at`` and has the same ``by`` columns.

    The pieces meet the distinct points only; rows then fetch their intervals by equality on the point. NULL points and bounds match nothing.
    """
    kind = dict(points.dtypes)[at]
    levels = _LEVELS[kind]
    number = lambda c: as_number(F.col(c), kind)
    distinct = points.where(F.col(at).isNotNull()).select(*by, at).distinct()
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")
    places = distinct.select(*by, at, level).withColumn("_node", F.call_function("shiftright", number(at), F.col("_level")))
    tiles = intervals.withColumn("_piece", F.explode(pieces(number(start), number(end), levels)))
    tiles = tiles.select(*intervals.columns, F.col("_piece.level").alias("_level"), F.col("_piece.node").alias("_node"))
    held = places.join(tiles, [*by, "_level", "_node"]).select(*by, at, *[c for c in intervals.columns if c not in by])
    return points.join(held, [*by, at])
