"""Named queries: a DataFrame builder, an output shape and, where SQL can say it, an oracle.

The shape is one string such as ``"exposure_id:s d:d n:i net:f4 var:g"``. It fixes names, types and
rounding on both sides, so that a Spark result and a SQL result compare by value:
s text, d day as text, i whole number, fN rounded to N decimals, g rounded to 9 significant digits,
r to 6 (long running sums).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisflow.queries.sqlbase import with_

_SNAP = {"g": 1e-11, "r": 1e-9}
_DIGITS = {"g": 8, "r": 5}
# moves exact decimal ties off the tie, since the two engines break them differently
_NUDGE = 1.000000000002

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _parse(shape: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in shape.split()]


def _spark_col(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind in ("s", "d"):
        return c.cast("string").alias(name)
    if kind == "i":
        return c.cast("long").alias(name)
    x = c.cast("double")
    if kind in _SNAP:
        text = F.format_string(f"%.{_DIGITS[kind]}e", x * _NUDGE)
        return (F.when(x.isNull() | F.isnan(x), None).when(F.abs(x) < _SNAP[kind], 0.0)
                .otherwise(text.cast("double"))).alias(name)
    return F.when(~F.isnan(x), F.round(x, int(kind[1:])) + F.lit(0.0)).alias(name)


def _sql_col(name: str, kind: str) -> str:
    if kind in ("s", "d"):
        return f'CAST("{name}" AS VARCHAR) AS "{name}"'
    if kind == "i":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    x = f'CAST("{name}" AS DOUBLE)'
    if kind in _SNAP:
        return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN abs({x}) < {_SNAP[kind]} THEN 0.0 "
                f"ELSE CAST(printf('%.{_DIGITS[kind]}e', {x} * {_NUDGE}::DOUBLE) AS DOUBLE) END AS \"{name}\"")
    return f'CASE WHEN isnan({x}) THEN NULL ELSE round({x}, {int(kind[1:])}) + 0.0 END AS "{name}"'


def query(name: str, shape: str, sql: str | None = None, ctes: str = "", where_full: bool = False):
    """Register a builder; ``sql`` may use the shared table expressions named in ``ctes``."""
    cols = _parse(shape)

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_col(n, k) for n, k in cols])
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            picks = ", ".join(_sql_col(n, k) for n, k in cols)
            ORACLES[name] = f"{with_(ctes)} SELECT {picks} FROM ({sql}) AS t"
        return fn
    return wrap
