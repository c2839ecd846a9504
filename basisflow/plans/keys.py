"""Joins on keys that may be NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL on both sides."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = one if cond is None else cond & one
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
