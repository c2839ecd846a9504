"""Recursions over one long series in parallel.

A series is cut into chunks of consecutive rows that different tasks hold. Where the effect of a chunk on the state can be summed up without knowing the state (maps that compose,
such as v -> max(a v + b, c)), three passes do: each chunk gives its summary, the few summaries of a series are run
through in order to get the state at each chunk's start, and each chunk replays its rows from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basisflow.plans.keys import _join_keys
from basisflow.plans.lineage import written
from basisflow.plans.ordered import sub_buckets

CHUNK_ROWS = 100_000
Columns = dict[str, np.ndarray]


@dataclass(frozen=True)
class Recursion:
    """``summarise`` gives a vector of any fixed length, ``advance`` applies it to a state, ``replay`` gives the outputs of a chunk's rows."""
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    summarise: Callable[[Columns], np.ndarray]
    advance: Callable[[np.ndarray, np.ndarray], np.ndarray]
    replay: Callable[[np.ndarray, Columns], Columns]


def affine(inputs: tuple[str, ...], maps: Callable[[Columns], tuple[np.ndarray, np.ndarray]], floor: np.ndarray,
           outputs: Callable[[np.ndarray, Columns], Columns], names: tuple[str, ...]) -> Recursion:
    """State vectors with s' = max(a s + b, floor), a >= 0; ``maps`` gives a and b, a row per day. Outputs are made from the states before each row.

    Two such maps compose to one: max(a (A s + B), ...) = max(a A s + a B + b, max(a C + b, floor)).
    """
    floor = np.asarray(floor, float)
    m = len(floor)

    def summarise(x: Columns) -> np.ndarray:
        a, b = maps(x)
        whole = np.array([np.ones(m), np.zeros(m), np.full(m, -np.inf)])
        for t in range(len(b)):
            whole *= a[t]
            whole[1] += b[t]
            whole[2] = np.maximum(whole[2] + b[t], floor)
        return whole.ravel()

    def advance(state: np.ndarray, s: np.ndarray) -> np.ndarray:
        a, b, c = s.reshape(3, m)
        return np.maximum(a * state + b, c)

    def replay(state: np.ndarray, x: Columns) -> Columns:
        a, b = maps(x)
        states = np.empty((len(b), m))
        for t in range(len(b)):
            states[t] = state
            state = np.maximum(a[t] * state + b[t], floor)
        return outputs(states, x)

    return Recursion(inputs, names, summarise, advance, replay)


def _ordered(pdf: pd.DataFrame, order: str, columns: tuple[str, ...]) -> tuple[pd.DataFrame, Columns]:
    pdf = pdf.sort_values(order)
    return pdf, {c: pdf[c].to_numpy(dtype=float) for c in columns}


def in_chunks(df: DataFrame, key: str, order: str, recursion: Recursion, start: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, order, outputs...) of every row. ``start``: key and ``state``, an array of doubles, of every series.

    Chunk bounds are approximate quantiles of the order column; rows of equal order share a chunk. A series has as many chunks as the longest one needs.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    longest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    wide = df.select(key, order, *recursion.inputs)
    wide = wide.withColumn("_at", F.unix_date(order) if types[order] == "date" else F.col(order))
    # written, since a recomputed quantile could cut elsewhere
    cut = written(sub_buckets(wide, [key], "_at", "_chunk", max(2, -(-longest // rows)), least=0).drop("_at"), "chunks")

    def summarise(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        _, x = _ordered(pdf, order, recursion.inputs)
        return pd.DataFrame({key: [group[0]], "_chunk": [group[1]], "_sum": [recursion.summarise(x)]})

    def advance(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        state, states = np.asarray(pdf["state"].iloc[0], float), []
        for s in pdf["_sum"]:
            states.append(state)
            state = recursion.advance(state, np.asarray(s, float))
        return pd.DataFrame({key: pdf[key].to_numpy(), "_chunk": pdf["_chunk"].to_numpy(), "state": states})

    def replay(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _ordered(pdf, order, recursion.inputs)
        out = pd.DataFrame({key: pdf[key].to_numpy(), order: pdf[order].to_numpy()})
        got = recursion.replay(np.asarray(state["state"].iloc[0], float), x) if len(pdf) else {}
        for c in recursion.outputs:
            out[c] = got.get(c, np.zeros(0))
        return out

    name = f"`{key}` {types[key]}"
    sums = cut.groupBy(key, "_chunk").applyInPandas(summarise, f"{name}, _chunk int, _sum array<double>")
    states = written(_join_keys(sums, start, [key], "inner").groupBy(key).applyInPandas(advance, f"{name}, _chunk int, state array<double>"), "states")
    schema = f"{name}, `{order}` {types[order]}, " + ", ".join(f"`{c}` double" for c in recursion.outputs)
    return cut.groupBy(key, "_chunk").cogroup(states.groupBy(key, "_chunk")).applyInPandas(replay, schema)
