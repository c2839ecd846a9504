"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (one per combination of levels of the raked columns) are raked: in turn, the weights of each column's
levels are scaled to that column's target shares, until all margins fit. The raked weights add up to the share ``keep`` of all tokens and
none exceeds what its cell has, so raked over natural weight is a probability: a document is kept if its draw, a hash of its key, is
below that of its cell. A topic or source that has too little for its target is kept whole.

Levels without a target (null included) are pooled into one level "other" that keeps its natural share, so the number of
cells is bounded by the target tables, not by the data: they fit on the driver. Targets of levels without a document
are left out and the rest is scaled. Empty texts weigh nothing and go by their cell, or by ``keep`` if the cell has no token.
A null key draws by the text. Repeated rows share their draw. Columns that share a name with an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisflow.llm.common import without

OTHER = "other"
KEEP = 0.5
_DRAWS = 1 << 40


def topic(text: str = "text") -> Column:
    """The format of a text: tables, markup signs, capitals, long or short prose."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n = F.length(t)
    share = lambda chars: n - F.length(F.translate(t, chars, ""))
    return (F.when(share("|") * 40 > n, "table").when(share("#$%&*<>{}") * 20 > n, "markup")
            .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 2 > n, "capitals").when(n >= 4000, "long").otherwise("short"))


def tokens(text: str = "text") -> Column:
    """Words of a text: runs without white space (as many as gaps between them plus one)."""
    t = F.trim(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " +"))).cast("long")


def _level(column: str, targets: dict[str, float]) -> Column:
    c = F.col(f"`{column}`").cast("string")
    return F.when(c.isin(*targets), c).otherwise(F.lit(OTHER))


def rake(natural: np.ndarray, levels: list[np.ndarray], targets: list[np.ndarray], budget: float, rounds: int = 500,
         precision: float = 1e-9) -> np.ndarray:
    """Cell weights with a total of ``budget`` whose margins, one for each column of levels, are in the shares ``targets``.

    No cell gets more than its natural weight: after each scaling it is cut to that, and the next rounds fill up from the others.
    Targets that this makes impossible are met as far as the documents go, and the total stays below the budget by as much.
    """
    w = natural.astype(float) * min(1.0, budget / max(natural.sum(), 1e-300))
    for _ in range(rounds):
        before = w.copy()
        for level, share in zip(levels, targets, strict=True):
            have, goal = np.bincount(level, weights=w, minlength=len(share)), share * budget
            w = np.minimum(w * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[level], natural)
        if np.abs(w - before).max(initial=0) <= precision * budget:
            break
    return w


def cell_rates(docs: DataFrame, targets: dict[str, dict[str, float]], weight: str = "tokens", keep: float = KEEP) -> DataFrame:
    """Raked cells: levels, natural and raked weight, keeping probability. Read once over ``docs``."""
    names = list(targets)
    cells = (docs.select(*[_level(c, targets[c]).alias(f"_l{i}") for i, c in enumerate(names)], F.col(f"`{weight}`").alias("_w"))
             .groupBy(*[f"_l{i}" for i in range(len(names))]).agg(F.sum("_w").alias("w")).orderBy(*[f"_l{i}" for i in range(len(names))]).collect())
    w = np.array([float(r["w"] or 0) for r in cells])
    index, goals = [], []
    for i, c in enumerate(names):
        present = sorted({r[f"_l{i}"] for r in cells})
        at = {p: k for k, p in enumerate(present)}
        index.append(np.array([at[r[f"_l{i}"]] for r in cells], int))
        natural = np.bincount(index[-1], weights=w, minlength=len(present)) if len(cells) else np.zeros(0)
        share = natural[at[OTHER]] / max(w.sum(), 1) if OTHER in at and OTHER not in targets[c] else 0.0
        wanted = np.array([targets[c].get(p, 0.0) * (natural[at[p]] > 0) for p in present])
        wanted = wanted / max(wanted.sum(), 1e-300) * (1 - share)
        if share:
            wanted[at[OTHER]] = share
        goals.append(wanted)
    raked = rake(w, index, goals, keep * w.sum())
    rate = np.divide(raked, w, out=np.full_like(w, keep), where=w > 0)
    rows = [(*[r[f"_l{i}"] for i in range(len(names))], float(a), float(b), float(p))
            for r, a, b, p in zip(cells, w, raked, rate, strict=True)]
    schema = ", ".join([*[f"_l{i} string" for i in range(len(names))], "_natural double", "_raked double", "_keep double"])
    return docs.sparkSession.createDataFrame(rows, schema)


def draw(key: str = "doc_id", text: str = "text", seed: int = 0) -> Column:
    """A number in [0, 1) from the hash of the key, or of the text if the key is null."""
    c = F.coalesce(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"), F.lit(""))
    return F.pmod(F.xxhash64(F.lit(seed), c), F.lit(_DRAWS)) / F.lit(float(_DRAWS))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` with tokens and draw."""
    kept = without(docs, "tokens", "draw")
    return kept.withColumns({"tokens": tokens(text), "draw": draw(key, text, seed)})


def mix(measured: DataFrame, targets: dict[str, dict[str, float]], keep: float = KEEP) -> DataFrame:
    """A measured table with keep_probability and kept. It is read twice: give it written, or narrow."""
    rows = without(measured, "keep_probability", "kept")
    # one row per combination of target levels: its size does not depend on the documents
    rates = F.broadcast(cell_rates(rows, targets, keep=keep))
    # the row travels in one struct: no column of it can clash with a name used here
    marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[_level(c, targets[c]).alias(f"_l{i}") for i, c in enumerate(targets)])
    joined = marked.join(rates, [f"_l{i}" for i in range(len(targets))], "left")
    return joined.select("row.*", F.col("_keep").alias("keep_probability"), (F.col("row.draw") < F.col("_keep")).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]], key: str = "doc_id", text: str = "text", seed: int = 0, keep: float = KEEP,
           derived: dict[str, Column] | None = None) -> DataFrame:
    """The kept rows of ``docs`` with the columns of ``docs``. ``derived``: raked columns that are computed, not in ``docs``."""
    whole = docs.withColumns(derived or {}).withColumn("_whole", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return mix(measure(whole, key, text, seed), targets, keep).where("kept").select("_whole.*")
