"""Near-duplicate vectors within a label: int8 tile products with per-vector error bounds.

Vectors are scaled to length one, written as ``u = s q + e`` with int8 ``q``, and cut into tiles of about ``TILE`` rows per
label. For every pair of tiles of a label one matrix product of the int8 parts gives ``s1 s2 q1.q2``, which differs from the cosine
by at most ``|e1| |s2 q2| + |s1 q1| |e2| + |e1| |e2|``. Pairs that may reach the threshold by that bound, and no others, are
computed again in double precision from the original values. A task holds two tiles, whatever the size of the label, and returns
link counts and a spanning set of links, not the pairs.

Vectors that are null, zero or hold null or non-finite values, and rows without a label, link with nothing. Equal vectors of a
label are one row of a tile with a multiplicity. Vectors of different lengths never link. Repeated ids: the rows are one
vector whose links are those of all its rows, another id counting once however many rows of it are near, and one row comes back.
Their rows get numbers of their own for the tiles, and tasks also return which classes of equal vectors they meet. A null id: its rows come back without links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisflow.llm.graph import components, local_components
from basisflow.plans.lineage import written

TILE = 2048
_PAIRS = 1 << 16


def usable(vector: str) -> Column:
    """Not null, not zero, and every component a finite number."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scale, the length of the int8 part and the length of the error, for rows scaled to length one."""
    u = x / np.abs(x).max(1, keepdims=True)  # keeps squares of very large or small values finite
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    part = s[:, None] * q
    return q, s, np.sqrt((part * part).sum(1)), np.sqrt(((u - part) ** 2).sum(1))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (rows of x, rows of y) with a cosine of at least ``threshold``; without y the pairs i < j of x."""
    qx, sx, nx, ex = quantise(x)
    qy, sy, ny, ey = (qx, sx, nx, ex) if y is None else quantise(y)
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integer sums stay exact
    left = qx.astype(exact)
    for lo in range(0, len(qy), 512):
        hi = lo + 512
        bound = (left @ qy[lo:hi].astype(exact).T).astype(np.float64)
        bound *= sx[:, None]
        bound *= sy[lo:hi]
        bound += np.outer(ex, ny[lo:hi] + ey[lo:hi])
        bound += np.outer(nx, ey[lo:hi])
        i, j = np.nonzero(bound >= threshold - 1e-9)
        j = j + lo
        if y is None:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), _PAIRS):
            a, b = i[at:at + _PAIRS], j[at:at + _PAIRS]
            near = cosine(x[a], (x if y is None else y)[b]) >= threshold
            yield a[near], b[near]


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rep")
    x = np.stack(rows["v"].to_list()).astype("<f8")
    return pd.DataFrame({"label": rows["label"].iloc[:1], "dim": [x.shape[1]], "tile": rows["tile"].iloc[:1].to_numpy(),
                         "reps": [rows["rep"].to_numpy("<i8").tobytes()], "copies": [rows["copies"].to_numpy("<i8").tobytes()], "flags": [rows["flag"].to_numpy(bool).tobytes()],
                         "x": [x.astype("<f4").tobytes() if (x.astype("<f4") == x).all() else x.tobytes()]})


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def _compare(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids, copies = np.frombuffer(row.reps_a, "<i8"), np.frombuffer(row.copies_a, "<i8")
                flags = np.frombuffer(row.flags_a, bool)
                x, y = _matrix(row.x_a, len(ids), row.dim), None
                if row.a != row.b:
                    more = np.frombuffer(row.reps_b, "<i8")
                    y, ids = _matrix(row.x_b, len(more), row.dim), np.concatenate([ids, more])
                    copies, flags = np.concatenate([copies, np.frombuffer(row.copies_b, "<i8")]), np.concatenate([flags, np.frombuffer(row.flags_b, bool)])
                shift = 0 if y is None else len(x)
                count, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for i, j in tile_links(x, y, threshold):
                    j = j + shift
                    count += np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
                    count += np.bincount(j, weights=copies[i], minlength=len(ids)).astype(np.int64)
                    low = local_components(len(ids), low[i], low[j])[low]
                    told = flags[i] | flags[j]
                    if told.any():
                        a, b = ids[i[told]], ids[j[told]]
                        yield pd.DataFrame({"rep": np.r_[a, b], "n": 0, "to": np.r_[b, a], "pair": True})
                some = np.flatnonzero((count > 0) | (low != np.arange(len(ids))) | np.isin(np.arange(len(ids)), low[low != np.arange(len(ids))]))
                # the smallest id of each local group, so that the links form a star
                least = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(least, low, ids)
                yield pd.DataFrame({"rep": ids[some], "n": count[some], "to": least[low[some]], "pair": False})
    return run


def _found(classes: DataFrame, kind: str, threshold: float, tile: int) -> DataFrame:
    """(rep, n, to, pair) of classes of equal vectors (label, v, rep, copies, flag): link counts and spanning links, and, as ``pair`` rows in both
    directions, every link of a flagged class."""
    sized = classes.withColumn("dim", F.size("v"))
    counts = sized.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    counts = written(counts, "tiles")
    placed = sized.join(counts, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep", "v"), F.col("tiles")).cast("int"))
    packed = written(placed.groupBy("label", "dim", "tile").applyInPandas(
        _pack, f"label {kind}, dim int, tile int, reps binary, copies binary, flags binary, x binary"), "packed")
    # every unordered pair of tiles once; which side is a alternates, so that no tile stands on one side more than on the other
    grid = (counts.select("label", "dim", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("p"))
            .select("label", "dim", "p", F.explode(F.sequence(F.col("p"), F.col("tiles") - 1)).alias("q")))
    even = (F.col("p") + F.col("q")) % 2 == 0
    grid = grid.select("label", "dim", F.when(even, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(even, F.col("q")).otherwise(F.col("p")).alias("b"))
    side = lambda s: packed.select("label", "dim", F.col("tile").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("reps", "copies", "flags", "x")])
    pairs = grid.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
    return written(pairs.drop("label").mapInPandas(_compare(threshold), "rep long, n long, to long, pair boolean"), "found")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label", tile: int = TILE) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept. Columns of other names are ignored."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.col(f"`{label}`").alias("label"))
    good = rows.where(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    kind = vectors.schema[label].dataType.simpleString()
    different = good.groupBy("id").agg(F.count_distinct(F.xxhash64("label", "v")).alias("n")).where("n > 1").select("id")
    # written, so that the numbers of these rows stay
    repeated = written(good.join(different, "id", "left_semi").distinct().withColumn("node", -1 - F.monotonically_increasing_id()), "repeated")
    if repeated.isEmpty():
        linked = _links_of_ids(good, kind, threshold, tile)
    else:
        single = good.join(different, "id", "left_anti").distinct().withColumn("node", F.col("id"))
        linked = _links_of_rows(written(single.unionByName(repeated).withColumn("single", F.col("node") == F.col("id")), "numbered"), kind, threshold, tile)
    out = rows.select("id").distinct().join(linked, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links_of_ids(good: DataFrame, kind: str, threshold: float, tile: int) -> DataFrame:
    """(id, n, component) where each id has one vector."""
    member_key = ["label", "v"]
    classes = good.groupBy(*member_key).agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.lit(False).alias("flag"))
    found = _found(classes, kind, threshold, tile)
    groups = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of_class = classes.join(counted, "rep", "left").select(*member_key, "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    linked = good.join(of_class, member_key).select("id", "rep", "n").distinct()
    return linked.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))


def _links_of_rows(rows: DataFrame, kind: str, threshold: float, tile: int) -> DataFrame:
    """(id, n, component) where ids may have several rows (id, v, label, node, single); ``node`` tells the rows apart.

    Ids with one row are counted per class in the tiles. Ids with several are counted by sets: which of them have a row in a class or a linked one.
    """
    member_key = ["label", "v"]
    classes = written(rows.groupBy(*member_key).agg(F.min("node").alias("rep"), F.count(F.when(F.col("single"), 1)).alias("copies"),
                                                    F.max(~F.col("single")).alias("flag")), "classes")
    found = _found(classes, kind, threshold, tile)
    spanning = found.where("not pair")
    members = rows.select("id", *member_key, "single").join(classes.select(*member_key, "rep"), member_key).select("id", "single", "rep")
    several = members.where("not single").select("id", "rep").distinct()
    hub = several.groupBy("id").agg(F.min("rep").alias("hub"))
    same_id = several.join(hub, "id").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    groups = components(spanning.select(F.col("rep").alias("a"), F.col("to").alias("b")).unionByName(same_id)).withColumnRenamed("node", "rep")
    counted = spanning.groupBy("rep").agg(F.sum("n").alias("n"))
    near = found.where("pair").select("rep", "to").unionByName(classes.where("flag").select("rep", F.col("rep").alias("to"))).distinct()
    # ids with several rows that a class meets
    met = near.join(several.withColumnRenamed("rep", "to"), "to").select("rep", F.col("id").alias("other")).distinct()
    n_met = met.groupBy("rep").agg(F.count("*").alias("met"))
    of_class = classes.join(counted, "rep", "left").join(n_met, "rep", "left").select(
        "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("n"))
    of_single = members.where("single").join(of_class, "rep").select("id", "n")
    reached = several.join(near, "rep").select("id", "to").distinct()
    ones = reached.join(classes.select(F.col("rep").alias("to"), "copies"), "to").groupBy("id").agg(F.sum("copies").alias("ones"))
    others = several.join(met, "rep").select("id", "other").distinct().groupBy("id").agg(F.count("*").alias("others"))
    of_several = ones.join(others, "id").select("id", (F.col("ones") + F.col("others") - 1).alias("n"))
    placed = members.select("id", "rep").join(groups, "rep", "left").select("id", F.coalesce("component", "rep").alias("group")).distinct()
    least = placed.groupBy("group").agg(F.min("id").alias("component"))
    return of_single.unionByName(of_several).join(placed.join(least, "group").select("id", "component"), "id")


def oracle(name: str = "embeddings", threshold: float = 0.93) -> str:
    """The same as DuckDB SQL over all pairs of a label."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {name}),
    ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {threshold}),
    r AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n)
    SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT n AS vec_id, min(c) AS component_id FROM r GROUP BY 1)
    LEFT JOIN (SELECT a AS vec_id, count(DISTINCT b) AS k FROM l GROUP BY 1) USING (vec_id)"""
