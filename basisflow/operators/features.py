"""Feature screening: pairwise correlations, pruning and connected groups on an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basisflow.operators.metrics import average_rank
from basisflow.plans.lineage import cut_lineage

MIN_PAIRS = 30
#: features whose pairs are few enough to be rows
FEW = 40


def feature_pairs(long: DataFrame, key: str = "series_id", value: str = "value") -> DataFrame:
    """Rows (feature_i, feature_j, d, a, b) of the upper triangle on days where both are present.

    Each day keeps its features as one short map, bounded by the number of features, and unfolds the
    pairs locally: one shuffle by day instead of a self-join of the panel.
    """
    x = long.where(F.col(value).isNotNull())
    per_day = x.groupBy("d").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("f"), F.col(value).alias("v")))).alias("fs"))
    left = per_day.select("d", "fs", F.posexplode("fs").alias("i", "l"))
    pair = left.select("d", "l", F.explode(F.slice("fs", F.col("i") + 2, F.greatest(F.size("fs") - F.col("i") - 1, F.lit(0)))).alias("r"))
    return pair.select(F.col("l.f").alias("feature_i"), F.col("r.f").alias("feature_j"), "d",
                       F.col("l.v").alias("a"), F.col("r.v").alias("b"))


def pearson(pairs: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    g = pairs.groupBy("feature_i", "feature_j").agg(
        F.count("*").alias("n"), F.covar_pop("a", "b").alias("_c"), F.stddev_pop("a").alias("_a"),
        F.stddev_pop("b").alias("_b"))
    return g.select("feature_i", "feature_j", "n", F.when(
        F.col("n") >= min_pairs, F.try_divide("_c", F.col("_a") * F.col("_b"))).alias("corr"))


def pearson_panel(long: DataFrame, key: str = "series_id", value: str = "value", min_pairs: int = MIN_PAIRS) -> DataFrame:
    """The same correlations straight from the long panel.

    Up to ``FEW`` features the pairs of each day are unfolded and summed by built-in aggregates on the map side. With more, no row is made for each pair and day:
    Every batch of days is a matrix (days x features, mean-centred, holes as zero); products of it and of its mask give the sums of all
    pairs at once, and only these partial sums, one row per pair and batch, are shuffled.
    """
    x = long.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("f"), "d", F.col(value).cast("double").alias("v"))
    if x.select("f").distinct().limit(FEW + 1).count() <= FEW:
        return pearson(feature_pairs(x, "f", "v"), min_pairs)
    means = x.groupBy("f").agg(F.avg("v").alias("m"))
    days = x.join(means, "f").groupBy("d").agg(F.collect_list(F.struct("f", (F.col("v") - F.col("m")).alias("v"))).alias("fs")).select("fs")
    sums = days.mapInArrow(_pair_sums, "feature_i string, feature_j string, n bigint, sx double, sy double, sxx double, syy double, sxy double")
    g = sums.groupBy("feature_i", "feature_j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    c = F.col
    both = F.sqrt(c("n") * c("sxx") - c("sx") ** 2) * F.sqrt(c("n") * c("syy") - c("sy") ** 2)
    return g.select("feature_i", "feature_j", "n", F.when(c("n") >= min_pairs, F.try_divide(c("n") * c("sxy") - c("sx") * c("sy"), both)).alias("corr"))


def _pair_sums(batches):
    for batch in batches:
        inner = batch.column("fs").flatten()
        if not len(inner):
            continue
        names, column = np.unique(inner.field("f").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        day = np.repeat(np.arange(len(batch)), np.diff(batch.column("fs").offsets.to_numpy()))
        x, there = np.zeros((len(batch), len(names))), np.zeros((len(batch), len(names)))
        x[day, column], there[day, column] = inner.field("v").to_numpy(), 1.0
        n, sx, sxx, sxy = there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
        i, j = np.nonzero(np.triu(n, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[i].tolist(), pa.string()), pa.array(names[j].tolist(), pa.string()), pa.array(n[i, j].astype(np.int64)),
             *[pa.array(v) for v in (sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j])]],
            ["feature_i", "feature_j", "n", "sx", "sy", "sxx", "syy", "sxy"])


def spearman(pairs: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Pearson of the average ranks, ranked anew on the complete rows of each pair (bounded by days)."""
    keys = ["feature_i", "feature_j"]
    r = pairs.withColumns({"ra": average_rank("a", keys), "rb": average_rank("b", keys)})
    return pearson(r.select(*keys, "d", F.col("ra").alias("a"), F.col("rb").alias("b")), min_pairs)


def top_pairs(corr: DataFrame, k: int = 25, abs_min: float = 0.7) -> DataFrame:
    c = corr.withColumn("abs_corr", F.abs("corr")).where(F.col("abs_corr") >= abs_min)
    return c.orderBy(F.desc("abs_corr"), "feature_i", "feature_j").limit(k)


def edges(corr: DataFrame, abs_min: float) -> DataFrame:
    """Both directions of each strong pair."""
    e = corr.where(F.abs("corr") >= abs_min).select("feature_i", "feature_j", "corr")
    return e.unionByName(e.select(F.col("feature_j").alias("feature_i"), F.col("feature_i").alias("feature_j"), "corr"))


def connected_groups(edge: DataFrame) -> DataFrame:
    """Groups (group_id, size, feature) of features linked by strong pairs.

    Each round takes the smallest label among neighbours and then the label's own label, which
    halves the remaining distance; rounds are cut by reliable checkpoints.
    """
    e = cut_lineage(edge.select("feature_i", "feature_j").distinct())
    lab = cut_lineage(e.select(F.col("feature_i").alias("f")).distinct().withColumn("label", F.col("f")))
    while True:
        near = (e.join(lab.select(F.col("f").alias("feature_j"), F.col("label").alias("nl")), "feature_j")
                .groupBy(F.col("feature_i").alias("f")).agg(F.min("nl").alias("nl")))
        step = lab.join(near, "f", "left").select("f", "label", F.least("label", "nl").alias("new"))
        jump = step.select(F.col("f").alias("new"), F.col("new").alias("far"))
        nxt = cut_lineage(step.join(jump, "new", "left").select(
            "f", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("moved")))
        lab = nxt.select("f", "label")
        if nxt.where("moved").isEmpty():
            break
    size = lab.groupBy("label").agg(F.count("*").alias("group_size")).where(F.col("group_size") >= 2)
    order = Window.orderBy(F.desc("group_size"), "label")
    ids = size.withColumn("group_id", F.row_number().over(order))
    return lab.join(ids, "label").select("group_id", "group_size", F.col("f").alias("feature"))


def greedy_prune(edge: DataFrame, priority: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep features in priority order, dropping those strongly tied to a kept one.

    Same answer as the sequential walk, in rounds: a node without an undecided better neighbour is
    kept, its neighbours are dropped, until none is undecided. Returns (kept, dropped with keeper).
    """
    rank = priority.select("feature", F.struct(-F.col("priority"), F.col("feature")).alias("r"))
    e = (edge.join(rank.withColumnsRenamed({"feature": "feature_i", "r": "ri"}), "feature_i")
         .join(rank.withColumnsRenamed({"feature": "feature_j", "r": "rj"}), "feature_j")
         .where(F.col("rj") < F.col("ri")).select("feature_i", "feature_j", "corr", "rj"))
    e = cut_lineage(e)
    state = cut_lineage(priority.select("feature", F.lit(None).cast("boolean").alias("kept")))
    while True:
        better = e.join(state.select(F.col("feature").alias("feature_j"), F.col("kept").alias("kj")), "feature_j")
        seen = better.groupBy(F.col("feature_i").alias("feature")).agg(
            F.max(F.coalesce("kj", F.lit(False))).alias("near_kept"), F.max(F.col("kj").isNull()).alias("open"))
        nxt = state.join(seen, "feature", "left").select("feature", F.when(F.col("kept").isNotNull(), F.col("kept"))
                         .when(F.coalesce("near_kept", F.lit(False)), F.lit(False))
                         .when(~F.coalesce("open", F.lit(False)), F.lit(True)).alias("kept"))
        state = cut_lineage(nxt)
        if state.where(F.col("kept").isNull()).isEmpty():
            break
    kept = state.where("kept").select("feature")
    why = (e.join(kept.withColumnRenamed("feature", "feature_j"), "feature_j", "left_semi")
           .groupBy(F.col("feature_i").alias("feature"))
           .agg(F.min_by(F.struct(F.col("feature_j").alias("kept_feature"), "corr"), "rj").alias("w")))
    dropped = state.where(~F.col("kept")).join(why, "feature").select(
        "feature", "w.kept_feature", "w.corr", F.abs("w.corr").alias("abs_corr"))
    return kept, dropped


def coverage_filter(cov: DataFrame, min_coverage: float, keep: list[str], pattern: str | None = None,
                    key: str = "series_id") -> DataFrame:
    """Features covered well enough, asked to stay, or whose whole name matches the pattern."""
    ok = (1 - F.col("missing_pct") >= min_coverage) | F.col(key).isin(*keep)
    if pattern:
        ok = ok | F.col(key).rlike(f"^({pattern})$")
    return cov.where(ok).select(key)


def feature_pack(df: DataFrame, selected: list[str] | None, forced: list[str], default: list[str], teachers: list[str]) -> DataFrame:
    """Day, teacher column and features: the selected list (else the default one) plus the forced
    basics, and the first teacher candidate that exists, renamed."""
    feats = list(dict.fromkeys([*(selected or default), *forced]))
    teacher = next((t for t in teachers if t in df.columns), None)
    cols = [F.col("d")] + ([F.col(teacher).alias("teacher")] if teacher else [])
    return df.select(*cols, *[F.col(f"`{c}`") for c in feats if c in df.columns])
