"""Prefix trie of conversations by truncation peeling.

A node of depth d stands for all conversations that start with the same d turns (role and text). Starting at the greatest depth, each round merges the
conversations that end there with the nodes that survive from the round before, gives out the merged nodes with their counts, strips the last
turn and groups again: nodes are discovered and their subtrees added up in the same pass, one round per level, each round a written table.

A prefix is known by 128 bits: two running exclusive-ors over hashes of (turn digest, place), so windows stream and no text is shuffled, only
SHA-256 digests. Equal conversations are one sequence before the first round. Probes at depths 1, 2, 4, ... tell how deep a sequence shares its path with
others; what lies below the first probe that it passes alone is a chain whose nodes come from one window, so the number of rounds
follows the depth that different conversations share, not the longest conversation.

Hot nodes: a round combines on the map side, so a node that half of all conversations pass sends one row per task. The ids that end at a node are
joined to texts in ranges of ``RANGE`` ids, at most as many ids each, and those texts pass one after the other through a digest that keeps its
state: no list of members exists anywhere. Turns of one conversation are ordered by a window that spills.

Edge cases. Null role or text is the empty string. Turns are ordered by turn, null first, ties by digest; repeated rows are repeated turns. Rows with a null
conversation id belong to no conversation and are left out. A conversation whose rebuilt form has no turn ends at the root. Copies
are counted as members. Empty table: no node. Columns other than the four named ones are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basisflow.plans.lineage import checkpoint_folder, written

#: ids in one text of a member list
RANGE = 1 << 16
#: fixed values of the rebuilt conversations: those that share a beginning, and the modulus of how many turns they share
FAMILY, HEADS = 100, 6
_NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(table: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, size): turns in order, their digest and the code points of their text."""
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(part(role)).cast("string"), F.lit(":"), part(role), part(text)).cast("binary"), 256)
    turns = table.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                                                             digest.alias("digest"), F.length(part(text)).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return turns.select("conv_id", F.row_number().over(order).alias("pos"), "digest", "size")


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, digest, size) in which each conversation starts with the first turns of its family's first one."""
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.where((F.col("conv_id") == first) & (F.col("pos") < HEADS)).withColumnsRenamed({"conv_id": "head", "pos": "head_pos"})
    wanted = ids.select("conv_id", first.alias("head"), shared.alias("shared")).where("shared > 0")
    begun = wanted.join(heads, "head").where("head_pos <= shared").select("conv_id", F.lit(0).alias("own"), F.col("head_pos").alias("pos"), "digest", "size")
    rest = turns.where(F.col("pos") > shared).select("conv_id", F.lit(1).alias("own"), "pos", "digest", "size")
    order = Window.partitionBy("conv_id").orderBy("own", "pos")
    return begun.unionByName(rest).select("conv_id", F.row_number().over(order).alias("pos"), "digest", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, size): the name of each prefix and the code points of its last text."""
    running = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    names = [F.bit_xor(F.xxhash64("digest", "pos", F.lit(i))).over(running).alias(f"k{i}") for i in (1, 2)]
    return turns.select("conv_id", F.col("pos").alias("depth"), *names, "size")


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, k1, k2, range, ids, n, least) sorted by the first four: one row per sequence."""
    now, state, n, least = None, None, 0, 0
    out: list[list] = [[], [], [], [], [], []]

    def close() -> None:
        for column, value in zip(out, (*now, n, least, state.hexdigest()), strict=True):
            column.append(value)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.int64()) for c in out[1:5]], pa.array(out[5], pa.string())],
                                          ["depth", "k1", "k2", "n", "conv_id", "ends"])
        for column in out:
            column.clear()
        return made

    for rows in batches:
        for depth, k1, k2, ids, count, first in zip(*[rows.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)], strict=True):
            if (depth, k1, k2) != now:
                if now is not None:
                    close()
                now, state, n, least = (depth, k1, k2), hashlib.sha256(), 0, first
            else:
                state.update(b",")
            state.update(ids.encode())
            n, least = n + count, min(least, first)
        if out[0]:
            yield batch()
    if now is not None:
        close()
        yield batch()


def sequences(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, n, conv_id, ends) of each distinct conversation. ``ends``: conv_id, depth, k1, k2 of each conversation."""
    name = ["depth", "k1", "k2"]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = (ends.groupBy(*name, F.floor(F.col("conv_id") / RANGE).alias("range"))
              .agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("least")))
    sorted_ranges = ranges.repartition(*name).sortWithinPartitions(*name, "range")
    return sorted_ranges.mapInArrow(_digest_lists, "depth int, k1 long, k2 long, n long, conv_id long, ends string")


def _alone(paths: DataFrame) -> DataFrame:
    """(conv_id, split): the first probed depth that no other sequence shares. ``paths``: prefixes of one conversation per sequence."""
    probes = paths.where(F.bit_count("depth") == 1).groupBy("depth", "k1", "k2").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return probes.where("n = 1").groupBy("conv_id").agg(F.min("depth").alias("split"))


def _split(table: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chains below the probes, as finished nodes, and what enters the rounds: one row per sequence at the depth where it does."""
    splits = table.join(_alone(paths), "conv_id", "left").select(
        "conv_id", "n", "ends", F.col("depth").alias("last"), F.coalesce("split", "depth").alias("split"))
    rows = paths.join(splits, "conv_id")
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.withColumn("saved", F.sum((F.col("n") - 1) * F.col("size")).over(below)), "paths")
    ended = F.col("depth") == F.col("last")
    chains = rows.where("depth > split").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(ended, F.col("ends")).otherwise(_NOTHING).alias("ends_sha256"))
    # a path is as long as twice what its sequence shares with another one
    path = F.array_sort(F.collect_list(F.when(F.col("depth") <= F.col("split"), F.struct("depth", "k1", "k2", "size"))))
    taken = rows.where("depth <= split + 1").groupBy("conv_id").agg(path.alias("path"), F.max(F.when(F.col("depth") == F.col("split") + 1, F.col("saved"))).alias("saved"))
    child = F.col("split") < F.col("last")
    empty = F.array().cast("array<struct<depth:int,k1:bigint,k2:bigint,size:bigint>>")
    entries = splits.join(taken, "conv_id", "left").select(
        F.col("split").alias("depth"), F.coalesce("path", empty).alias("path"), "conv_id", "n", child.cast("long").alias("child"), child.cast("long").alias("leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved"), F.when(~child, F.col("ends")).alias("ends"))
    return chains, entries


def _merge(rows: DataFrame, d: int) -> DataFrame:
    """Nodes of depth d from the sequences that end there and the stripped nodes below."""
    last = F.get("path", F.lit(d - 1)) if d else F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("size"))
    node = rows.withColumn("last", last).groupBy(F.col("last.k1").alias("k1"), F.col("last.k2").alias("k2")).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("child").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("last.size").alias("size"), F.max("ends").alias("ends"), F.first("path").alias("path"))
    return node.select("k1", "k2", "conv_id", "n", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("leaves"),
                       (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"), "ends", "path")


def _strip(nodes: DataFrame, d: int) -> DataFrame:
    """Nodes of depth d as rows of the next round."""
    return nodes.select(F.slice("path", 1, d - 1).alias("path"), "conv_id", "n", F.lit(1).cast("long").alias("child"), "leaves", "saved",
                        F.lit(None).cast("string").alias("ends"))


def peel(entries: DataFrame) -> DataFrame:
    """Nodes (depth, k1, k2, p1, p2, conv_id, n, children, leaves, saved, ends) of all levels; p1 and p2 name the parent."""
    spark = entries.sparkSession
    folder = f"{checkpoint_folder(spark)}/peeled-{uuid.uuid4().hex}"
    entries.repartition("depth", "conv_id").write.partitionBy("depth").parquet(f"{folder}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{folder}/entries")
    deepest = entries.agg(F.max("depth")).first()[0]
    if deepest is None:
        return entries.select("depth", *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "p1", "p2")], "conv_id", "n", F.col("child").alias("children"),
                              "leaves", "saved", "ends")
    stripped = None
    for d in range(deepest, -1, -1):
        rows = entries.where(F.col("depth") == d).drop("depth")
        if stripped is not None:
            rows = rows.unionByName(stripped)
        nodes = _merge(rows, d)
        nodes.write.parquet(f"{folder}/nodes/depth={d}")
        nodes = spark.read.schema(nodes.schema).parquet(f"{folder}/nodes/depth={d}")
        stripped = _strip(nodes, d)
    above = F.get("path", F.col("depth") - 2)
    zero = F.lit(0).cast("long")
    everything = spark.read.schema(nodes.withColumn("depth", F.lit(0)).schema).parquet(f"{folder}/nodes")
    return everything.select("depth", "k1", "k2", F.coalesce(above["k1"], zero).alias("p1"), F.coalesce(above["k2"], zero).alias("p2"),
                             "conv_id", "n", "children", "leaves", "saved", "ends")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node. ``turns``: conv_id, pos, digest, size; ``ids``: every conversation, also those without a turn."""
    paths = written(prefixes(turns), "prefixes")
    last = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by(F.struct("k1", "k2"), "depth").alias("k"))
    zero = F.lit(0)
    ends = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("depth", zero).alias("depth"), F.coalesce("k.k1", zero.cast("long")).alias("k1"),
                                                    F.coalesce("k.k2", zero.cast("long")).alias("k2"))
    table = written(sequences(ends), "sequences")
    chains, entries = _split(table, paths.join(table.select("conv_id"), "conv_id", "left_semi"))
    nodes = peel(entries)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    peeled = nodes.join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"))
    return peeled.unionByName(chains).withColumn("depth", F.col("depth").cast("long"))


def conversation_trie(table: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    turns = written(numbered_turns(table), "turns")
    ids = written(turns.select("conv_id").distinct(), "ids")
    return trie(rebuilt(turns, ids), ids)


def oracle(name: str = "conversations") -> str:
    """The same as DuckDB SQL: all prefixes of all conversations, every node with all its ancestors."""
    return f"""
    WITH bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                  FROM range(256) t(i)),
    tab AS (SELECT list(c ORDER BY i) AS tab FROM bits),
    g AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS size
          FROM {name} WHERE conv_id IS NOT NULL),
    t AS (SELECT conv_id, g, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM g),
    i AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS x FROM t),
    c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS head, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
                 list_transform(range(1, length(x) + 1), lambda k: ord(x[k])::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % {HEADS} AS h FROM i, tab),
    r AS (SELECT c.conv_id, 0 AS own, pos, g, size FROM c JOIN t ON t.conv_id = head AND pos <= h
          UNION ALL SELECT c.conv_id, 1, pos, g, size FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM r),
    p AS (SELECT conv_id, depth, md5(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, size FROM o UNION ALL SELECT conv_id, 0, '', 0 FROM i),
    e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
    n AS (SELECT p.depth, key, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
                 sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (e.depth = p.depth), '')) AS ends_sha256
          FROM p JOIN e USING (conv_id) GROUP BY p.depth, key),
    a AS (SELECT n.depth, n.key, n.n_convs, n.size, p.depth AS up_depth, p.key AS up FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
    k AS (SELECT up_depth AS depth, up AS key, count(*) AS n_children FROM a WHERE up_depth = depth - 1 GROUP BY ALL),
    s AS (SELECT up_depth AS depth, up AS key, sum((n_convs - 1) * size) AS saved, count(*) FILTER (k.key IS NULL) AS leaves
          FROM a LEFT JOIN k ON k.depth = a.depth AND k.key = a.key GROUP BY ALL)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
    FROM n JOIN s ON s.depth = n.depth AND s.key = n.key LEFT JOIN k ON k.depth = n.depth AND k.key = n.key
    LEFT JOIN a ON a.depth = n.depth AND a.key = n.key AND a.up_depth = n.depth - 1 LEFT JOIN n u ON u.depth = a.up_depth AND u.key = a.up"""
