"""Line dedup by content-defined chunks.

A text is split at line feeds. A rolling hash over the hashes of the last ``WINDOW`` lines ends a chunk wherever it is divisible by
``DIVISOR``, so boundaries move with the content and not with the position. Chunks of two lines or more that occur in several
documents, or several times in one, are removed but for the first: the smallest key, and in it the first place. Chunks are the
same only if their bytes are: they are grouped by the text itself, and a digest stands for a text only where no other
chunk of the corpus shares it (chunks whose digest is shared by different texts stay).

All of it is DataFrame expressions. Null text: no line, null stays null. Rows that share a key are one document in the order
of keys and each keeps its first copy. A null key comes after all others; rows with a null key do not remove each other's lines.
Columns of the input that share a name with an output are replaced; all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisflow.llm.common import without

WINDOW, DIVISOR = 2, 3
_BASE, _PRIME = 1000003, (1 << 31) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the lambda uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunk_array(text: str, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """array<struct<body, n_lines>> of a text column."""
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    line_hash = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % _PRIME

    def rolled(hashes: Column, i: Column) -> Column:
        value = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            value = (value * _BASE + F.when(i > back, F.get(hashes, i - back - 1)).otherwise(F.lit(0))) % _PRIME
        return value

    def ends(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (rolled(hashes, i) % divisor == 0))

    def cut(all_lines: Column) -> Column:
        return _let(_let(F.transform(all_lines, line_hash), ends), lambda e: F.transform(e, lambda to, j: _piece(all_lines, e, to, j)))

    return _let(lines, cut)


def _piece(lines: Column, ends: Column, to: Column, j: Column) -> Column:
    begin = F.when(j == 0, F.lit(0)).otherwise(F.get(ends, j - 1))
    return F.struct(F.array_join(F.slice(lines, begin + 1, to - begin), "\n").alias("body"), (to - begin).alias("n_lines"))


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """(digest, first) of bodies in several documents. ``chunks``: key, digest, body of multi-line chunks."""
    by_body = chunks.groupBy("digest", "body").agg(F.min("key").alias("first"), F.max("key").alias("last"),
                                                   F.max(F.col("key").isNull()).alias("unkeyed"))
    several = (F.col("first") < F.col("last")) | (F.col("first").isNotNull() & F.col("unkeyed"))
    by_digest = by_body.groupBy("digest").agg(F.count("*").alias("bodies"), F.min("first").alias("first"), F.max(several).alias("several"))
    return by_digest.where("bodies = 1 and several").select("digest", "first")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with the text deduplicated and n_lines, n_removed_lines, n_chunks, n_removed_chunks added."""
    added = ("n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks")
    kept = without(docs, *added)
    cut = docs.select(F.col(f"`{key}`").alias("key"), chunk_array(text, window, divisor).alias("chunks"))
    single = cut.select("key", F.explode("chunks").alias("c")).where("c.n_lines > 1").select("key", F.xxhash64("c.body").alias("digest"), F.col("c.body").alias("body"))
    repeated = repeated_chunks(single)
    marks = (single.select("key", "digest").join(repeated.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"))
             .where("key > first or key is null").groupBy("key").agg(F.collect_set("digest").alias("_marks")))
    # the row travels in one struct: no column of it can clash with a name used here
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), docs[key].alias("key"))
    joined = rows.join(marks.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left").select("row", "_marks", F.col("row")[text].alias("text"))

    def judged(chunks: Column) -> Column:
        bodies = F.transform(chunks, lambda c: c["body"])
        return _let(bodies, lambda b: _let(F.size(F.array_distinct(b)) < F.size(b), lambda twice: F.transform(chunks, lambda c, i: F.struct(
            c["body"].alias("body"), c["n_lines"].alias("n_lines"),
            ((c["n_lines"] > 1) & (F.coalesce(F.array_contains("_marks", F.xxhash64(c["body"])), F.lit(False))
                                   | (twice & (F.array_position(b, c["body"]) <= i)))).alias("gone")))))

    marked = joined.select("row", _let(chunk_array("text", window, divisor), judged).alias("_c"))
    count = lambda chunks: F.coalesce(F.aggregate(chunks, F.lit(0), lambda a, c: a + c["n_lines"]), F.lit(0)).cast("long")
    gone, stay = F.filter("_c", lambda c: c["gone"]), F.filter("_c", lambda c: ~c["gone"])
    lean = F.array_join(F.transform(stay, lambda c: c["body"]), "\n")
    columns = [lean.alias(c) if c == text else F.col(f"row.`{c}`") for c in kept.columns]
    size = lambda x: F.when(x.isNull(), 0).otherwise(F.size(x)).cast("long")
    return marked.select(*columns, count(F.col("_c")).alias("n_lines"), count(gone).alias("n_removed_lines"),
                         size(F.col("_c")).alias("n_chunks"), size(gone).alias("n_removed_chunks"))


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    out = dedup(docs.select(F.col(key), F.col(text)), key, text)
    return out.select(key, "n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks", F.sha2(F.col(text).cast("binary"), 256).alias("kept_sha256"))


def oracle(name: str = "documents") -> str:
    """The summary as DuckDB SQL; chunks are compared as texts."""
    h = f"(('0x' || substr(md5(l[i]), 1, 8))::BIGINT % {_PRIME})"
    before = f"(('0x' || substr(md5(l[i - 1]), 1, 8))::BIGINT % {_PRIME})"
    rolled = f"((CASE WHEN i > 1 THEN {before} ELSE 0 END * {_BASE} + {h}) % {_PRIME})"
    return f"""
    WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {name}),
    e AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR {rolled} % {DIVISOR} = 0) AS e FROM s),
    c AS (SELECT doc_id, l, e, unnest(range(1, len(e) + 1)) AS j FROM e),
    b AS (SELECT doc_id, j, e[j] - coalesce(CASE WHEN j > 1 THEN e[j - 1] END, 0) AS n,
                 array_to_string(l[coalesce(CASE WHEN j > 1 THEN e[j - 1] END, 0) + 1:e[j]], chr(10)) AS body FROM c),
    r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, j) > 1 AS gone FROM b),
    g AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines, count(*) AS n_chunks,
                 count(*) FILTER (gone) AS n_removed_chunks, coalesce(string_agg(body, chr(10) ORDER BY j) FILTER (NOT gone), '') AS lean FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_chunks, 0) AS n_chunks,
           coalesce(n_removed_chunks, 0) AS n_removed_chunks, sha256(lean) AS kept_sha256 FROM {name} d LEFT JOIN g USING (doc_id)"""
