"""Small document tables with the awkward rows, and plain versions of the operators."""

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(seed=1, n=60):
    """(doc_id, text) with near and exact copies, shared passages, blank, null, long and non-ASCII texts, null and repeated ids."""
    r = random.Random(seed)
    words = ["wa", "tio", "über", "ened", "le", "čas", "no", "Der", "quo", "élan", "x1", "the", "of"]
    passage = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(60))
    out = []
    for i in range(n):
        lines = [" ".join(r.choice(words) + str(r.randrange(99)) for _ in range(r.randrange(3, 25))) for _ in range(r.randrange(1, 9))]
        if i % 5 == 0:
            lines.insert(r.randrange(len(lines) + 1), passage)
        if i % 7 == 0:
            lines[1:1] = ["shared one two three four five six", "shared two three four", "shared three four five six seven"]
        out.append([i, "\n".join(lines)])
    for i in range(n, n + 12):  # near copies and exact copies
        text = out[i % 6][1].split(" ")
        if i % 3:
            text[r.randrange(len(text))] = f"edit{i}"
        out.append([i, " ".join(text)])
    out += [[n + 20, None], [n + 21, ""], [n + 22, " \n\t "], [n + 23, "one two"], [n + 24, "One  TWO"], [n + 25, "ſ K İ ẞ"],
            [n + 26, "rep rep rep rep rep rep rep rep " * 40], [n + 27, "\n".join(out[0][1] for _ in range(60))], [None, out[0][1]], [None, "null id text of its own kind here"],
            [3, out[3][1]], [4, out[9][1]]]
    return [tuple(x) for x in out]


def documents(spark, data=None):
    data = rows() if data is None else data
    langs = ["en", "fr", None]
    return spark.createDataFrame([(i, t, langs[k % 3], f"src{k % 4}", None if t is None else len(t)) for k, (i, t) in enumerate(data)], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UP))
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + words]) for k in range(len(w) - words + 1))


def groups(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}
