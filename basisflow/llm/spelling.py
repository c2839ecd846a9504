"""Spelling variants grouped by one-edit neighbourhoods over a reduced alphabet.

Words are counted over all whole texts. Every letter of a vocabulary word is hashed to one of ``SYMBOLS`` symbols. If two words
differ by one edit, their reduced words are equal or differ by one edit too, so the full one-edit neighbourhood of each reduced word,
itself included, is generated (about ``2 * SYMBOLS * length`` keys instead of nearly 200 times the length with all letters) and joined with the
reduced vocabulary; an edit distance on the original words decides. Keys are 64-bit values of reduced words: two that share
one only make a pair more to verify.

Both sides of the join are plain rows that a sort-merge join streams, so a key that many words share needs no memory of its own and adaptive
execution can split it. A form has at least ``RATIO`` times the count of its word, so following forms ends after at most
``log(largest count) / log(RATIO)`` steps; pointers are doubled, each round is a written table.

Edge cases. Null text: no words; null key: the empty string before the colon of the hash. Repeated rows and rows that share a key count each.
Case is folded for A-Z only. Runs of any length are words; the neighbourhood of a very long one is made piece by piece. Ties between forms of
equal count go to the smaller word in code-point order. No word frequent enough, or no rows at all: an empty table. Columns
other than key and text are not read, so their names do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basisflow.plans.lineage import written

SYMBOLS = 6
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: one occurrence group (document, word) in this many loses a letter
MISSPELT = 199
_RUN = re.compile(rb"[A-Za-z\xC0-\xFF]+")
_GAP = re.compile(rb"[^A-Za-z\xC0-\xFF]")
_PIECE, _FLUSH, _CELLS = 1 << 20, 1 << 17, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> Counter:
    """Runs of letters, one byte per code point, with A-Z in lower case, and how often each occurs."""
    data = text.encode("latin-1", "replace").lower()  # what is no Latin-1 letter becomes a question mark; bytes fold A-Z only
    found: Counter = Counter()
    at = 0
    while at < len(data):  # a long text is cut behind a run
        gap = _GAP.search(data, at + _PIECE)
        end = gap.start() if gap else len(data)
        found.update(_RUN.findall(data, at, end))
        at = end
    return found


def misspelt(run: bytes, seed: int) -> bytes:
    """The run, or the run without one letter, by the hash of key and run. ``seed`` is the hash of the key and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % MISSPELT:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not text.is_valid:
                continue
            seed = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in words_of(text.as_py()).items():
                word = misspelt(run, seed)
                if len(word) >= least:
                    total[word] += n
            if len(total) > _FLUSH:
                yield flush()
    if total:
        yield flush()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counts = docs.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).mapInArrow(lambda b: _count(b, LEAST_LENGTH), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def reduced(words: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Symbols 1..``symbols`` of a matrix of code points."""
    x = words.astype(np.uint32) * np.uint32(2654435761)
    return ((x >> np.uint32(16)) % np.uint32(symbols)).astype(np.uint64) + np.uint64(1)


def _heads(s: np.ndarray) -> np.ndarray:
    """Polynomial value of the first i symbols of each row, i from 0."""
    out = np.zeros((len(s), s.shape[1] + 1), np.uint64)
    for i in range(s.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + s[:, i]
    return out


def neighbourhood(s: np.ndarray, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) blocks of every reduced word itself and of all that one edit makes of it, none twice.

    A symbol is deleted only at the end of a run of equal ones and inserted only behind a different one: other places give the same words.
    """
    m, n = s.shape
    power = np.cumprod(np.r_[np.uint64(1), np.full(n + 1, _BASE, np.uint64)])  # power[i] = BASE ** i
    heads = _heads(s)
    tails = heads[:, -1:] - heads * power[n - np.arange(n + 1)]  # value of the symbols from i on
    rows = np.arange(m)
    yield rows, heads[:, -1]
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    step = max(1, _CELLS // (m * symbols))
    for lo in range(0, n + 1, step):
        at = np.arange(lo, min(lo + step, n + 1))  # insertions before place i, n included
        before = np.where(at > 0, s[:, at - 1], np.uint64(0))
        keys = (heads[:, at, None] * _BASE + letters) * power[n - at][None, :, None] + tails[:, at, None]
        fresh = before[:, :, None] != letters
        yield rows[np.nonzero(fresh)[0]], keys[fresh]
        at = at[at < n]
        if not len(at):
            continue
        keys = heads[:, -1][:, None, None] + (letters - s[:, at, None]) * power[n - 1 - at][None, :, None]
        other = s[:, at, None] != letters
        yield rows[np.nonzero(other)[0]], keys[other]
        after = np.where(at + 1 < n, s[:, np.minimum(at + 1, n - 1)], np.uint64(0))
        keys = heads[:, at] * power[n - 1 - at] + tails[:, at + 1]
        last = s[:, at] != after
        yield rows[np.nonzero(last)[0]], keys[last]


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, symbols) of equal length, in blocks whose neighbourhoods fit."""
    for batch in batches:
        words = batch.column(0)
        raw = [w.encode("latin-1") for w in words.to_pylist()]
        size = np.array([len(w) for w in raw])
        for n in np.unique(size):
            where = np.flatnonzero(size == n)
            step = max(1, _CELLS // (int(n) * SYMBOLS))
            for lo in range(0, len(where), step):
                some = where[lo:lo + step]
                matrix = np.frombuffer(b"".join(raw[i] for i in some), np.uint8).reshape(len(some), n)
                yield words.take(pa.array(some)), reduced(matrix)


def _neighbour_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, s in _by_length(batches):
        for row, keys in neighbourhood(s):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), words.take(pa.array(row))], ["key", "word"])


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, s in _by_length(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_heads(s)[:, -1].view(np.int64)), words], ["key", "other"])


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, other) of all words of ``vocab`` (word, n) that one edit turns into each other, in both directions, once each."""
    words = vocab.select("word")
    around = words.mapInArrow(_neighbour_rows, "key long, word string")
    own = words.mapInArrow(_own_rows, "key long, other string")
    one_edit = (F.col("word") != F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    # different edits lead to different reduced words, so no pair comes twice but for keys that collide
    return around.join(own, "key").where(one_edit).select("word", "other").distinct()


def forms(vocab: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near): the near word of largest count, if it has at least RATIO times the word's."""
    counts = vocab.withColumnsRenamed({"word": "other", "n": "other_n"})
    near = near_words(vocab).join(counts, "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), F.col("other"))).alias("best"))
    wide = vocab.join(best, "word", "left")
    fits = -F.col("best.least") >= RATIO * F.col("n")
    return wide.select("word", "n", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.least")).alias("form_n"),
                       F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def roots(table: DataFrame) -> DataFrame:
    """``table`` (word, form, ...) with ``root``: the word that following forms ends at."""
    up = written(table.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = written(up.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        if not up.where("moved").limit(1).count():
            return table.join(up.select("word", "root"), "word")
        up = up.select("word", "root")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every vocabulary word of the texts."""
    vocab = written(vocabulary(docs, key, text), "vocabulary")
    return roots(written(forms(vocab), "forms")).select("word", "form", "root", "n", "n_near", "form_n")


def oracle(name: str = "documents") -> str:
    """The same as DuckDB SQL: every word with every letter taken out, compared as text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                            FROM range(256) t(i)),
    tab AS (SELECT list(c ORDER BY i) AS tab FROM bits),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-zÀ-ÿ]+')) AS run FROM {name}),
    r AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
    k AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM r),
    h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
                 lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM k, tab),
    w AS (SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM h),
    v AS (SELECT word, sum(n)::BIGINT AS n FROM w GROUP BY word HAVING sum(n) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
    d AS (SELECT word, n, i, substr(word, 1, i::BIGINT) || substr(word, (i + 2)::BIGINT) AS rest FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
    p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
    q AS (SELECT p.word, p.other, v.n, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.other) AS k, count(*) OVER (PARTITION BY p.word) AS n_near
          FROM p JOIN v ON v.word = p.other),
    f AS (SELECT v.word, v.n, CASE WHEN q.n >= {RATIO} * v.n THEN other END AS form, CASE WHEN q.n >= {RATIO} * v.n THEN q.n END AS form_n, coalesce(n_near, 0) AS n_near
          FROM v LEFT JOIN q ON q.word = v.word AND k = 1),
    up AS (SELECT word, word AS root, form FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.form)
    SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.form IS NULL"""
