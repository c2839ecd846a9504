"""Masked pseudo-likelihood of a bidirectional window network.

The words of all documents are counted in Spark and the ``VOCAB - 1`` most frequent get ids of their own, by rank. Every other word
has the id ``OTHER`` and is spelled besides: ``log p(OTHER)`` plus the sum of ``log p(byte | byte before)`` over its bytes and its end, from
counts over the spelled words of all documents (add one). So no two words share a probability by accident, and unheard-of
spellings score low. Every token is masked in turn and predicted from the two on either side (a padding id beyond the ends of the text):

    h = tanh(A[l2] + B[l1] + C[r1] + D[r2] + b)        p(token) = softmax(h K + k)[class] * softmax(h W + w over the words of the class)[word]

Classes are runs of ids, ids are ranks, and class sizes grow with the rank: the words that most tokens are share a class with few others, ``OTHER`` with none,

and the score of a document is the sum of ``log p`` over all its tokens. The network is trained in NumPy on every token of all documents:
their ids are written once, a block of texts in a row. In each round every partition streams its own blocks, masks each token in turn and
trains on the examples of one block at a time; the parameters are averaged by number of examples, chunk by chunk in Spark, so
what comes to the driver has the size of the model alone. Steps grow with the block, from ``_STEP`` to ``_MOST`` examples; there are
at most as many learners as the corpus has runs of ``_LEARNER`` tokens.

Words are told apart by 64-bit hashes. Null or blank text: no tokens, sum 0, mean null. Without any token in the corpus the initial parameters score (nothing).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import prod
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basisflow.llm.bpe import _ddl
from basisflow.llm.common import Words, packed_rows, packed_schema, partitions, text_blocks, to_partitions, unpack, without
from basisflow.plans.lineage import written

CLASSES, VOCAB, WIDTH, ROUNDS = 32, 2048, 16, 3
OTHER = 0
PAD = VOCAB
_STEP, _MOST, _LEARNER, _CHUNKS = 512, 8192, 1 << 20, 16
_SHAPES = {"context": (4, VOCAB + 1, WIDTH), "b": (WIDTH,), "K": (CLASSES, WIDTH), "k": (CLASSES,), "W": (VOCAB, WIDTH), "w": (VOCAB,)}
SIZE = sum(prod(s) for s in _SHAPES.values())


def class_bounds(classes: int = CLASSES, vocab: int = VOCAB) -> np.ndarray:
    """First id of each class and the end: id 0 alone, then sizes that grow by the same factor."""
    low, high = 1.0, float(vocab)
    while high - low > 1e-9:  # the factor at which the sizes add up to the vocabulary
        factor = (low + high) / 2
        low, high = (low, factor) if sum(factor ** i for i in range(classes - 1)) > vocab - 1 else (factor, high)
    ends = np.rint(np.cumsum([high ** i for i in range(classes - 1)])).astype(np.int64) + 1
    return np.r_[0, 1, np.minimum(np.maximum(ends, np.arange(2, classes + 1)), vocab)]


BOUNDS = class_bounds()
_CLASS = np.repeat(np.arange(CLASSES), np.diff(BOUNDS))


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameter arrays inside one flat vector."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = prod(shape)
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def initial(seed: int = 11) -> np.ndarray:
    flat = np.random.default_rng(seed).normal(0, 0.1, SIZE).astype(np.float32)
    for name in ("b", "k", "w"):
        views(flat)[name][...] = 0
    return flat


@dataclass
class Model:
    """Network parameters, hashes of the words that have ids (sorted) and the ids, and log p(byte | byte before); 256 is a word's edge."""
    flat: np.ndarray
    words: np.ndarray
    ids: np.ndarray
    spelling: np.ndarray


def untaught(flat: np.ndarray) -> Model:
    """Without a vocabulary: every word is spelled, all bytes alike."""
    return Model(flat, np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.full((257, 257), -np.log(257)))


def encoded(words: Words, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id of each word."""
    if not len(known):
        return np.full(len(words.hash), OTHER, np.uint16)
    at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    return np.where(known[at] == words.hash, ids[at], np.uint16(OTHER)).astype(np.uint16)


def _letters(words: Words, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs (before * 257 + byte) of the spelled words with both edges, one word after the other, and where each word begins."""
    first, size = words.first[spelled], (words.end - words.first)[spelled] + 1
    starts = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(starts[-1]) + np.repeat(first - starts[:-1], size)
    now = words.data.take(at, mode="clip").astype(np.int32)
    now[starts[1:] - 1] = 256
    before = np.concatenate([np.zeros(1, np.int32), now])[:len(now)]
    before[starts[:-1]] = 256
    return before * 257 + now, starts


def vocabulary(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent words of all documents and their ids, 1 for the most frequent."""
    n_parts = partitions(docs.sparkSession)

    def count(batches):
        for batch in batches:
            for _, _, data, starts in text_blocks(batch.column(0), 4 << 20):
                found, n = np.unique(Words(data, starts).hash, return_counts=True)
                if len(found):
                    yield packed_rows((found % np.uint64(n_parts)).astype(np.int64), n_parts, found, n.astype(np.uint32))

    def add(batches):
        found, n = unpack(batches, "u8", "u4")
        order = np.argsort(found)
        found, first = np.unique(found[order], return_index=True)
        if len(found):
            n = np.add.reduceat(n[order].astype(np.int64), first)
            best = np.lexsort([found, -n])[:VOCAB - 1]  # no other can be among the best of all partitions
            yield pa.RecordBatch.from_arrays([pa.array(found[best].view(np.int64)), pa.array(n[best])], ["word", "n"])

    packed = to_partitions(docs.select(docs[text].alias("text")).mapInArrow(count, packed_schema(2)), n_parts)
    best = packed.mapInArrow(add, "word bigint, n bigint").orderBy(F.desc("n"), "word").limit(VOCAB - 1).toArrow()
    words = best["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], (order + 1).astype(np.uint16)


def masked(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(l2, l1, r1, r2, token) of every token of a block; row r of the block has the ids ``bounds[r]:bounds[r + 1]``."""
    n = len(ids)
    out = np.full((n, 5), PAD, np.uint16)
    out[2:, 0], out[1:, 1], out[:-1, 2], out[:-2, 3], out[:, 4] = ids[:-2], ids[:-1], ids[1:], ids[2:], ids
    first, end = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0]
    out[first, :2] = out[end - 1, 2:4] = PAD
    several = end - first > 1
    out[first[several] + 1, 0] = out[end[several] - 2, 3] = PAD
    return out


_SAFE = 60.0  # exp of it, and sums of such over a tile, are float32
_TILE = 4096  # examples whose logits stay near a core
_PIECE = 1 << 14  # parameters whose Adam state does
_ALONE = np.diff(BOUNDS)[_CLASS] == 1
_PAIRS = np.arange((VOCAB + 1) * WIDTH // 2).reshape(VOCAB + 1, WIDTH // 2)  # places of an id's row, in complex numbers


def _columns(x: np.ndarray) -> list[np.ndarray]:
    """Contiguous index columns of rows of ``masked``."""
    return list(np.ascontiguousarray(x.T).astype(np.intp))


@dataclass
class _Layer:
    """Weights of one softmax. Where no logit can overflow the bias is a factor: exp(w h + b) = exp(b) exp(w h).
    Otherwise the factor is 1, and the bias is in the exponent, less the largest of each example."""
    weights: np.ndarray
    bias: np.ndarray
    safe: bool

    def __post_init__(self):
        self.factor = np.exp(self.bias) if self.safe else np.ones_like(self.bias)
        self.scaled = self.weights * self.factor[:, None]

    def exp(self, ids: slice, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
        """exp of the logits but for the factor, one column for each example; their sums with it; and what was taken off the logits."""
        z, most = self.weights[ids] @ rows.T, 0.0
        if not self.safe:
            z += self.bias[ids][:, None]
            most = z.max(0)
            z -= most
        np.exp(z, out=z)
        return z, self.factor[ids] @ z, most

    def add(self, ids: slice, rows: np.ndarray, toward: np.ndarray, g: np.ndarray, g_bias: np.ndarray) -> None:
        """Adds the sums of softmax times ``rows`` and of softmax to ``g`` and ``g_bias``, but for the factor, and its mean weights to ``toward``."""
        e, s, _ = self.exp(ids, rows)
        e *= np.divide(1, s, out=s)
        g[ids] += e @ rows
        g_bias[ids] += e.sum(1)
        toward += e.T @ self.scaled[ids]


_ALL = slice(None)


def _layers(p) -> tuple[_Layer, _Layer, np.ndarray, np.ndarray]:
    """Classes and words; and for each id the weights and the bias of its class plus, unless it is alone there, its own."""
    ones = np.ones(WIDTH, np.float32)
    safe = max((np.abs(p[a]) @ ones + np.abs(p[b])).max() for a, b in (("K", "k"), ("W", "w"))) < _SAFE  # the hidden values lie in -1..1
    own, bias = p["W"].copy(), p["w"].copy()
    own[_ALONE], bias[_ALONE] = 0, 0
    own += p["K"].take(_CLASS, axis=0)
    bias += p["k"].take(_CLASS)
    return _Layer(p["K"], p["k"], safe), _Layer(p["W"], p["w"], safe), own, bias


def _hidden(tables: list[np.ndarray], columns: list[np.ndarray], out: np.ndarray) -> np.ndarray:
    """One row for each example: tanh(x) = 1 - 2 / (exp(2 x) + 1)."""
    tables[0].take(columns[0], axis=0, out=out, mode="clip")  # the other modes would buffer
    for i in (1, 2, 3):
        out += tables[i].take(columns[i], axis=0)
    out += out
    with np.errstate(over="ignore"):
        np.exp(out, out=out)
    out += np.float32(1)
    np.divide(np.float32(-2), out, out=out)
    out += np.float32(1)
    return out


def _tables(p) -> list[np.ndarray]:
    """Context rows by place, with the bias in the first."""
    return [p["context"][0] + p["b"], *p["context"][1:]]


def _by_class(token: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Ids of each class of several words, and its run of sorted tokens."""
    cuts = np.searchsorted(token, BOUNDS)
    for c in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(BOUNDS) > 1)):
        yield slice(BOUNDS[c], BOUNDS[c + 1]), slice(cuts[c], cuts[c + 1])


def log_probabilities(flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log p(token) for rows of ``masked``."""
    p, out = views(flat), np.zeros(len(x))
    classes, words, own, bias = _layers(p)
    tables, order = _tables(p), np.argsort(x[:, 4], kind="stable")
    for lo in range(0, len(x), _TILE):
        part = order[lo:lo + _TILE]
        columns = _columns(x.take(part, axis=0))
        token, h = columns[4], _hidden(tables, columns, np.empty((len(part), WIDTH), np.float32))
        # logits of the tokens themselves, less the logarithms of both sums
        logp = (np.einsum("ij,ij->i", own.take(token, axis=0), h) + bias.take(token)).astype(float)
        _, s, most = classes.exp(_ALL, h)
        logp -= np.log(s) + most
        for ids, run in _by_class(token):
            _, s, most = words.exp(ids, h[run])
            logp[run] -= np.log(s) + most
        out[part] = logp
    return out


def _add_rows(total: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """``total[id] += row``. Half of the tokens are ``OTHER``, so its rows are summed by a product; of the rest, two numbers are added at a time."""
    rest = ids != OTHER
    total[OTHER] += (~rest).astype(np.float32) @ rows
    at = np.flatnonzero(rest)
    np.add.at(total.reshape(-1).view(np.complex64), _PAIRS.take(ids.take(at), axis=0).reshape(-1), rows.take(at, axis=0).reshape(-1).view(np.complex64))


def _gradient(p, x) -> np.ndarray:
    """Mean gradient of -log p over the rows of ``x``, sorted by token."""
    flat = np.zeros(SIZE, np.float32)
    g, tables, (classes, words, own, _) = views(flat), _tables(p), _layers(p)
    columns, rows, slopes = _columns(x), np.empty((len(x), WIDTH), np.float32), np.empty((len(x), WIDTH), np.float32)
    for lo in range(0, len(x), _TILE):
        tile = slice(lo, lo + _TILE)
        near, h, d = [c[tile] for c in columns], rows[tile], slopes[tile]
        _hidden(tables, near, h)
        np.negative(own.take(near[4], axis=0), out=d)
        classes.add(_ALL, h, d, g["K"], g["k"])
        for ids, run in _by_class(near[4]):
            words.add(ids, h[run], d[run], g["W"], g["w"])
        d *= 1 - h * h
        g["b"] += np.ones(len(d), np.float32) @ d
    for i in range(4):
        _add_rows(g["context"][i], columns[i], slopes)
    met = np.zeros((len(_CLASS), WIDTH), np.float32)  # sums of h over each token
    _add_rows(met, columns[4], rows)
    n = np.bincount(columns[4], minlength=len(_CLASS))
    for layer, name, h, seen in ((classes, "k", np.add.reduceat(met, BOUNDS[:-1], axis=0), np.add.reduceat(n, BOUNDS[:-1])), (words, "w", met, n)):
        g[name.upper()][...] = g[name.upper()] * layer.factor[:, None] - h
        g[name][...] = g[name] * layer.factor - seen
    g["W"][_ALONE], g["w"][_ALONE] = 0, 0
    flat /= np.float32(len(x))
    return flat


def train_local(flat: np.ndarray, blocks: Iterable[np.ndarray], rate: float, seed: int) -> tuple[np.ndarray, int]:
    """One Adam pass over the examples of all blocks, each in random order; and how many there were."""
    flat, rng, step, n = flat.copy(), np.random.default_rng(seed), 0, 0
    m, v = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)
    for x in blocks:
        order, token = rng.permutation(len(x)), np.ascontiguousarray(x[:, 4])
        size = min(max(len(x) // 20, _STEP), _MOST)
        for lo in range(0, len(x), size):
            step += 1
            part = order[lo:lo + size]
            grad = _gradient(views(flat), x.take(part[np.argsort(token.take(part), kind="stable")], axis=0))
            _adam(flat, m, v, grad, rate, step)
        n += len(x)
    return flat, n


def _adam(flat: np.ndarray, m: np.ndarray, v: np.ndarray, grad: np.ndarray, rate: float, step: int) -> None:
    """One step in place, piece by piece and without new arrays; ``grad`` is used up.

    0.1 of the gradient is its share of m, and squared its share of v; the correction of v is taken out of the root.
    """
    root = np.sqrt(1 - 0.99 ** step)
    floor, pace = np.float32(1e-8 * root), np.float32(rate * root / (1 - 0.9 ** step))
    for lo in range(0, SIZE, _PIECE):
        piece = slice(lo, lo + _PIECE)
        own, first, second, move = flat[piece], m[piece], v[piece], grad[piece]
        move *= np.float32(0.1)
        first *= np.float32(0.9)
        first += move
        np.square(move, out=move)
        second *= np.float32(0.99)
        second += move
        np.sqrt(second, out=move)
        move += floor
        np.divide(first, move, out=move)
        move *= pace
        own -= move


def tokens(docs: DataFrame, known: np.ndarray, ids: np.ndarray, text: str = "text") -> DataFrame:
    """Ids of all tokens of all documents: n, ids and lengths of the texts of a block, chunk -1; and chunks of counts of spelled byte pairs."""

    def run(batches):
        pairs = np.zeros(257 * 257, np.int64)
        for batch in batches:
            for _, _, data, starts in text_blocks(batch.column(0)):
                words = Words(data, starts)
                if len(words.hash):
                    own, lengths = encoded(words, known, ids), np.diff(words.bounds).astype(np.int64)
                    pairs += np.bincount(_letters(words, own == OTHER)[0], minlength=257 * 257)
                    yield _batch([-1], [len(own)], [own], [lengths[lengths > 0]])
        if pairs.any():
            yield _batch(np.arange(_CHUNKS), np.zeros(_CHUNKS), np.array_split(pairs, _CHUNKS), [np.zeros(0)] * _CHUNKS)

    return docs.select(docs[text].alias("text")).mapInArrow(run, "chunk int, n bigint, ids binary, lengths binary")


def _batch(chunk, n, ids, lengths) -> pa.RecordBatch:
    packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (ids, lengths)]
    return pa.RecordBatch.from_arrays([pa.array(np.array(chunk, np.int32)), pa.array(np.array(n, np.int64)), *packed], ["chunk", "n", "ids", "lengths"])


def _spelling(table: DataFrame) -> np.ndarray:
    """log p(byte | byte before) from the counts of all partitions, added up chunk by chunk in Spark."""

    def add(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(np.frombuffer(x, np.int64) for f in frames for x in f["ids"])
        yield pd.DataFrame({"chunk": [key[0]], "values": [total.tobytes()]})

    chunks = table.where("chunk >= 0").select("chunk", "ids").groupBy("chunk").applyInPandas(add, "chunk int, values binary").toArrow().sort_by("chunk")
    counts = np.zeros((257, 257)) if not len(chunks) else np.frombuffer(b"".join(chunks["values"].to_pylist()), np.int64).reshape(257, 257)
    return np.log((counts + 1) / (counts + 1).sum(1, keepdims=True))


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for ids, lengths in zip(batch.column("ids"), batch.column("lengths"), strict=True):
            yield masked(np.frombuffer(ids.as_buffer(), np.uint16), np.concatenate([[0], np.cumsum(np.frombuffer(lengths.as_buffer(), np.int64))]))


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, rate: float = 0.02) -> Model:
    """Vocabulary, spelling, and parameters after ``rounds`` of local passes over every token and averaging."""
    known, ids = vocabulary(docs, text)
    both = written(tokens(docs, known, ids, text), "tokens")
    spelling, table = _spelling(both), both.where("chunk < 0")
    learners = (table.agg(F.sum("n")).first()[0] or 0) // _LEARNER + 1
    flat = initial()
    for r in range(rounds):
        pace = rate / (1 + r)

        def learn(batches: Iterator[pa.RecordBatch], flat=flat, pace=pace, r=r):
            own, n = train_local(flat, _examples(batches), pace, r)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array(np.full(_CHUNKS, n)),
                     pa.array([c.tobytes() for c in np.array_split(own, _CHUNKS)], pa.binary())], ["chunk", "n", "values"])

        def average(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = 0.0, 0
            for f in frames:
                for k, values in zip(f["n"], f["values"], strict=True):
                    total, n = total + np.frombuffer(values, np.float32).astype(float) * k, n + k
            yield pd.DataFrame({"chunk": [key[0]], "values": [(total / n).astype(np.float32).tobytes()]})

        learned = table.coalesce(learners).mapInArrow(learn, "chunk int, n bigint, values binary")
        chunks = learned.groupBy("chunk").applyInPandas(average, "chunk int, values binary").toArrow().sort_by("chunk")
        if len(chunks):
            flat = np.frombuffer(b"".join(chunks["values"].to_pylist()), np.float32)
    return Model(flat, known, ids, spelling)


def score(docs: DataFrame, model: Model | np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, log_likelihood (sum) and mean_log_likelihood; columns of those names are replaced.

    Bare network parameters score without a vocabulary."""
    model = model if isinstance(model, Model) else untaught(model)
    kept = without(docs, "n_tokens", "log_likelihood", "mean_log_likelihood")

    def run(batches):
        for batch in batches:
            n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, starts in text_blocks(batch.column(text)):
                words = Words(data, starts)
                bounds = words.bounds
                ids = encoded(words, model.words, model.ids)
                logp, spelled = log_probabilities(model.flat, masked(ids, bounds)), np.flatnonzero(ids == OTHER)
                if len(spelled):
                    pairs, begins = _letters(words, spelled)
                    logp[spelled] += np.add.reduceat(model.spelling.ravel().take(pairs), begins[:-1])
                sums = np.concatenate([[0], np.cumsum(logp)])
                n.append(np.diff(bounds))
                total.append(sums[bounds[1:]] - sums[bounds[:-1]])
            n, total = np.concatenate(n), np.concatenate(total)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            for name, values in (("n_tokens", pa.array(n)), ("log_likelihood", pa.array(total)), ("mean_log_likelihood", mean)):
                batch = batch.append_column(name, values)
            yield batch

    return kept.mapInArrow(run, f"{_ddl(kept)}n_tokens bigint, log_likelihood double, mean_log_likelihood double")
