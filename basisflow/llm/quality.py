"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded (shares of character
classes, word lengths, repeats) and embedded; gated attention, learned from document labels alone, weighs
the passages, and the weighted representation gets the score:

    h_k = tanh(W x_k + b)      a = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k)))      score = sigmoid(c . sum_k a_k h_k + e)

The fit sees at most ``MAX_FIT_DOCS`` labelled documents, the ones with the smallest hashed ids (a documented
bound; the fitted model has a fixed size). Scoring reads every text whole.

Null or blank text: one passage of zeros, so a score still comes out. A document with several labels counts
with their mean. Without any labelled row the model scores 0.5 everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisflow.llm.bpe import _ddl
from basisflow.llm.common import Words, text_blocks, without

PASSAGE_WORDS = 64
MAX_FIT_DOCS = 5000
_CLASSES = 14


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 13, np.int64)  # other signs
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 3
    kind[[0x20, 9, 10, 11, 12, 13]] = 4
    for i, chars in enumerate(("!", "|", "#$%&*", ".,;:?", "'\"()-", "<>{}[]=", "/\\_@+", "~^`")):
        kind[[ord(c) for c in chars]] = 5 + i
    return kind


_KIND = _byte_classes()
FEATURES = _CLASSES + 7


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a block, and the first passage of each row (plus the end)."""
    w = Words(data, starts)
    rows = len(starts) - 1
    per_row = np.maximum(1, -(-np.diff(w.bounds) // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per_row)])
    x = np.zeros((first[-1], FEATURES))
    if not len(w.first):
        return x, first
    row = w.row
    within = np.arange(len(row)) - w.bounds[row]
    passage = first[row] + within // PASSAGE_WORDS
    length = w.end - w.first
    n = np.bincount(passage, minlength=first[-1]).astype(float)
    size = np.bincount(passage, weights=length, minlength=first[-1])
    # each byte belongs to the passage of the last word that began before it
    head = np.flatnonzero(np.diff(passage, prepend=-1))
    spans = np.diff(np.append(w.first[head], len(data)))
    owner = np.repeat(passage[head], spans)
    kinds = np.bincount(owner * _CLASSES + _KIND[data[w.first[0]:]], minlength=first[-1] * _CLASSES).reshape(-1, _CLASSES)
    full = n > 0
    x[:, :_CLASSES] = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
    mean = size / np.maximum(n, 1)
    square = np.bincount(passage, weights=length.astype(float) ** 2, minlength=first[-1]) / np.maximum(n, 1)
    same = lambda lag: np.bincount(passage[lag:], weights=(w.hash[lag:] == w.hash[:-lag]) & (row[lag:] == row[:-lag]),
                                   minlength=first[-1]) if len(row) > lag else np.zeros(first[-1])
    sign = (_KIND[w.data[w.end - 1]] >= 5) & (_KIND[w.data[w.end - 1]] != 8)
    x[:, _CLASSES] = mean / 10
    x[:, _CLASSES + 1] = np.sqrt(np.maximum(square - mean ** 2, 0)) / 10
    x[:, _CLASSES + 2] = same(1) / np.maximum(n, 1)
    x[:, _CLASSES + 3] = same(2) / np.maximum(n, 1)
    x[:, _CLASSES + 4] = np.bincount(passage, weights=sign, minlength=first[-1]) / np.maximum(n, 1)
    x[:, _CLASSES + 5] = np.bincount(passage, weights=length == 1, minlength=first[-1]) / np.maximum(n, 1)
    x[:, _CLASSES + 6] = np.log1p(n) / 5
    x[~full] = 0
    return x, first


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(first) - 1, 0.5)
        return _forward(self.weights, (x - self.center) / self.scale, first)["score"]

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The weight of every passage within its document."""
        return _forward(self.weights, (x - self.center) / self.scale, first)["a"]


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(p, x, first):
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["w"]
    top = np.maximum.reduceat(s, first[:-1])
    e = np.exp(s - top[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["e"])}


def _gradient(p, x, first, y):
    f = _forward(p, x, first)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    d = (f["score"] - y) / len(y)
    out = {"c": f["z"].T @ d, "e": np.array(d.sum())}
    dz = d[:, None] * p["c"]
    da = (h * dz[bag]).sum(1)
    ds = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
    dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
    out |= {"w": (t * g).T @ ds, "V": h.T @ dt, "U": h.T @ dg}
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return out | {"W": x.T @ dh, "b": dh.sum(0)}


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 40, batch: int = 64,
        rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the mean log loss of the bags, in mini-batches."""
    if not bags:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {})
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    center, scale = everything.mean(0), everything.std(0) + 0.01
    bags = [(b - center) / scale for b in bags]
    shape = {"W": (FEATURES, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "e": ()}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]) if len(s) == 2 else 0.1, s) for k, s in shape.items()}
    m, v, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            step += 1
            for k, grad in _gradient(p, np.concatenate([bags[i] for i in pick]), first, y[pick]).items():
                grad = grad + 1e-4 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * v[k] + 0.01 * grad ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return Model(center, scale, p)


def held_out(key: str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the key's text divisible by 5 (null key: not held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
          max_docs: int = MAX_FIT_DOCS) -> Model:
    """Fit on labelled documents outside the evaluation fold."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
              .groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("y"))
              .orderBy(F.xxhash64(key), key).limit(max_docs))
    found = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)

    def run(batches):
        for batch in batches:
            for lo, hi, data, starts in text_blocks(batch.column("text")):
                x, first = passages(data, starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo),
                     pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                    ["key", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    rows = found.mapInArrow(run, f"key {kind}, y double, x binary").toArrow().sort_by([("key", "ascending"), ("y", "ascending")])
    bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES).astype(float) for b in rows["x"].to_pylist()]
    return fit(bags, rows["y"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the score and ``<output>_passages``, their number; columns of those names are replaced."""
    kept = without(docs, output, f"{output}_passages")

    def run(batches):
        for batch in batches:
            scores, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, data, starts in text_blocks(batch.column(text)):
                x, first = passages(data, starts)
                scores.append(model.scores(x, first))
                counts.append(np.diff(first))
            yield batch.append_column(output, pa.array(np.concatenate(scores))).append_column(
                f"{output}_passages", pa.array(np.concatenate(counts)))

    return kept.mapInArrow(run, f"{_ddl(kept)}`{output}` double, `{output}_passages` bigint")


def accept(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns."""
    scored = score(docs, model, text, "_quality_score")
    return scored.where(F.col("_quality_score") >= threshold).select(*[f"`{c}`" for c in docs.columns])
