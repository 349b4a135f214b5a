"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is described by shape statistics (symbols, capitals, word
lengths, repetition), encoded by a small layer, and weighted by gated attention (Ilse et al., 2018); the weighted sum
gives the score of the document. Only document labels are needed. The fit is numpy on the driver over a bounded sample
of labelled documents; all texts are scored in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fiscalspark.llm import words as W
from fiscalspark.llm.samples import about, visible_labels
from fiscalspark.llm.toxicity import sigmoid

PASSAGE_WORDS = 64
#: Bound of the training sample, in labelled documents.
MOST_LABELLED = 12_000
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.01, 1e-4
CLIP = 6.0


def _classes() -> np.ndarray:
    """Character classes by byte, one column each."""
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "|", ".", ",", "?:;", "%*$#&@^~=+<>\\/_{}[]`", "'\"-()"]
    table = np.zeros((256, len(groups) + 1), np.int32)
    for k, group in enumerate(groups):
        table[[ord(c) for c in group], k] = 1
    table[128:, -1] = 1
    return table


CLASSES = _classes()
N_FEATURES = CLASSES.shape[1] + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text and the end). A text without words is one passage of zeros
    with a mark."""
    w = W.split(texts, W.BY_SPACE)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    counts = np.diff(w.first)
    bags = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((first[-1], N_FEATURES))
    out[first[:-1][counts == 0], -1] = 1
    n = len(w.hashes)
    if not n:
        return out, first
    text_of = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(n) - w.first[text_of]
    passage = first[text_of] + place // PASSAGE_WORDS
    begin = np.flatnonzero(place % PASSAGE_WORDS == 0)
    end = np.append(begin[1:], n)
    rows = passage[begin]
    size = (end - begin).astype(float)
    lengths = (w.ends - w.starts).astype(float)
    chars = np.maximum(np.add.reduceat(lengths, begin), 1)
    char_begin, char_end = w.starts[begin], w.ends[end - 1]
    for k in range(CLASSES.shape[1]):
        total = np.concatenate([[0], np.cumsum(CLASSES[raw, k])])
        per = chars if k in (0, 1, CLASSES.shape[1] - 1) else size
        out[rows, k] = (total[char_end] - total[char_begin]) / per
    k = CLASSES.shape[1]
    mean = chars / size
    out[rows, k] = mean / 10
    out[rows, k + 1] = np.sqrt(np.maximum(np.add.reduceat(lengths ** 2, begin) / size - mean ** 2, 0)) / 10
    out[rows, k + 2] = np.add.reduceat((lengths <= 3).astype(float), begin) / size
    same = np.zeros(n)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (passage[1:] == passage[:-1])
    out[rows, k + 3] = np.add.reduceat(same, begin) / size
    keys = w.hashes ^ W.mix(passage.astype(np.uint64))
    _, at = np.unique(keys, return_index=True)
    out[rows, k + 4] = np.bincount(passage[at], minlength=first[-1])[rows] / size
    grams = W.ngrams(w.hashes, 3)
    again = np.zeros(n)
    if len(grams):
        _, at = np.unique(grams ^ W.mix(text_of[:len(grams)].astype(np.uint64)), return_index=True)
        again[:len(grams)] = 1
        again[at] = 0
    out[rows, k + 5] = np.add.reduceat(again, begin) / size
    out[rows, k + 6] = np.log1p(counts[text_of[begin]]) / 10
    return out, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        parts = [self.bags(*passages(some)) for _, some in W.rounds(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def bags(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(forward(self.weights, self.standard(rows), first)[0])

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -CLIP, CLIP)


def forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    """Margin of each bag, and what the backward pass needs."""
    h = np.tanh(x @ p["encode"] + p["encode_bias"])
    t, g = np.tanh(h @ p["gate_t"]), sigmoid(h @ p["gate_s"])
    a = (t * g) @ p["attend"]
    sizes = np.diff(first)
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, first[:-1]), sizes))
    a /= np.repeat(np.add.reduceat(a, first[:-1]), sizes)
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    return z @ p["out"] + p["out_bias"][0], (h, t, g, a, z, sizes)


def backward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, held, d: np.ndarray) -> dict[str, np.ndarray]:
    h, t, g, a, z, sizes = held
    d_z = np.repeat(d[:, None] * p["out"], sizes, axis=0)
    d_a = (d_z * h).sum(1)
    d_logit = a * (d_a - np.repeat(np.add.reduceat(a * d_a, first[:-1]), sizes))
    d_t, d_g = d_logit[:, None] * p["attend"] * g * (1 - t ** 2), d_logit[:, None] * p["attend"] * t * g * (1 - g)
    d_h = (a[:, None] * d_z + d_t @ p["gate_t"].T + d_g @ p["gate_s"].T) * (1 - h ** 2)
    return {"encode": x.T @ d_h, "encode_bias": d_h.sum(0), "gate_t": h.T @ d_t, "gate_s": h.T @ d_g,
            "attend": (t * g).T @ d_logit, "out": z.T @ d, "out_bias": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Model:
    """Adam on the logistic loss of the bags; with one class or none, its share (1/2 if none) whatever the text."""
    rng = np.random.default_rng(seed)
    p = {"encode": rng.normal(0, N_FEATURES ** -0.5, (N_FEATURES, HIDDEN)), "encode_bias": np.zeros(HIDDEN),
         "gate_t": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "gate_s": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
         "attend": rng.normal(0, GATE ** -0.5, GATE), "out": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "out_bias": np.zeros(1)}
    if not len(labels) or labels.min() == labels.max():
        constant = 0.0 if not len(labels) else 8.0 * (2 * labels[0] - 1)
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), p | {"out": np.zeros(HIDDEN), "out_bias": np.array([constant])})
    everything = np.concatenate(bags)
    model = Model(everything.mean(0), everything.std(0) + 1e-3, p)
    bags = [model.standard(b) for b in bags]
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    epochs = max(EPOCHS, 1500 * BATCH // max(len(bags), 1) // 4)
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // BATCH)):
            x = np.concatenate([bags[i] for i in some])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
            margins, held = forward(p, x, first)
            d = (sigmoid(margins) - labels[some]) / len(some)
            step += 1
            for k, gradient in backward(p, x, first, held, d).items():
                gradient = gradient + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gradient
                v[k] = 0.999 * v[k] + 0.001 * gradient ** 2
                p[k] -= RATE * (1 - epoch / epochs) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column(2).cast(pa.large_binary()).fill_null(b"").to_pylist(), []
        for _, some in W.rounds(texts):
            rows, first = passages(some)
            out += [rows[first[i]:first[i + 1]].astype("<f4").tobytes() for i in range(len(some))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "bag"])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality", most_labelled: int = MOST_LABELLED) -> Model:
    """Fit from at most about ``most_labelled`` labelled documents that are not held out, over their whole texts."""
    seen = visible_labels(labels, label_column)
    chosen = about(seen, "id", most_labelled, seen.count())
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    part = rows.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(
        _bag_rows, f"id {kind}, label int, bag binary")
    found = sorted(part.collect(), key=lambda r: (r["id"], r["bag"]))
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, N_FEATURES).astype(float) for r in found]
    return fit(bags, np.array([float(r["label"] == 1) for r in found]))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(texts), pa.float64())], ["id", "score"])
    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``<id>, score`` of every row. Null and empty texts are one passage without words; repeated rows repeat; other
    columns are not read."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few kB of weights
    return rows.mapInArrow(_scorer(held), f"id {kind}, score double").withColumnRenamed("id", id_column)
