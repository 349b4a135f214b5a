"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words of a text, and over the first bytes of its words, is fitted from confirmed toxic examples
and unlabelled texts. The risk is that of Kiryo et al. (2017): with the class prior p, ``p R+(positives) +
max(0, R-(unlabelled) - p R-(positives))`` under logistic loss; where the second part falls below zero, a step goes
against it instead. The fit is numpy on the driver over a bounded sample; all texts are scored in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fiscalspark.llm import words as W
from fiscalspark.llm.samples import about, held_out, visible_labels

#: Bounds of the training sample, in documents, and of the features that the model may keep.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 4_000, 12_000, 20_000
#: Lengths of the word beginnings that are features, each for its first, second and third occurrence in a text.
PREFIX_BYTES = (4, 6)
OCCURRENCES = 3
#: A feature is kept if by the class prior at least this share of the texts that hold it are toxic, if it is more frequent
#: among positives by so many standard deviations, and if so many positives hold it.
LEAST_TOXIC, LEAST_SIGMAS, LEAST_POSITIVE = 0.5, 5.0, 3
STEPS, RATE, DECAY = 600, 0.05, 2e-5
THRESHOLD = 0.7


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, (text number, 64-bit feature): its words, and the n-th time that a word begins so."""
    w = W.split(texts, W.BY_ALNUM)
    codes = np.frombuffer(w.joined, np.uint8)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(w.first))
    lengths = w.ends - w.starts
    owners, found = [text_of], [w.hashes]
    for k in PREFIX_BYTES:
        long = np.flatnonzero(lengths > k)
        h = np.full(len(long), k, np.uint64)
        for j in range(k):
            h += (codes[w.starts[long] + j].astype(np.uint64) + np.uint64(1)) * W.PLACES[j]
        h, owner = W.mix(h), text_of[long]
        order = np.argsort(h ^ W.mix(owner.astype(np.uint64)), kind="stable")
        h, owner = h[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(fresh)
        nth = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
        early = nth < OCCURRENCES
        owners.append(owner[early])
        found.append(h[early] + nth[early].astype(np.uint64) * W.PLACES[63])
    return np.concatenate(owners), np.concatenate(found)


@dataclass
class Model:
    names: np.ndarray  # sorted 64-bit features
    weights: np.ndarray
    bias: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Sum of the weights of the distinct features of each text, plus the bias."""
        out = np.full(len(texts), self.bias)
        if not len(self.names):
            return out
        bits = self.filter
        for begin, some in W.rounds(texts):
            owners, found = features(some)
            maybe = np.flatnonzero(bits[found & np.uint64(len(bits) - 1)])
            at = np.minimum(np.searchsorted(self.names, found[maybe]), len(self.names) - 1)
            real = self.names[at] == found[maybe]
            pairs = np.unique(owners[maybe][real] * len(self.names) + at[real])
            out[begin:begin + len(some)] += np.bincount(
                pairs // len(self.names), self.weights[pairs % len(self.names)], minlength=len(some))
        return out

    @property
    def filter(self) -> np.ndarray:
        if not hasattr(self, "_filter"):
            self._filter = np.zeros(1 << 20, bool)
            self._filter[self.names & np.uint64((1 << 20) - 1)] = True
        return self._filter


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -60, 60) / 2))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """The model from the distinct features of each positive and each unlabelled text."""
    if not positive or not unlabelled or prior <= 0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -60.0)
    n_p, n_u = len(positive), len(unlabelled)
    names_p, count_p = np.unique(np.concatenate(positive), return_counts=True)
    names_u, count_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(names_u, names_p), max(len(names_u) - 1, 0))
    in_u = np.where(names_u[at] == names_p, count_u[at], 0) if len(names_u) else np.zeros(len(names_p))
    share = (in_u + 0.5) / (n_u + 1)
    sigmas = (count_p - n_p * share) / np.sqrt(n_p * share * (1 - share) + 0.25)
    good = (count_p >= LEAST_POSITIVE) & (sigmas >= LEAST_SIGMAS) & (prior * count_p / n_p >= LEAST_TOXIC * share)
    keep = np.flatnonzero(good)
    keep = np.sort(keep[np.argsort(-sigmas[keep], kind="stable")[:MOST_FEATURES]])
    names = names_p[keep]

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row and column numbers of the kept features, row by row to keep the driver small."""
        found = []
        for row in rows if len(names) else []:
            at = np.minimum(np.searchsorted(names, row), len(names) - 1)
            found.append(at[names[at] == row].astype(np.int32))
        owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
        return owner, np.concatenate(found) if found else owner

    owner_p, at_p = matrix(positive)
    owner_u, at_u = matrix(unlabelled)
    w, m, v = np.zeros((3, len(names) + 1))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        s_p = w[-1] + np.bincount(owner_p, w[at_p], minlength=n_p)
        s_u = w[-1] + np.bincount(owner_u, w[at_u], minlength=n_u)
        as_negative = np.logaddexp(0, s_u).mean() - prior * np.logaddexp(0, s_p).mean()
        # Derivatives of the risk by each text's margin.
        d_negative_u, d_negative_p = sigmoid(s_u) / n_u, -prior * sigmoid(s_p) / n_p
        d_positive = -prior * sigmoid(-s_p) / n_p
        d_u, d_p = (d_negative_u, d_positive + d_negative_p) if as_negative >= 0 else (-d_negative_u, -d_negative_p)
        gradient = np.append(
            np.bincount(at_p, d_p[owner_p], minlength=len(names)) + np.bincount(at_u, d_u[owner_u], minlength=len(names)),
            d_p.sum() + d_u.sum())
        gradient[:-1] += DECAY * w[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient ** 2
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(names, w[:-1], float(w[-1]))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary()).fill_null(b"").to_pylist()
        out = []
        for _, some in W.rounds(texts):
            owners, found = features(some)
            order = np.argsort(owners, kind="stable")
            cuts = np.searchsorted(owners[order], np.arange(len(some) + 1))
            found = found[order]
            out += [np.unique(found[cuts[i]:cuts[i + 1]]).tobytes() for i in range(len(some))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "found"])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, id_column: str = "doc_id",
          text_column: str = "text", label_column: str = "toxic", most_positive: int = MOST_POSITIVE,
          most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit from at most about ``most_positive`` toxic documents and ``most_unlabelled`` others drawn without their labels.

    ``prior`` is the share of toxic documents; if it is not given, that share among the labels that may be seen. Held-out
    documents give neither labels nor texts. Without a positive example every text scores 0.
    """
    seen = visible_labels(labels, label_column)
    total, n_positive = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    if not n_positive:
        return fit([], [], 0.0)
    prior = prior if prior is not None else min(n_positive / total, 0.99)
    chosen = about(seen.where("label = 1"), "id", most_positive, n_positive).select("id")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id is not null")
    count = docs.count()

    def collected(df: DataFrame, label: int) -> list[np.ndarray]:
        kind = rows.schema["id"].dataType.simpleString()
        part = df.select("id", F.lit(label).alias("label"), "text").mapInArrow(
            _feature_rows, f"id {kind}, label int, found binary")
        return [np.frombuffer(r["found"], np.uint64) for r in sorted(part.collect(), key=lambda r: r["id"])]

    positive = collected(rows.join(F.broadcast(chosen), "id", "left_semi"), 1)
    unlabelled = collected(about(rows.where(~held_out(F.col("id"))), "id", most_unlabelled, count), 0)
    return fit(positive, unlabelled, prior)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(fitted.margins(texts)))], ["id", "score"])
    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``<id>, score`` of every row. Null and empty texts have no features and score the bias; repeated rows repeat; other
    columns are not read."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights
    return rows.mapInArrow(_scorer(held), f"id {kind}, score double").withColumnRenamed("id", id_column)


def _filter(model, place: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            texts = batch.column(place).cast(pa.large_binary()).fill_null(b"").to_pylist()
            yield batch.filter(pa.array(sigmoid(fitted.margins(texts)) < threshold))
    return run


def keep_below(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_filter(held, docs.columns.index(text_column), threshold), docs.schema)
