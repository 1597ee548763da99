"""Toxicity scores from subword-bag embeddings and a linear softmax (operator 6).

A word's vector is the mean of the vectors of its character n-grams (with border marks, hashed into a fixed number of
buckets), a text's vector is the mean over its words, and a softmax on top gives the score. Vectors and softmax are
trained together in numpy, in one task, from a bounded sample of labelled rows (TRAIN_ROWS); texts go through it one by
one and only their bags stay, and the driver gets the weights alone. Unseen spellings share n-grams with seen ones. Words
that occur in fewer than LEAST_TEXTS of the sampled texts are left out of training, if any others are there. As everything below the
softmax is a mean, a trained model gives each n-gram one number, and scoring is a narrow pass that adds up numbers kept
for each distinct word.

Null and empty texts have no words and get the score of the bias alone. Very long texts are read whole and need memory in
proportion to their own length. Labels and documents whose id is null are not learned from; rows with a null id are scored
as any other. Repeated rows each give a row; labelled ones are each learned from, in the order of id and text. Of several
labels for one doc_id the largest counts. Scores equal to the threshold count as toxic. Extra columns are not looked at. If
no labelled row is there, or only one class, the score is the share of label 1 (0 without any); an empty table gives none.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_python, documents, version

#: The most labelled texts that are learned from, about: labels are taken by a hash of their id. All are taken if there are no more.
TRAIN_ROWS = 4000
BUCKETS = 1 << 16
NGRAMS = (3, 4, 5)
DIM = 2
#: Times a text's mean vector: a few words in a hundred decide.
SCALE = 20.0
ROUNDS = 80
RATE = 0.5
DECAY = 3e-6
#: Words without a vector that every mean counts besides a text's own, so that a few words prove little; and the share of a text
#: (or number of times) beyond which the same word counts no more.
PAD = 20
MOST_SHARE, MOST_TIMES = 0.02, 3
#: Sampled texts that a word must occur in to be trained on.
LEAST_TEXTS = 3
NOTHING = 10
#: Words whose number is kept by a worker at a time.
MAX_KEPT = 250_000


def grams(word: bytes) -> list[int]:
    """Buckets of a word: its character n-grams with < and > at the ends, and the whole word."""
    w = b"<" + word + b">"
    n = len(w)
    return [zlib.crc32(w) % BUCKETS] + [zlib.crc32(w[i : i + k]) % BUCKETS for k in NGRAMS for i in range(n - k + 1)]


def bag(text: str) -> list[tuple[bytes, float]]:
    """Distinct words of a text, ASCII letters in lower case, with their weight in its mean."""
    words = text.encode("utf-8", "replace").lower().split()
    most = max(MOST_TIMES, MOST_SHARE * len(words))
    counts = [(w, n if n < most else most) for w, n in Counter(words).items()]
    total = len(words) + PAD
    return [(w, n / total) for w, n in counts]


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, towards label 1
    bias: float
    share: float | None = None  # the only answer, if nothing could be learned

    def word(self, word: bytes) -> float:
        return float(self.weight[grams(word)].mean())

    def score(self, text: str) -> float:
        return self.probability(sum(x * self.word(w) for w, x in bag(text)))

    def probability(self, x: float) -> float:
        if self.share is not None:
            return self.share
        return float(1 / (1 + np.exp(-np.clip(x + self.bias, -60, 60))))


class _Sparse:
    """Rows of weighted indices; products in both directions by sums over runs."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, shape: tuple[int, int]) -> None:
        self.shape = shape
        self.a = self._sorted(rows, cols, vals)
        self.b = self._sorted(cols, rows, vals)

    @staticmethod
    def _sorted(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> tuple:
        order = np.argsort(rows, kind="stable")
        r = rows[order]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
        return r[starts], starts, cols[order], vals[order].astype(np.float32)

    def _times(self, part: tuple, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(x), n), np.float32)
        if len(part[1]):
            for k, row in enumerate(x):  # a row for each dimension, so sums run over contiguous numbers
                out[k, part[0]] = np.add.reduceat(row[part[2]] * part[3], part[1])
        return out

    def dot(self, x: np.ndarray) -> np.ndarray:
        return self._times(self.a, x, self.shape[0])

    def back(self, x: np.ndarray) -> np.ndarray:
        return self._times(self.b, x, self.shape[1])


def _cells(rows: Iterable[tuple[str, int]]) -> tuple[dict[bytes, int], _Sparse, np.ndarray]:
    """Words by number, weights of texts and words, labels. Texts are dropped one by one, their bags kept as plain numbers.

    For each NOTHING texts an empty one with label 0 is added: a text that says nothing is not toxic."""
    numbers: dict[bytes, int] = {}
    words, weights, sizes, labels = array("i"), array("f"), array("i"), array("b")
    for text, label in rows:
        own = bag(text)
        words.extend([numbers.setdefault(w, len(numbers)) for w, _ in own])
        weights.extend([x for _, x in own])
        sizes.append(len(own))
        labels.append(label)
    nothing = -(-len(labels) // NOTHING) if any(labels) else 0
    sizes.extend([0] * nothing)
    labels.extend([0] * nothing)
    w, d = np.frombuffer(words, np.int32) if words else np.zeros(0, np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    v = np.frombuffer(weights, np.float32) if weights else np.zeros(0, np.float32)
    often = np.bincount(w, minlength=len(numbers)) >= LEAST_TEXTS
    if not often.any():
        often[:] = True
    place = np.cumsum(often, dtype=np.int32) - 1
    used = often[w]
    kept = {x: int(place[i]) for x, i in numbers.items() if often[i]}
    return kept, _Sparse(d[used], place[w[used]], v[used], (len(sizes), len(kept))), np.array(labels, int)


def train(rows: Iterable[tuple[str, int]], seed: int = 7) -> Model:
    """Vectors of n-grams and softmax, fitted together by full-batch Adam, from texts with their labels."""
    ids, docs, y = _cells(rows)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0, float(y.mean()) if len(y) else 0.0)
    parts = [np.array(grams(x), np.int32) for x in ids]
    sizes = [len(p) for p in parts]
    inside = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    subs = _Sparse(np.repeat(np.arange(len(parts), dtype=np.int32), sizes), inside, np.repeat(1 / np.maximum(np.array(sizes, np.float32), 1), sizes), (len(ids), BUCKETS))
    del parts, inside, ids
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (DIM, BUCKETS)).astype(np.float32), rng.normal(0, 0.3, (2, DIM)).astype(np.float32), np.log([[1 - y.mean()], [y.mean()]]).astype(np.float32)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    goal = np.eye(2, dtype=np.float32)[:, y]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) ** 0.5
    weight /= weight.sum()
    for step in range(1, ROUNDS + 1):
        vectors = subs.dot(params[0])
        hidden = SCALE * docs.dot(vectors)
        z = params[1] @ hidden + params[2]
        p = np.exp(z - z.max(axis=0))
        p /= p.sum(axis=0)
        dz = (p - goal) * weight
        grads = [subs.back(docs.back(SCALE * (params[1].T @ dz))), dz @ hidden.T, dz.sum(axis=1, keepdims=True)]
        for k, g in enumerate(grads):
            if k < 2:
                g = g + DECAY * params[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            params[k] -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
    side = params[1][1] - params[1][0]
    return Model(SCALE * (side @ params[0]).astype(np.float64), float(params[2][1, 0] - params[2][0, 0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from about so many labelled documents at most; never from held-out ones."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    # about `rows` texts, so one task holds them; it meets them in an order of their own
    sample = documents(docs).join(F.broadcast(known), "doc_id").repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = train((t, y) for pdf in it for t, y in zip(pdf["text"], pdf["toxic"].tolist(), strict=True))
        yield pd.DataFrame({"weight": [model.weight.astype(np.float64).tobytes()], "bias": [model.bias], "share": [-1.0 if model.share is None else model.share]})

    got = sample.mapInPandas(run, "weight binary, bias double, share double").first()  # BUCKETS numbers
    if got is None:
        return Model(np.zeros(BUCKETS), 0.0, 0.0)
    return Model(np.frombuffer(got["weight"], np.float64), got["bias"], None if got["share"] < 0 else got["share"])


class _Numbers(dict):
    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: bytes) -> float:
        got = self.model.word(word)
        if len(self) < MAX_KEPT:
            self[word] = got
        return got


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, version (of the text) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input
    kept: list[_Numbers] = []

    def run(pdf: pd.DataFrame) -> Iterator[dict]:
        own = shared.value
        if not kept:  # once a task
            kept.append(_Numbers(own))
        numbers = kept[0]
        yield {"score": [own.probability(sum([x * numbers[w] for w, x in bag(text)])) for text in pdf["text"]], "version": pdf["version"]}

    scored = by_python(documents(docs).withColumn("version", version(F.col("text"))), run, "score double, version long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "version")
