"""Toxicity by multiple-instance learning: a document is a bag of sentences and only the bag has a label.

A sentence's score is logistic in its words; a document's is the noisy-or of its sentences, so one toxic sentence is
enough and many harmless ones add little. The likelihood of the document labels trains the word weights; the same
weights then say which sentences offend. Features come from the text alone.

The classifier is fitted on a bounded sample: about PER_LABEL labelled documents of each label, drawn by a hash of
doc_id from the rows that the caller allows. Scoring reads whole texts of all rows.

Defined cases: null and empty texts have no sentence and score 0; equal texts score alike; without labelled rows, or
with one label only, every score is 0; repeated labels of a document count as toxic if one of them is; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bounded_sample, crc_rest, lists, per_task

BUCKETS = 1 << 18
PER_LABEL = 3000
THRESHOLD = 0.7

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")


def features(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings, which inflected and compound forms share."""
    names = (word, f"4<{word[:4]}", f"5<{word[:5]}", f"6<{word[:6]}")
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names)


def _sentences(tokens: list[list[str]], is_end: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of words, first word of each sentence, sentences of each text); only sentences with a word count."""
    word = np.flatnonzero(~is_end)
    doc = np.repeat(np.arange(len(tokens)), sizes)[word]
    before = np.cumsum(is_end)[word]  # ends before each word
    new = np.r_[True, (before[1:] != before[:-1]) | (doc[1:] != doc[:-1])][: len(word)]
    return word, np.flatnonzero(new), np.bincount(doc[new], minlength=len(tokens))


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all words, first bucket of each sentence, sentences of each text)."""
    tokens = [_TOKEN.findall(x.lower()) if x else [] for x in texts]
    held: dict[str, tuple[int, ...]] = {}
    flat = [w for x in tokens for w in x]
    for w in set(flat):
        held[w] = features(w)
    is_end = np.fromiter((w in ".!?\n" for w in flat), dtype=bool, count=len(flat))
    word, first, per = _sentences(tokens, is_end, np.array([len(x) for x in tokens], dtype=np.int64))
    buckets = np.array([held[flat[k]] for k in word.tolist()], dtype=np.int32).reshape(-1, 4)
    return buckets.ravel(), first * 4, per


class _Weights(dict):
    """Word -> weight, not a number for sentence ends."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        at = self[word] = float("nan") if word in ".!?\n" else float(sum(float(self.weights[b]) for b in features(word)))
        return at


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The chance that at least one sentence of each text is toxic."""
        tokens = [_TOKEN.findall(x.lower()) if x else [] for x in texts]
        sizes = np.array([len(x) for x in tokens], dtype=np.int64)
        if not np.isfinite(self.bias) or not sizes.sum():
            return np.zeros(len(texts))
        held = self.__dict__.get("held")
        if held is None or len(held) > 400_000:
            held = self.held = _Weights(self.weights)
        of = np.fromiter((v for x in tokens for v in map(held.__getitem__, x)), dtype=np.float64, count=int(sizes.sum()))
        word, first, per = _sentences(tokens, np.isnan(of), sizes)
        if not len(first):
            return np.zeros(len(texts))
        harm = np.logaddexp(0, np.add.reduceat(of[word], first) + self.bias)  # minus the log of a sentence's chance to be harmless
        return -np.expm1(-np.bincount(np.repeat(np.arange(len(texts)), per), weights=harm, minlength=len(texts)))

    def offending(self, text: str | None, threshold: float = 0.5) -> list[tuple[int, int]]:
        """(start, end) of the sentences whose own score reaches the threshold."""
        spans = [m.span() for m in re.finditer(r"[^.!?\n]+[.!?]*", text or "")]
        own = self.score([text[slice(*s)] for s in spans]) if spans else []
        return [s for s, x in zip(spans, own, strict=True) if x >= threshold]


def fit(labels: np.ndarray, bag_of: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, least_docs: int | None = None, rate: float = 0.4, sparse: float = 0.05) -> Model:
    """Maximises the noisy-or likelihood of the labels by AdaGrad. bag_of: (buckets, first token of each sentence)."""
    weights = np.zeros(BUCKETS, dtype=np.float64)
    least_docs = min(8, max(2, len(labels) // 300)) if least_docs is None else least_docs
    if not len(labels) or labels.min() == labels.max():
        return Model(weights.astype(np.float32), -np.inf)
    seen = np.zeros(BUCKETS, dtype=np.int32)
    for buckets, _ in bag_of:
        seen[np.unique(buckets)] += 1
    known = seen >= least_docs  # a word of a document or two says nothing of other documents
    bias, square, square_b, rng = -7.0, np.full(BUCKETS, 1e-2), 1e-2, np.random.default_rng(11)
    batch = 64
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            some = [i for i in order[k : k + batch] if len(bag_of[i][1])]
            if not some:
                continue
            buckets = np.concatenate([bag_of[i][0] for i in some])
            starts = np.cumsum([0, *(len(bag_of[i][0]) for i in some[:-1])])
            first = np.concatenate([bag_of[i][1] + s for i, s in zip(some, starts, strict=True)])
            doc = np.repeat(np.arange(len(some)), [len(bag_of[i][1]) for i in some])
            y = labels[some].astype(np.float64)
            w = weights[buckets]
            z = np.add.reduceat(w, first) + bias
            p = np.exp(-np.logaddexp(0, -z))
            total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(some))
            pull = np.where(y > 0, np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), -1.0)
            slope = p * pull[doc]
            size = np.diff(np.r_[first, len(buckets)])
            grad = np.bincount(buckets, weights=np.repeat(slope, size), minlength=BUCKETS) * known
            square += grad * grad
            step = rate / np.sqrt(square)
            weights += step * grad
            weights = np.sign(weights) * np.maximum(np.abs(weights) - step * sparse, 0)  # what says little ends at zero
            g = slope.sum()
            square_b += g * g
            bias += rate * g / np.sqrt(square_b)
    return Model(weights.astype(np.float32), float(bias))


def _bag_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        buckets, first, per = bags(part.column(1).to_pylist())
        cuts = np.r_[0, np.cumsum(per)]
        begin = np.r_[first, len(buckets)][cuts]
        own = first - np.repeat(begin[:-1], per)
        yield pa.RecordBatch.from_arrays([part.column(0), lists(buckets, np.diff(begin), pa.int32()), lists(own, per, pa.int32())], names=["y", "buckets", "first"])


def train(df: DataFrame, labels: DataFrame, allowed: Column | None = None, per_label: int = PER_LABEL, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits a model on about per_label documents of each label. allowed: a condition on labels' rows."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    marked = rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    sample = bounded_sample(marked, "doc_id", "y", per_label).select(F.col("doc_id").alias("__id"), "y")
    # the sample has a fixed expected size, so it can be broadcast
    chosen = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text")).join(F.broadcast(sample), "__id").select("y", "text")
    found = chosen.mapInArrow(_bag_rows, "y int, buckets array<int>, first array<int>").toArrow()
    bag_of = [(np.array(b, dtype=np.int64), np.array(f, dtype=np.int64)) for b, f in zip(found["buckets"].combine_chunks(), found["first"].combine_chunks(), strict=True) for b, f in [(b.values.to_numpy(), f.values.to_numpy())]]
    y = found["y"].to_numpy()
    order = sorted(range(len(y)), key=lambda i: (int(y[i]), len(bag_of[i][0]), bag_of[i][0].tobytes()))  # the same for any partitioning
    return fit(y[order], [bag_of[i] for i in order])


def scores(df: DataFrame, model: Model, held_out: Column, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value.weights, shared.value.bias)  # remembers words for this task alone
        for some in parts:
            score = model.score(some.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text")).mapInArrow(per_task(run, 1000), "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels whose crc32(doc_id as text) mod 3 isn't 1 and scores every document."""
    model = train(docs, labels, crc_rest("doc_id", 3) != 1)
    return scores(docs, model, crc_rest("doc_id", 3) == 1)
