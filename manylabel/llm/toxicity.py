"""Toxicity scores from subword-bag embeddings and a linear softmax.

A text is the bag of its words' n-grams (4 to 6 bytes, with a mark at both word ends). Every
n-gram bucket has a vector; the vectors are averaged over the text and a linear softmax maps
the average to two classes. Vectors and softmax are trained jointly in numpy, so spellings never
seen share the vectors of their n-grams.

Training uses at most about ``sample_rows`` labelled rows, drawn by a hash of the id, half of
them of each class where there are enough; executors turn their texts into bags, so the driver
gets buckets and counts only. Scoring is one pass over all bytes of all texts: with two classes
the softmax over an average is the average of one number for each bucket.

Defined results: a null or empty text, or one without letters, gets the score of an empty bag
(the softmax of the biases); without labels of both classes every row scores 0. Equal texts get
equal scores; a text longer than a batch slice is scored as a whole; labels of one id are read
once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.llm.batches import sums, text_slices
from manylabel.llm.language_filters import FOLD

SIZES = (4, 5, 6)
BUCKET_BITS = 18


def word_ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: bucket of the n-grams inside words, and each text's offsets into them."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.full(len(data) + 2 * n + max(SIZES), 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, lengths)] = FOLD[data]
    starts = offsets + 2 * np.arange(n + 1)
    blanks = np.concatenate([[0], np.cumsum(padded == 32, dtype=np.int32)])
    mixed = np.zeros(len(padded), np.uint32)
    last = 0
    for size in SIZES:
        for i in range(last, size):
            mixed[: len(padded) - i] = mixed[: len(padded) - i] * np.uint32(0x01000193) + padded[i:]
        last = size
        usable = len(padded) - size
        inside = blanks[size - 1 : size - 1 + usable] - blanks[1 : 1 + usable]
        good = inside == 0
        at = np.concatenate([[0], np.cumsum(good)])[np.minimum(starts, usable)]
        codes = mixed[:usable][good] * np.uint32(0x9E3779B1) ^ np.uint32(size * 0x27D4EB2F & 0xFFFFFFFF)
        codes ^= codes >> np.uint32(13)
        yield (codes * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS), at


@dataclass
class ToxicityModel:
    """One weight for each bucket (difference of the two classes), and the bias."""

    weights: np.ndarray
    bias: float
    fitted: bool = True

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros(len(offsets) - 1)
        count = np.zeros(len(offsets) - 1)
        for buckets, at in word_ngrams(data, offsets):
            total += sums(self.weights[buckets].astype(np.float64), at)
            count += np.diff(at)
        if not self.fitted:
            return np.zeros(len(total))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))


#: N-grams of the sample that are multiplied at once.
CHUNK = 1 << 20


class _Bags:
    """The sample as weighted bags, in chunks, and the two products of the training steps."""

    def __init__(self, buckets: list[np.ndarray], counts: list[np.ndarray], trust: np.ndarray):
        self.n, self.chunks = len(buckets), []
        used = [i for i in range(self.n) if len(buckets[i])]
        sizes = np.array([len(buckets[i]) for i in used], np.int64)
        part = np.cumsum(sizes) // CHUNK
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            texts = [used[i] for i in at]
            found = np.concatenate([buckets[i] for i in texts])
            share = np.concatenate([(c * (100.0 / c.sum())).astype(np.float32) for c in (counts[i] for i in texts)])
            share *= trust[found]
            self.chunks.append((np.array(texts), sizes[at], np.cumsum(sizes[at]) - sizes[at], found, share))

    def averages(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, vectors.shape[1]))
        for texts, _, starts, found, share in self.chunks:
            for j, column in enumerate(vectors.T.astype(np.float32)):
                out[texts, j] = np.add.reduceat(share * column[found], starts)
        return out

    def slopes(self, back: np.ndarray) -> np.ndarray:
        out = np.zeros((1 << BUCKET_BITS, back.shape[1]))
        for texts, sizes, _, found, share in self.chunks:
            for j, column in enumerate(back.T.astype(np.float32)):
                out[:, j] += np.bincount(found, share * np.repeat(column[texts], sizes), len(out))
        return out


def train(
    buckets: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray,
    dims: int = 2, epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, doubt: float = 30.0, seed: int = 7,
) -> ToxicityModel:
    """Vectors and softmax by Adam over all rows of the sample in each step.

    Every bucket of the sample gets a vector. A bucket enters the average with the weight
    ``z^2 / (z^2 + doubt)``, ``z`` being the test statistic of its shares of the two classes, so
    buckets that tell nothing hardly move and equal evidence counts equally.
    """
    size = 1 << BUCKET_BITS
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(size, np.float32), 0.0, fitted=False)
    by_class = np.bincount(labels, minlength=2)
    shares = np.zeros((2, size))
    for found, label in zip(buckets, labels.tolist()):
        shares[label, found] += 1
    both = shares.sum(axis=0) / len(buckets)
    clean, toxic = shares / by_class[:, None]
    error = np.maximum(both * (1 - both), 1 / len(buckets)) * (1 / by_class).sum()
    evidence = (toxic - clean) ** 2 / error
    trust = (evidence / (evidence + doubt)).astype(np.float32)
    bags = _Bags(buckets, counts, trust)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.01, (size, dims)), rng.normal(0, 1, (dims, 2)), np.zeros(2)]
    means = [np.zeros_like(p) for p in params]
    squares = [np.zeros_like(p) for p in params]
    target = np.eye(2)[labels]
    weight = (0.5 / by_class)[labels][:, None]
    for step in range(1, epochs + 1):
        vectors, soft, bias = params
        bag = bags.averages(vectors)
        logits = bag @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (p - target) * weight
        back = slope @ soft.T
        grads = [
            bags.slopes(back) + decay * vectors,
            bag.T @ slope + decay * soft,
            slope.sum(0),
        ]
        for i, g in enumerate(grads):
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            params[i] = params[i] - rate * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-8)
    vectors, soft, bias = params
    weights = (100.0 * trust * (vectors @ (soft[:, 1] - soft[:, 0]))).astype(np.float32)
    return ToxicityModel(weights, float(bias[1] - bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_slices(batch, "text"):
            parts = list(word_ngrams(data, offsets))
            found = [
                np.unique(np.concatenate([b[at[i] : at[i + 1]] for b, at in parts]), return_counts=True)
                for i in range(len(rows))
            ]
            yield pa.record_batch({
                "label": rows.column("label").cast(pa.int32()),
                "buckets": pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                "counts": pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32())),
            })


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
    sample_rows: int = 4000, **options,
) -> ToxicityModel:
    """Fit on about ``sample_rows`` rows of ``labels``; both inputs hold training rows only."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).cast("int").alias("label")
    ).dropDuplicates(["key"])
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    half = sample_rows / 2
    room = {y: max(half, sample_rows - sizes.get(1 - y, 0)) for y in (0, 1)}
    draw = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("label") == 1, room[1] / max(1, sizes.get(1, 0))).otherwise(room[0] / max(1, sizes.get(0, 0)))
    sample = known.filter(draw < share)
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bags = (
        texts.join(F.broadcast(sample), "key").select("label", "text")
        .mapInArrow(_bags, "label int, buckets array<int>, counts array<int>")
    ).toArrow().combine_chunks()
    order = np.lexsort([bags.column("counts").combine_chunks().value_lengths().to_numpy(), bags.column("label").to_numpy()])
    return train(
        [bags.column("buckets")[int(i)].values.to_numpy() for i in order],
        [bags.column("counts")[int(i)].values.to_numpy() for i in order],
        bags.column("label").to_numpy()[order].astype(int), **options,
    )


def _scored(shared, keep: list[str], text: str, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text):
                yield pa.record_batch({k: rows.column(k) for k in keep} | {name: pa.array(model.scores(data, offsets))})

    return score


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), score: str = "score"
) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every row, from the whole text.

    The model has a fixed size (one float for each of ``2**BUCKET_BITS`` buckets), so it is
    broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{k}` {t}" for k, t in docs.select(*keep).dtypes)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_scored(shared, list(keep), text, score), f"{fields}, `{score}` double")
