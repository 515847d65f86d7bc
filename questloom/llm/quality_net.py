"""A quality classifier on random-indexing word vectors.

Every word falls into one of ``WORDS`` buckets by hash, and its shape (capitals, small letters, digits, other characters,
runs as one; a mark of its own if it repeats the word before) into one of ``SHAPES``.  Words and shapes alternate in one
stream.  Each bucket has a fixed sparse index vector, +1 in one dimension and -1 in another; its word vector is the sum of
the index vectors of all its neighbours in the whole corpus.  Tasks sum over what they read, Spark sums over tasks, in
whole numbers, so that the order does not matter; the table of vectors has the same size for any corpus.

A document is the mean and the spread of its vectors, for words and for shapes.  A network of two layers is fitted to
these on a bounded sample of labelled documents, and its output is divided by a temperature that makes its probabilities
fit on the part of the sample that it was not fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.session import stage

WORDS, SHAPES, DIMENSIONS, REACH = 4096, 1024, 32, 2
BUCKETS = WORDS + SHAPES
#: The shape of a word that repeats the one before it.
REPEATED = BUCKETS - 1
#: About so many labelled documents are fitted to, chosen by hash; the only bound on what is used.
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, BATCH = 32, 60, 256
MEMO = 400_000
#: Documents worked on at once.
AT_ONCE = 128
#: Vectors are whole numbers of this fraction, so that sums over a document are exact in any order and any batch (their
#: squares, too, up to some 30 million words).
STEPS = 1 << 14


def shape(word: str) -> str:
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        of_shape = xxhash.xxh3_64_intdigest(shape(word.decode()).encode()) % (SHAPES - 1)
        value = (xxhash.xxh3_64_intdigest(word) % WORDS) << 16 | (WORDS + of_shape)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value


def stream(text: str, buckets: dict) -> np.ndarray:
    """Word and shape buckets of the text in turn."""
    words = text.encode().split()
    both = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    out = np.empty(2 * len(words), np.int64)
    out[0::2] = both >> 16
    out[1::2] = both & 0xFFFF
    if len(words) > 1:
        again = np.fromiter(map(bytes.__eq__, words[1:], words), bool, len(words) - 1)
        out[3::2][again] = REPEATED
    return out


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the dimension of its +1 and that of its -1."""
    draw = np.random.default_rng(seed)
    plus = draw.integers(0, DIMENSIONS, BUCKETS)
    return plus, (plus + draw.integers(1, DIMENSIONS, BUCKETS)) % DIMENSIONS


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n, d0, d1, ...): how often a bucket occurs in all texts, and the sum of its neighbours' index vectors."""
    names = ["n", *[f"d{i}" for i in range(DIMENSIONS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        plus, minus = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS, np.int64)
        seen = np.zeros(BUCKETS, np.int64)
        size = BUCKETS * DIMENSIONS
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                found = []
                for value in batch.column("text").slice(low, AT_ONCE):
                    found += [stream(value.as_py() or "", buckets), np.full(REACH, -1)]  # nobody's neighbours in between
                one = np.concatenate(found)
                seen += np.bincount(one[one >= 0], minlength=BUCKETS)
                for step in range(1, REACH + 1):
                    left, right = one[:-step], one[step:]
                    both = (left >= 0) & (right >= 0)
                    left, right = left[both], right[both]
                    for here, there in ((left, right), (right, left)):
                        here = here * DIMENSIONS
                        total += np.bincount(here + plus[there], minlength=size)
                        total -= np.bincount(here + minus[there], minlength=size)
        here = np.flatnonzero(seen)
        sums = total.reshape(BUCKETS, DIMENSIONS)[here]
        yield pa.RecordBatch.from_arrays(
            [pa.array(here), pa.array(seen[here]), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(DIMENSIONS)]],
            ["bucket", *names],
        )

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{n} bigint" for n in ["bucket", *names]))
    return rows.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(sums: DataFrame) -> np.ndarray:
    """The table of unit vectors in ``STEPS``, one row a bucket: its mean context less that of all buckets."""
    table = np.zeros((BUCKETS, DIMENSIONS + 1))
    for row in sums.collect():  # BUCKETS rows at most
        table[row[0]] = row[1:]
    n, sums_ = table[:, :1], table[:, 1:]
    centred = sums_ / np.maximum(n, 1) - sums_.sum(axis=0) / max(1, n.sum())
    centred[n[:, 0] == 0] = 0
    return np.rint(STEPS * centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9))


def features(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the pooled vector of each text: means, then spreads, of words and of shapes; zeros without words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        table = np.concatenate([sent.value, sent.value**2], axis=1)
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                streams = [stream(v.as_py() or "", buckets) for v in part.column("text")]
                which = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
                counts = np.bincount(which * BUCKETS + np.concatenate(streams), minlength=len(streams) * BUCKETS)
                counts = counts.reshape(-1, BUCKETS).astype(np.float64)
                pooled = []
                for at in (slice(0, WORDS), slice(WORDS, BUCKETS)):
                    mean = counts[:, at] @ table[at] / np.maximum(counts[:, at].sum(axis=1, keepdims=True), 1)
                    spread = np.sqrt(np.maximum(mean[:, DIMENSIONS:] - mean[:, :DIMENSIONS] ** 2, 0))
                    pooled += [mean[:, :DIMENSIONS] / STEPS, spread / STEPS]
                flat = np.concatenate(pooled, axis=1).astype(np.float32)
                width = pa.array(np.arange(len(streams) + 1, dtype=np.int32) * flat.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(width, pa.array(flat.ravel()))], ["doc_id", "features"]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, features array<float>")


class Network(NamedTuple):
    """Two layers over standardised inputs; ``temperature`` divides the output before the logistic function."""

    middle: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float

    def output(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.middle) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """The network fitted to rows ``x`` with labels ``y`` (0 or 1).

    Every fifth row is held back; the epoch that does best there is kept and the temperature is fitted there.  With
    no rows, or one label only, the score is a constant, the share of 1 with one of each added.
    """
    width = x.shape[1] if x.ndim == 2 else 4 * DIMENSIONS
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        zero = np.zeros
        return Network(zero(width), np.ones(width), zero((width, 1)), zero(1), zero(1), np.array(np.log(share / (1 - share))), 1.0)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    back, fitted = order[::5], np.delete(order, np.s_[::5])
    middle, scale = x[fitted].mean(axis=0), x[fitted].std(axis=0) + 1e-3
    state = [draw.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    means, squares, step, best = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state], 0, (np.inf, None)
    inputs = (x - middle) / scale
    for _ in range(EPOCHS):
        for rows in np.array_split(draw.permutation(fitted), -(-len(fitted) // BATCH)):
            w1, b1, w2, b2 = state
            a = inputs[rows]
            h = np.maximum(a @ w1 + b1, 0)
            error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[rows]) / len(rows)
            back_h = error[:, None] * w2 * (h > 0)
            slopes = [a.T @ back_h + 1e-4 * w1, back_h.sum(axis=0), h.T @ error + 1e-4 * w2, error.sum()]
            step += 1
            for i, slope in enumerate(slopes):
                means[i] = 0.9 * means[i] + 0.1 * slope
                squares[i] = 0.999 * squares[i] + 0.001 * slope**2
                state[i] = state[i] - 0.003 * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.999**step)) + 1e-8)
        now = Network(middle, scale, *state, 1.0)
        loss = _loss(now.output(x[back]), y[back])
        if loss < best[0]:
            best = loss, now
    z = best[1].output(x[back])
    tries = np.exp(np.linspace(np.log(0.2), np.log(10), 200))
    return best[1]._replace(temperature=float(min(tries, key=lambda t: _loss(z / t, y[back]))))


def classify(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """One row per row of ``docs``: doc_id and score, the calibrated probability that the document's label is 1.

    Texts alone are looked at.  ``train`` tells, over the rows of ``labels``, which may be learnt from; of these about
    ``most_labelled`` are, chosen by the hash of their id.  Labels other than 0 and 1 are not used; of several labels of
    a document the lowest counts, and of several documents with a labelled id the one with the least vector.  Words are
    looked at whole, however long, and columns other than id and text not at all.  Scores do not depend on how rows are
    partitioned or batched.  Null and empty texts get the score that the network has for no words.  With no
    usable labels all scores are 0.5.
    """
    vectors = word_vectors(context_sums(docs, text_col))
    found = stage(features(docs, vectors, id_col, text_col), "document-vectors")
    usable = labels.where(train & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.min(label_col).alias("label"))
    usable = stage(usable, "usable-labels")
    share = min(1.0, most_labelled / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003))
    # About ``most_labelled`` rows, one an id, so both the side that is sent and what comes back are bounded.
    sample = found.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("features").alias("features")).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["features"]))
    x = np.array([r["features"] for r in sample], np.float64).reshape(len(sample), 4 * DIMENSIONS)
    network = fit(x, np.array([r["label"] for r in sample], np.float64))
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy(zero_copy_only=False)
            scores = network.score(flat.reshape(batch.num_rows, 4 * DIMENSIONS).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return found.mapInArrow(run, f"doc_id {kind}, score double")
