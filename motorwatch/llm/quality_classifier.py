"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A *word* is a run of letters and digits or a run of other marks. The features of a text are the hashes
of its words, of neighbouring words, of word shapes (capitals, digits, marks as they are) and of
neighbouring shapes, each with its share of the text's features as value; a score is the sparse dot
product with the weights, through the logistic function.

Training reads a sample of the labelled texts whose size is bounded by ``train_rows`` and drawn by a hash of the
id: the same rows at each run. One task trains (the updates are sequential), the weights (2^18 numbers) are a
broadcast of fixed size. Scoring covers every whole text, streams, and shuffles nothing.

Defined results: a NULL or empty text has the bias as its only feature; labels other than 0 and 1, and NULL ones, are
not learnt; an id is learnt once with each of its labels, however often either table lists it, and with the first of its texts in
order; without labelled rows all weights are
0 and each score is 0.5; repeated documents get equal scores; a NULL id is never learnt and not held out.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import over_texts, small_batches

BITS = 18
TRAIN_ROWS = 8000
EPOCHS = 3
THRESHOLD = 0.7
_WORD = re.compile(r"\w+|[^\w\s]+")
_MEMO = 1 << 16


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def shape(word: str) -> str:
    if not (word[0].isalnum() or word[0] == "_"):
        return word[:4]
    if word.isdigit():
        return "0"
    if word.isupper():
        return "A" if len(word) == 1 else "AA"
    return "a" if word.islower() else "Aa"


class Features:
    """Feature numbers of a text, one per occurrence. Hashes of short words are remembered, up to a bound."""

    def __init__(self, bits: int = BITS):
        self.mask, self.memo = (1 << bits) - 1, {}

    def _hashes(self, word: str) -> tuple[int, int]:
        found = zlib.crc32(b"w" + word.lower().encode()), zlib.crc32(b"s" + shape(word).encode())
        if len(word) <= 32:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        memo, hashes = self.memo, self._hashes
        pairs = [memo.get(w) or hashes(w) for w in _WORD.findall(text)]
        if not pairs:
            return np.zeros(0, dtype=np.int64)
        both = np.array(pairs, dtype=np.uint64)
        two = both[:-1] * np.uint64(0x9E3779B1) + both[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
        two ^= two >> np.uint64(23)
        return (np.concatenate([both.ravel(), two.ravel()]) & np.uint64(self.mask)).astype(np.int64)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for the logistic loss; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x >= 0 else math.exp(x) / (1.0 + math.exp(x))


#: Shares are multiplied by this, so that a feature that fills a tenth of a text weighs as much as the bias.
_SCALE = 10.0


def fit_weights(examples, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (text, label) pairs, taken in the order given; the bias comes last."""
    features, bias = Features(bits), 1 << bits
    rows = []
    for text, label in examples:
        at, counts = np.unique(features(text), return_counts=True)
        x = np.append(counts * (_SCALE / max(counts.sum(), 1)), 1.0)
        rows.append((np.append(at, bias).astype(np.int32), x.astype(np.float32), label))
    model = Ftrl(bias + 1)
    for _ in range(epochs):
        for at, x, label in rows:
            model.learn(at, x.astype(np.float64), label)
    return model.weights(slice(None))


def score_text(features: Features, weights: np.ndarray, text: str) -> float:
    at = features(text)
    dot = float(weights[at].sum()) * (_SCALE / len(at)) if len(at) else 0.0
    return sigmoid(dot + float(weights[-1]))


def train(
    docs: DataFrame, labels: DataFrame, target: str = "quality", doc_id: str = "doc_id", text: str = "text",
    train_rows: int = TRAIN_ROWS, bits: int = BITS, epochs: int = EPOCHS,
) -> np.ndarray:
    """Weights learnt from at most about ``train_rows`` labelled documents that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(doc_id).alias("k"), F.col(target).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held_out(F.col("k"))
    )
    known = stage(known.distinct(), "labels")
    total = known.count()
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(11)), F.lit(1 << 30))
    sample = known.where(draw < min(1 << 30, (train_rows << 30) // max(total, 1)))
    rows = docs.select(docs[doc_id].alias("k"), docs[text].alias("t")).join(F.broadcast(sample), "k")
    rows = rows.groupBy("k", "y").agg(F.min(F.coalesce("t", F.lit(""))).alias("t"))  # so repeats stay within the bound
    rows = rows.select(F.xxhash64(F.col("k").cast("string")).alias("draw"), "t", "y")
    ordered = rows.repartition(1).sortWithinPartitions("draw", "t", "y").select("t", "y")

    def run(batches):
        pairs = ((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(fit_weights(pairs, bits, epochs), pa.float64())], names=["w"])

    # One small file of 2^bits numbers: the driver reads it back in order.
    weights = stage(ordered.mapInArrow(run, "w double").select(F.monotonically_increasing_id().alias("i"), "w"), "weights")
    listed = weights.toArrow()  # no Python object for each number
    return listed["w"].to_numpy()[np.argsort(listed["i"].to_numpy())] if listed.num_rows else np.zeros((1 << bits) + 1)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (the document), ``score`` and ``predicted`` for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    def make():
        features, held = Features(bits), shared.value
        return lambda texts: [[score_text(features, held, (t or b"").decode("utf-8", "replace")) for t in texts]]

    scored = over_texts(docs, docs[text], make, "score double")
    return scored.select("row", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
