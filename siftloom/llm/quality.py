"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal updates.

Features of a text are hashes of its words, of their shapes (letters and digits
collapsed, so ``word.`` and ``other.`` share one), of pairs of neighbouring words and
shapes, and a mark for each word that repeats its neighbour. A feature's value is its
count over the count of all, times ``SCALE``; a score is the logistic function of one
sparse dot product.

The model is fitted on a bounded sample (``sample`` labelled rows, those with the
smallest hash of their id): their features are made where the texts are, and one task, which
holds these numbers and no text, makes follow-the-regularised-leader updates in a
fixed order, so a rerun gives the same weights. The weights (2^bits floats) are the only
thing that goes to the executors; scoring is one pass without a shuffle.

Defined results: a null text is empty; an empty text gets the score of the intercept;
labels without a document, or null, teach nothing, a document labelled twice teaches
with its largest label; without labelled rows every score is 0.5; repeated rows are
each scored; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import text_batches

BITS, SCALE, SAMPLE, EPOCHS = 18, 20.0, 8000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3
THRESHOLD = 0.3
MOST_WORDS = 60_000
#: Letters, digits and bytes of other letters count as one class in a shape.
SHAPE = bytes(97 if chr(b).isalnum() or b > 127 else b for b in range(256))


def shape(word: bytes) -> bytes:
    """The word with each run of letters and digits as one ``a`` and each run of a sign once."""
    out = bytearray()
    for b in word.translate(SHAPE):
        if not out or out[-1] != b:
            out.append(b)
    return bytes(out)


class Words(dict):
    """word -> number; hashes and shape hashes by number. Cleared when it has MOST_WORDS words."""

    def __init__(self) -> None:
        self.hash, self.shape = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k >= len(self.hash):
            self.hash, self.shape = (np.concatenate([x, np.zeros(len(x), np.uint64)]) for x in (self.hash, self.shape))
        self.hash[k], self.shape[k] = crc32(word) + 1, crc32(shape(word), 7) + 3
        self[word] = k
        return k


WORDS = Words()


def mixed(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """The top bits of a multiplicative hash."""
    return ((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Feature numbers of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int32)
    if len(WORDS) > MOST_WORDS:
        WORDS.clear()
    at = np.fromiter(map(WORDS.__getitem__, words), np.int64, len(words))
    h, s = WORDS.hash[at], WORDS.shape[at]
    prime = np.uint64(0x100000001B3)
    again = np.count_nonzero(h[1:] == h[:-1])
    return np.concatenate(
        [mixed(h, 0, bits), mixed(s, 1 << 40, bits), mixed(h[:-1] * prime + h[1:], 2 << 40, bits), mixed(s[:-1] * prime + s[1:], 3 << 40, bits), np.full(again, mixed(np.array([5], np.uint64), 4 << 40, bits)[0], np.int32)]
    )


def squash(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


class Ftrl:
    """FTRL-proximal for logistic loss; the last coordinate is the intercept."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (squash(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def counted(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their values, which add up to SCALE."""
    where, count = np.unique(features(text, bits), return_counts=True)
    return where.astype(np.int32), (SCALE * count / max(1, count.sum())).astype(np.float32)


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights and intercept from (features, values, label) rows in their order."""
    at, x, ends, labels = array("i"), array("f"), [0], []
    for where, value, label in rows:
        at.frombytes(where.tobytes())
        x.frombytes(value.tobytes())
        ends.append(len(at))
        labels.append(int(label))
    at, x, model = np.asarray(at), np.asarray(x), Ftrl(bits)
    for _ in range(epochs):
        for a, b, label in zip(ends, ends[1:], labels, strict=False):
            model.learn(at[a:b], x[a:b].astype(np.float64), label)
    return model.weights().astype(np.float32)


def predict(text: str | None, weights: np.ndarray, bits: int = BITS) -> float:
    """The score of a text: the logistic function of its sparse dot product with the weights."""
    at = features(text, bits)
    return squash(float(weights[-1]) + (SCALE * float(weights[at].mean(dtype=np.float64)) if len(at) else 0.0))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from at most ``sample`` of the labelled rows given."""
    chosen = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("label_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [counted(t, bits) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([w.tobytes() for w, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary()), batch.column(2)]
            yield pa.record_batch(cols, names=["doc_id", "at", "x", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(1, 4)), strict=True))
        weights = fit(((np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), label) for at, x, label in given), bits)
        yield pa.record_batch([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    taught = text_batches(rows.select("doc_id", "text", "label")).mapInArrow(measure, "doc_id long, at binary, x binary, label int")
    made = taught.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit("order")), "doc_id").mapInArrow(run, "weights binary").collect()
    return np.frombuffer(bytes(made[0]["weights"]), np.float32) if made else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score of every row, and the columns named in ``keep``."""
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    schema = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                out.append(predict(text, w, bits))
            yield pa.record_batch([batch.column(0), *(batch.column(2 + k) for k in range(len(keep))), pa.array(out, pa.float64())], names=["doc_id", *keep, "score"])

    return text_batches(rows).mapInArrow(run, schema)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score the threshold or more, all their columns."""
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([predict(t, sent.value, bits) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return text_batches(docs).mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that teach nothing: those whose id's crc32, as text, leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
