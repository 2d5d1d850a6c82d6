"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cadrift.llm.common import slices

DIMS = 1 << 18
WORD = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")  # runs of letters and digits, runs of marks
FOLDS = 5


class Hashes(dict):
    """Hash of a word, kept while few are known."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


def features(text: str | None, known: Hashes, dims: int = DIMS, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's lower-cased words and word pairs: counts of unit length."""
    text, index = (text or "").lower(), np.zeros(0, np.int64)
    count = np.zeros(0)
    words = WORD.findall(text)
    for k in range(0, len(words), chunk):
        h = np.fromiter(map(known.__getitem__, words[k:k + chunk + 1]), np.uint64)
        pairs = h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)
        again = [np.full(np.count_nonzero(h[:-d] == h[d:]), d, np.uint64) for d in (1, 2)]  # a word pair of one word, whichever it is
        both = np.concatenate([h[:chunk] & np.uint64(dims - 1), (pairs >> np.uint64(13)) & np.uint64(dims - 1), *again])
        index, at = np.unique(np.concatenate([index, both.astype(np.int64)]), return_inverse=True)
        count = np.bincount(at, np.concatenate([count, np.ones(len(both))]), len(index))
    return index, np.sqrt(count) / np.sqrt(max(count.sum(), 1.0))


class Ftrl:
    """FTRL-proximal for logistic loss; the last weight is the bias."""

    def __init__(self, dims: int = DIMS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.005):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dims + 1), np.zeros(dims + 1)

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        i, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(i)
        g = (sigmoid(w @ x) - label) * x
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - step * w
        self.n[i] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train_task(epochs: int, dims: int):
    def run(batches):
        known, rows = Hashes(), []
        for b in slices(batches):
            rows += [(*features(t, known, dims), y) for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist())]
        model, order = Ftrl(dims), np.random.default_rng(7)
        for _ in range(epochs if rows else 0):
            for k in order.permutation(len(rows)):
                model.update(*rows[k])
        w = model.weights(np.arange(dims + 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()])], names=["weights"])
    return run


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo five; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, epochs: int = 15, dims: int = DIMS) -> np.ndarray:
    """Weights from the labelled documents outside fold 0.

    ``max_rows`` bounds the sample: labelled ids are thinned by hash to about that many, all of
    them where there are fewer. Labels other than 0 and 1 are ignored, a repeated id trains once
    with its lowest label and first text. Without labels all weights are zero.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    sample = known.filter(place < int((1 << 30) * min(1.0, max_rows / max(n, 1))))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(sample), "doc_id")  # about max_rows rows
            .groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("label").alias("label")))
    fitted = (rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"))  # the bounded sample
              .select("text", "label").mapInArrow(train_task(epochs, dims), "weights binary")).first()
    return np.frombuffer(bytes(fitted.weights), np.float32) if fitted else np.zeros(dims + 1, np.float32)


def score_task(weights: np.ndarray, text_at: int, name: str):
    def run(batches):
        known, w = Hashes(), weights.astype(np.float64)
        for b in slices(batches):
            s = []
            for t in b.column(text_at).to_pylist():
                index, value = features(t, known, len(w) - 1)
                s.append(float(sigmoid(w[index] @ value + w[-1])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])
    return run


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``name``, which may not be taken.

    Reads the column ``text`` only; null and empty texts get the prior. One narrow pass.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {name} is taken")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    at = [c.lower() for c in docs.columns].index("text")
    return docs.mapInArrow(score_task(weights, at, name), schema)
