"""Operator 5: quality by hashed word n-gram logistic regression, learnt by FTRL-proximal.

Features are hashed uni- and bigrams of the words as they stand and of their shapes (letters by
case, digits, marks), as shares of the document's n-grams: a score is a sparse dot product. The
model is fitted on at most SAMPLE labelled rows of the learning folds, in a fixed order.

Nulls: null text is the empty text, which scores by the bias alone; rows without a label in {0, 1}
teach nothing; without any label every score is 0.5. Rows with a null id are held out. Repeated
rows are scored each, very long texts whole; a score equal to CUT is predicted 1. Of a document's labels that differ each teaches. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm._common import Words, documents, mix, texts_of
from codequarry.llm._labelled import held_out, sample

BITS = 18
#: Rows that the model is fitted on, at most.
SAMPLE = 8_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-4
#: Weight of a document's n-grams against the bias.
SCALE = 30.0
CUT = 0.3
#: By byte: a for small letters and all beyond ASCII, A for capitals, 0 for digits, else itself.
SHAPES = bytes(97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def grams(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' n-grams, and the number of the text of each."""
    texts = texts_of(column)
    shaped = pa.array([t.encode(errors="replace").translate(SHAPES).decode("ascii") for t in texts], pa.large_string())
    buckets, owners = [], []
    for salt, words in enumerate((Words(column, lower=False), Words(shaped, lower=False))):
        own = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        text = words.texts()
        inside = text[1:] == text[:-1]
        with np.errstate(over="ignore"):
            pairs = mix(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:] + np.uint64(salt + 7))[inside] if len(own) > 1 else own[:0]
            own = mix(own + np.uint64(salt + 1))
        buckets += [own >> np.uint64(64 - bits), pairs >> np.uint64(64 - bits)]
        owners += [text, text[1:][inside]]
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """Logistic regression by follow-the-regularised-leader (proximal), one example at a time."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One update; the places in `at` are distinct."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights of the 2**bits buckets, then the bias."""
    rows, model, bias = sample(docs, labels, label, most), Ftrl((1 << bits) + 1), 1 << bits
    examples = []
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        buckets, owners = grams(pa.array(some["text"], pa.large_string()), bits)
        for i, y in enumerate(some["label"]):
            own, counts = np.unique(buckets[owners == i], return_counts=True)
            examples.append((np.append(own, bias).astype(np.int32), np.append(SCALE * counts / max(1, counts.sum()), 1.0).astype(np.float32), int(y)))
    for _ in range(epochs):
        for at, x, y in examples:
            model.learn(at, x, y)
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row; no shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, step = batch.num_rows, 1000
            out = np.full(n, float(weights[-1]))
            for a in range(0, n, step):
                buckets, owners = grams(batch.column("text").slice(a, step))
                size = min(step, n - a)
                out[a : a + size] += SCALE * np.bincount(owners, weights[buckets], size) / np.maximum(1, np.bincount(owners, minlength=size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
