"""Operator 3, quality classifier: regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics (lengths, character classes,
word variety, repetition, layout). Per class the mean and covariance are
estimated from summed moments over *all* labelled rows that may be learned from;
no rows are sampled. Covariances are shrunk towards the pooled covariance and then
towards a sphere, and factored once (Cholesky). A score is the logistic of the
difference of the two Gaussian log densities, each a Mahalanobis distance solved
through the cached factor, divided by a fixed temperature.

Scale: one pass over the texts in Arrow batches writes a small feature table;
moments are summed per task, then per class by Spark, and 2 * (d*d + d + 1)
numbers reach the driver. Labels join features, never texts.

Defined cases: null texts count as empty and get the score of the empty text;
labels other than 0 and 1 and ids without text are ignored; an id labelled twice
counts twice; without rows of one label the score is 1 (no label 0) or 0
(no label 1 but some label 0); repeated rows are scored alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdeck.llm.common import Scratch, arrow_rows, word_hashes

NAMES = ("word_bytes", "upper", "digit", "symbol", "stop", "comma", "bang", "distinct", "repeat", "marks", "line_words", "top", "beyond_ascii")
SHRINK_POOLED = 0.1
SHRINK_SPHERE = 0.02
TEMPERATURE = 8.0
THRESHOLD = 0.7
_CLASS = np.zeros(256, np.int64)  # byte class: 0 letter, 1 upper, 2 digit, 3 other symbol, 4 stop, 5 comma, 6 bang, 7 space, 8 line end, 9 beyond ASCII
_CLASS[:128] = 3
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[ord(".")] = 4
_CLASS[ord(",")] = 5
_CLASS[ord("!")] = 6
_CLASS[[9, 11, 12, 13, 32]] = 7
_CLASS[10] = 8
_CLASS[128:] = 9


def features(text: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    data = (text or "").encode()
    n = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10).astype(float) if data else np.zeros(10)
    h = word_hashes(data)
    words, size = len(h), max(len(data), 1)
    some = max(words, 1)
    if words:
        _, counts = np.unique(h, return_counts=True)
        distinct, top = len(counts), counts.max()
    else:
        distinct, top = 0, 0
    # rates of short texts are drawn towards usual ones, so that one short sentence is not extreme
    share = lambda x, usual: np.log((x + 40 * usual) / (size + 40.0))
    per_word = lambda x, usual: np.sqrt((x + 12 * usual) / (words + 12.0))
    same = float((h[1:] == h[:-1]).sum()) if words > 1 else 0.0
    letters = len(data) - n[7] - n[8]
    return np.array([
        np.log((letters + 72.0) / (words + 12.0)), share(n[1], 0.02), share(n[2], 0.005), share(n[3], 0.005),
        per_word(n[4], 0.1), per_word(n[5], 0.1), per_word(n[6], 0.01), np.log((distinct + 12.0) / (some ** 0.9 + 12.0)), per_word(same, 0.01),
        per_word(n[3] + n[6], 0.03), np.log((words + 12.0) / (n[8] + 1.0)), per_word(max(top - 1, 0), 0.08), share(n[9], 0.01)])


@dataclass
class Model:
    """Per class (0, 1): mean, Cholesky factor, log determinant, log prior; ``scale`` standardises the inputs."""
    mean: np.ndarray
    scale: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, float, float]]
    constant: float | None = None

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        mu, chol, logdet, prior = self.classes[k]
        z = np.linalg.solve(chol, ((x - self.mean) / self.scale - mu).T)
        return prior - 0.5 * logdet - 0.5 * (z * z).sum(axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        d = (self.log_density(x, 1) - self.log_density(x, 0)) / TEMPERATURE
        return 1.0 / (1.0 + np.exp(-np.clip(d, -700, 700)))


def fit_moments(n: np.ndarray, total: np.ndarray, outer: np.ndarray) -> Model:
    """The model from class counts (2), sums (2, d) and sums of products (2, d, d)."""
    if not n[0] or not n[1]:
        return Model(np.zeros(0), np.ones(0), [], 0.0 if n[0] else 1.0)
    d = total.shape[1]
    mean = total.sum(0) / n.sum()
    var = np.einsum("kii->i", outer) / n.sum() - mean ** 2
    scale = np.sqrt(np.maximum(var, 1e-6))
    mus, covs = [], []
    for k in (0, 1):
        m = total[k] / n[k]
        mus.append((m - mean) / scale)
        covs.append((outer[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / n.sum()
    classes = []
    for k in (0, 1):
        c = (1 - SHRINK_POOLED) * covs[k] + SHRINK_POOLED * pooled
        c = (1 - SHRINK_SPHERE) * c + SHRINK_SPHERE * max(np.trace(c) / d, 1e-3) * np.eye(d)
        chol = np.linalg.cholesky(c)
        classes.append((mus[k], chol, 2 * float(np.log(np.diag(chol)).sum()), float(np.log(n[k] / n.sum()))))
    return Model(mean, scale, classes)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of every row."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], names=["_id", "x"])

    return src.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def fit(labelled: DataFrame) -> Model:
    """From rows (x, label): moments per task, summed per class by Spark."""
    d = len(NAMES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, d)
            y = np.array(b.column(1).to_pylist(), int)
            for k in (0, 1):
                z = x[y == k]
                sums[k] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["k", "v"])

    rows = (labelled.select("x", "label").mapInArrow(partial, "k int, v array<double>")
            .select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect())
    sums = np.zeros((2, 1 + d + d * d))
    for k, i, v in rows:
        sums[k, i] = v
    return fit_moments(sums[:, 0], sums[:, 1:1 + d], sums[:, 1 + d:].reshape(2, d, d))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str) -> tuple[Model, DataFrame]:
    """The model, and the feature table (_id, x) it was learned from."""
    spark = docs.sparkSession
    s = Scratch(spark, "quality")
    with arrow_rows(spark, 1000):
        x = s.write(feature_table(docs, id_col, text_col), "features")
    marks = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    return fit(x.filter(learn).join(marks.filter(learn), "_id")), x


def classify(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, score, predicted (1 if the score reaches ``threshold``).

    ``learn`` is a condition on the id column ``_id``: the rows whose labels may be learned.
    """
    model, x = learned(docs, labels, learn, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), float).reshape(-1, len(NAMES))
            p = model.score(v) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (x.mapInArrow(run, f"_id {kind}, score double")
            .select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns. Each row is scored where
    it is read: a second pass over the texts instead of a shuffle of them."""
    model, _ = learned(docs, labels, learn, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = model.score(np.array([features(t.as_py()) for t in b.column(at)]))
                yield b.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
