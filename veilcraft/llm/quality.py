"""Quality by regularised quadratic discriminant analysis of document statistics.

Each class of the training labels has a Gaussian over transformed statistics of whole texts. Its covariance is
shrunk towards the pooled one and the pooled one towards its diagonal. The score is the logistic of the difference of log
densities and priors; densities come from Mahalanobis distances by the classes' Cholesky factors, computed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, small_batches
from .labels import held_out, training_labels

#: Parts of the pooled covariance in a class's, and of its diagonal in the pooled one.
SHRINK_CLASS, SHRINK_POOLED = 0.2, 0.1
#: Variance that every statistic has at least.
FLOOR = 1e-4
NAMES = ("words", "word_length", "distinct", "adjacent", "top_word", "upper", "digits", "symbols", "bars", "marks", "stops", "line_words", "lines_alike", "odd_words")
N = len(NAMES)

_UPPER, _DIGITS, _BARS, _STOPS = (np.array([i in x for i in range(256)], dtype=float) for x in (range(65, 91), range(48, 58), (124,), (44, 46)))
_MARKS = np.array([i in b"!?" for i in range(256)], dtype=float)
_SYMBOLS = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ",.!?|'\"-" for i in range(256)], dtype=float)
_LETTERS = np.array([chr(i).isalpha() and i < 128 or i >= 192 for i in range(256)], dtype=float)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, in the order of NAMES; those of an empty text are all zero."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * N
    n = len(words)
    bytes_ = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    letters = max(float(bytes_ @ _LETTERS), 1.0)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    odd = sum(c for w, c in counts.items() if not w.rstrip(b",.").isalpha() and w.isascii())
    root = lambda x: x**0.5
    return [
        np.log1p(n),
        np.log(len(data) / n),
        len(counts) / n ** 0.8,
        root(same / n),
        root(max(counts.values()) / n),
        root(float(bytes_ @ _UPPER) / letters),
        root(float(bytes_ @ _DIGITS) / n),
        root(float(bytes_ @ _SYMBOLS) / n),
        root(float(bytes_ @ _BARS) / n),
        root(float(bytes_ @ _MARKS) / n),
        root(float(bytes_ @ _STOPS) / n),
        np.log1p(n / len(lines)),
        root(1 - len(set(lines)) / len(lines)),
        root(odd / n),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float64())
    for batch in batches:
        rows = [[float(v) for v in statistics(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x: the transformed statistics of each row's text."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_statistics, "doc_id bigint, x array<double>")


class Gaussian(NamedTuple):
    """A class: log prior, mean, inverse of the covariance's Cholesky factor, and the log of its determinant's root."""

    prior: float
    mean: np.ndarray
    whiten: np.ndarray
    log_root: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return self.prior - 0.5 * (z * z).sum(axis=1) - self.log_root


def fit(labelled: DataFrame, shrink_class: float = SHRINK_CLASS, shrink_pooled: float = SHRINK_POOLED) -> tuple[Gaussian | None, Gaussian | None]:
    """The classes 0 and 1 of ``labelled`` (label, x), from counts, means and covariances that Spark aggregates; None for one without rows."""
    pairs = [(i, j) for i in range(N) for j in range(i, N)]
    sums = labelled.groupBy("label").agg(
        F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N)], *[F.covar_pop(F.col("x")[i], F.col("x")[j]).alias(f"c{i}_{j}") for i, j in pairs]
    )
    found = {int(r["label"]): r for r in sums.collect()}
    total = sum(r["n"] for r in found.values())
    covariance = {}
    for k, r in found.items():
        covariance[k] = np.zeros((N, N))
        for i, j in pairs:
            covariance[k][i, j] = covariance[k][j, i] = r[f"c{i}_{j}"]
    pooled = sum((found[k]["n"] * c for k, c in covariance.items()), np.zeros((N, N))) / max(total, 1)
    pooled = (1 - shrink_pooled) * pooled + shrink_pooled * np.diag(np.diag(pooled))
    classes: list[Gaussian | None] = [None, None]
    for k, r in found.items():
        part = min(1.0, shrink_class + N / (r["n"] + N))  # few rows lean on the pooled one
        factor = np.linalg.cholesky((1 - part) * covariance[k] + part * pooled + FLOOR * np.eye(N))
        mean = np.array([r[f"m{i}"] for i in range(N)])
        classes[k] = Gaussian(float(np.log(r["n"] / total)), mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
    return classes[0], classes[1]


def probability(classes: tuple[Gaussian | None, Gaussian | None], x: np.ndarray) -> np.ndarray:
    """Of class 1; a half without any class, and certain where there is only one."""
    zero, one = classes
    if zero is None or one is None:
        return np.full(len(x), 0.5 if zero is one else float(zero is None))
    return 1 / (1 + np.exp(np.clip(zero.log_density(x) - one.log_density(x), -700, 700)))


def _score(classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(classes, x))], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    All labelled rows that aren't held out are learnt from. A null or empty text has the statistics of no words and a score like any
    other. Repeated rows are scored each; null labels and doc_ids aren't learnt from. Without labels every
    score is 0.5. An empty table gives no rows. Other columns are ignored.
    """
    rows = settled(document_statistics(docs))
    labelled = rows.filter(~held_out()).join(training_labels(labels, "quality"), "doc_id")
    scored = rows.mapInArrow(_score(fit(labelled)), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
