"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a document.

One pass measures every text. The labelled rows' counts, sums and products per class are summed over all of them, in
tasks first; the driver sees one matrix per task and class. A class's covariance is shrunk towards its diagonal, its
Cholesky factor is cached in the model, and a score is the logistic of the difference of the log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflux.llm.common import durable, in_parts, one_label, ship, texts

SHRINK, RIDGE = 0.1, 1e-3
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 end of sentence, 7 other ASCII sign, 8 beyond ASCII
for _c in range(256):
    _x = chr(_c)
    _CLASS[_c] = 8 if _c >= 128 else 1 if _x.islower() else 2 if _x.isupper() else 3 if _x.isdigit() else 5 if _x == "\n" else 4 if _x.isspace() else 6 if _x in ".,;:?" else 7 if _c > 32 else 0
FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digits", "stops", "signs", "beyond", "distinct", "repeats", "lines", "line_repeats", "capital_words", "signed_words")


def _ratio(a: float, b: float) -> float:
    """A share on a scale that spreads small values: log of odds with half a count added."""
    return float(np.log((a + 0.5) / (max(b - a, 0.0) + 0.5)))


def measure(text: str) -> list[float]:
    """The statistics of a text, transformed towards normal shapes; an empty text has finite ones as well."""
    raw = text.encode("utf-8", "surrogatepass")
    n = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) if raw else np.zeros(9)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    m, size = len(words), len(raw)
    repeats = sum(map(str.__eq__, words, words[1:]))
    caps = sum(map(str.isupper, words))
    signed = sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words)
    return [np.log1p(size), np.log1p(m), np.log1p(size / max(m, 1)), _ratio(n[2], size), _ratio(n[3], size), _ratio(n[6], size), _ratio(n[7], size), _ratio(n[8], size),
            _ratio(m - len(set(words)), m), _ratio(repeats, m), _ratio(len(lines), m), _ratio(len(lines) - len(set(lines)), len(lines)), _ratio(caps, m), _ratio(signed, m)]


@dataclass
class Discriminant:
    """For each class: log prior, mean, lower Cholesky factor of the shrunk covariance with its inverse, and its log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray

    @classmethod
    def fit(cls, n: np.ndarray, total: np.ndarray, product: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
        """From counts (2), sums (2, d) and sums of products (2, d, d). A class of under two rows borrows the pooled moments."""
        d = total.shape[1]
        pooled_mean = total.sum(0) / max(n.sum(), 1)
        pooled = product.sum(0) / max(n.sum(), 1) - np.outer(pooled_mean, pooled_mean)
        mean, factor = np.zeros((2, d)), np.zeros((2, d, d))
        for c in (0, 1):
            mean[c] = total[c] / n[c] if n[c] else pooled_mean
            s = product[c] / n[c] - np.outer(mean[c], mean[c]) if n[c] >= 2 else pooled
            s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + ridge * np.eye(d)
            factor[c] = np.linalg.cholesky((s + s.T) / 2)
        whiten = np.zeros_like(factor)
        for i in range(d):  # by forward substitution, a row at a time
            whiten[:, i] = -np.einsum("cj,cjk->ck", factor[:, i, :i], whiten[:, :i])
            whiten[:, i, i] += 1
            whiten[:, i] /= factor[:, i, i, None]
        return cls(np.log((n + 1) / (n.sum() + 2)), mean, factor, whiten, 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The posterior of class 1 by Mahalanobis distances through the cached factors."""
        logs = []
        for c in (0, 1):
            z = self.whiten[c] @ (x - self.mean[c]).T
            logs.append(self.prior[c] - 0.5 * ((z * z).sum(0) + self.logdet[c]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, x (the statistics) for each row."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            x = np.array([measure(t.as_py()) for t in b.column(1)], float).reshape(-1, len(FEATURES))
            xs = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), xs], ["doc_id", "x"])

    return texts(documents).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, x array<double>")


def moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and products per class of (y, x) rows: one small row per task and class reaches the driver."""
    d = len(FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            for c in (0, 1):
                if len(own := b.x[b.y == c]):
                    x = np.stack(own.to_numpy())
                    n[c], s[c], p[c] = n[c] + len(x), s[c] + x.sum(0), p[c] + x.T @ x
        yield pd.DataFrame([{"k": 0, "v": np.concatenate([n, s.ravel(), p.ravel()])}])

    parts = labelled.mapInPandas(run, "k int, v array<double>")
    flat = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    v = np.array([r["v"] for r in flat] or [0.0] * (2 + 2 * d + 2 * d * d))
    return v[:2], v[2 : 2 + 2 * d].reshape(2, d), v[2 + 2 * d :].reshape(2, d, d)


def quality(documents: DataFrame, labels: DataFrame, held_out: Column, column: str = "quality", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents.

    held_out is a condition on doc_id; labels of rows that meet it are not learnt from. All other labelled rows are.
    A score depends on the text alone. Null and empty texts are scored like any other; repeated rows get equal scores;
    of repeated labels the largest counts; without labels every score is the prior of two empty classes, 0.5.
    """
    x = durable(measured(documents).withColumn("held_out", held_out))
    known = one_label(labels, column)
    n, s, p = moments(x.where(~F.col("held_out")).join(known, "doc_id").select("y", "x"))
    model = Discriminant.fit(n, s, p)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(v.to_numpy()))) if len(v) else pd.Series([], dtype=float)

    scored = x.select("doc_id", "held_out", score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
