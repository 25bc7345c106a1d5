"""Quality classifier: regularised quadratic discriminant analysis over document statistics (operator 3).

Each document gives a vector of transformed statistics. Class means and covariances are sums over all labelled rows,
added up in partitions first; covariances are shrunk towards their diagonal and towards the pooled covariance. The score is the
posterior of label 1, from differences of log densities by cached Cholesky factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authwatch.llm import text as T

STATISTICS = ("word_length", "punctuation", "symbols", "upper", "digits", "spaces", "repeated_words",
              "repeated_shingles", "repeated_lines", "top_word")
_CLASS = np.zeros(256, np.uint8)  # 1 sentence punctuation, 2 other symbols, 3 upper, 4 digit, 5 space, 6 newline
for _chars, _kind in ((b".,;:?'\"-()", 1), (b"!#$%&*+/<=>@[\\]^_`{|}~", 2), (bytes(range(65, 91)), 3),
                      (bytes(range(48, 58)), 4), (b" \t\r\v\f", 5), (b"\n", 6)):
    _CLASS[list(_chars)] = _kind


def _distinct(value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the most frequent value, by row."""
    order = np.lexsort((value, row))
    v, r = value[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(v))))
    return np.bincount(r[at], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each whole text: roots of shares, held towards 0 where a text is short."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 7 + _CLASS[data], minlength=n * 7).reshape(n, 7) if len(data) else np.zeros((n, 7))
    w = T.words(data, offsets)
    count = np.diff(w.first)
    r5, _, times = T.shingles(w.hashed, w.first, 5)
    shingles, all_shingles = np.bincount(r5, minlength=n), np.bincount(r5, times, minlength=n)
    distinct_words, top_word = _distinct(w.hashed, w.row, n)
    # lines: newline-separated parts that are not empty
    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:] - 1, offsets[:-1] - 1]))
    breaks = breaks[breaks >= -1]
    start, end = breaks[:-1] + 1, breaks[1:] + (data[breaks[1:]] != 10 if len(breaks) > 1 else 0)
    real = end > start
    start, end = start[real], end[real]
    line_row = np.searchsorted(offsets, start, "right") - 1
    prefix = T.prefix_hash(data)
    lines = np.bincount(line_row, minlength=n)
    distinct_lines, _ = _distinct(T.mix(T.span_hash(prefix, start, end)), line_row, n)

    def share(part, whole, prior):
        return np.sqrt(np.maximum(part, 0) / (whole + prior))

    length = np.bincount(w.row, w.end - w.start, minlength=n)
    return np.stack([
        np.log((length + 100) / (count + 20)), share(kinds[:, 1] - 2, size, 100), share(kinds[:, 2], size, 100),
        share(kinds[:, 3] - count, size, 100), share(kinds[:, 4] - 4, size, 100), share(kinds[:, 5], size, 100),
        share(count - distinct_words, count, 20), share(all_shingles - shingles, all_shingles, 20),
        share(lines - distinct_lines, lines, 4), share(top_word - 2, count, 20)], 1)


def with_statistics(text: Column) -> Column:
    """Array of the statistics of a text; null counts as empty."""
    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        parts = [statistics(data, offsets) for _, _, data, offsets in T.slices(column)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
        return pa.ListArray.from_arrays(at, pa.array(x.ravel(), pa.float64()))

    return run(text)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log prior ratio."""

    means: np.ndarray
    whiten: np.ndarray
    log_determinants: np.ndarray
    log_prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            density.append(-0.5 * ((z * z).sum(1) + self.log_determinants[k]))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_prior, -500, 500)))


def _sums(batches):
    """One row of sums for each class of a partition: count, sums, sums of products."""
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        for k in (0, 1):
            x = np.array(batch.loc[batch["label"] == k, "x"].tolist()).reshape(-1, d)
            sums[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
    yield pd.DataFrame({"label": [0, 1], "sums": list(sums)})


def fit(rows: DataFrame, shrink_diagonal: float = 0.1, shrink_pooled: float = 0.05) -> Discriminant | None:
    """Fit on all rows of (label 0 or 1, x statistics). None unless both classes occur.

    Partitions send one vector of sums for each class, and those are added by element in Spark, so what arrives here
    has a fixed size. Rows with a null or other label take no part.
    """
    part = rows.where("label IN (0, 1) AND x IS NOT NULL").select(F.col("label").cast("int"), "x").mapInPandas(
        _sums, "label int, sums array<double>")
    total = part.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(
        F.sum("v").alias("v")).collect()
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for label, at, v in total:
        sums[label, at] = v
    count = sums[:, 0]
    if not count.all():
        return None
    means = sums[:, 1:1 + d] / count[:, None]
    scatter = [sums[k, 1 + d:].reshape(d, d) - count[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / count.sum()
    whiten, logs = [], []
    for k in (0, 1):
        cov = (1 - shrink_pooled) * scatter[k] / count[k] + shrink_pooled * pooled
        cov = (1 - shrink_diagonal) * cov + shrink_diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        logs.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(logs), float(np.log(count[1] / count[0])))


def score(x: Column, model: Discriminant | None) -> Column:
    """Posterior of label 1 from the statistics; 0.5 without a model."""
    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        d = len(STATISTICS)
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        return pa.array(model.score(values) if model else np.full(len(values), 0.5), pa.float64())

    return run(x)
