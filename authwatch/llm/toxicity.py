"""Toxicity severity by cumulative-link ordinal regression over sparse word features (operator 5).

P(grade > k | text) = sigmoid(theta_k + w . x): all thresholds share the weights, only the cut points differ. x marks which
of the selected words occur in the whole text. The vocabulary and the weights are fitted on a bounded sample of labelled rows
(``per_grade`` rows of each grade); scoring runs over Arrow batches of all rows without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authwatch.llm import text as T
from authwatch.llm.sampling import thin

_SCORE_TYPE = pa.struct([("severity", pa.float64()), ("score", pa.float64()), ("grade", pa.int32())])
SCORE = "severity double, score double, grade int"


def _distinct_words(w: T.Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((w.hashed, w.row))
    h, r = w.hashed[order], w.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


@dataclass
class OrdinalModel:
    """Sorted word hashes with weights, and falling intercepts, one for each threshold between grades."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def linear(self, hashed: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        if not len(self.words):
            return np.zeros(rows)
        at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
        known = self.words[at] == hashed
        return np.bincount(row[known], self.weights[at[known]], minlength=rows)

    def exceed(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and threshold."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] + self.cuts[None, :], -500, 500)))


def _fit(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, levels: int, penalty: float,
         steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Penalised weighted maximum likelihood of the cumulative-link model by Adam; cuts fall by positive gaps."""
    n, d = x.shape
    weight = weight / weight.sum()
    w = np.zeros(d)
    counts = np.array([weight[grade > k].sum() for k in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    logit = np.log(counts / (1 - counts))
    first = logit[0]
    gaps = np.log(np.maximum(-np.diff(logit), 0.1))
    p = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    target = grade[:, None]
    ks = np.arange(levels - 1)
    for t in range(1, steps + 1):
        cuts = p[d] - np.concatenate([[0], np.cumsum(np.exp(p[d + 1:]))])
        s = 1 / (1 + np.exp(-np.clip((x @ p[:d])[:, None] + cuts, -60, 60)))
        upper = np.hstack([np.ones((n, 1)), s])  # P(grade >= k)
        lower = np.hstack([s, np.zeros((n, 1))])  # P(grade > k)
        rows = np.arange(n)
        like = np.maximum(upper[rows, grade] - lower[rows, grade], 1e-12)
        slope = s * (1 - s)
        d_cut = (np.where(target == ks + 1, slope, 0) - np.where(target == ks, slope, 0)) / like[:, None]
        d_cut = d_cut * weight[:, None]
        g_cut = d_cut.sum(0)
        g = np.concatenate([x.T @ d_cut.sum(1) - penalty * p[:d], [g_cut.sum()],
                            [-np.exp(p[d + 1 + k]) * g_cut[k + 1:].sum() for k in range(levels - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return p[:d], p[d] - np.concatenate([[0], np.cumsum(np.exp(p[d + 1:]))])


def fit(rows: DataFrame, text: str = "text", grade: str = "grade", key: str = "doc_id", per_grade: int = 1500,
        max_words: int = 2000, least: float = 3, deviation: float = 3.5, penalty: float = 1e-5, steps: int = 500,
        levels: int | None = None, totals: dict[int, int] | None = None) -> OrdinalModel | None:
    """Fit on about ``per_grade`` rows of each grade 0, 1, 2, ...; null grades take no part.

    Rows count in proportion to how many rows of their grade there are in all (``totals``, counted by default), and
    near copies share the weight of one text: a row's weight falls with the number of rows that agree with it in one
    of four minimum hashes of word shingles. The ``max_words`` words that tell grade 0 from the rest best, by ``deviation``
    standard errors or more, get weights, if rows of weight ``least`` on the side they speak for have them; no share of that
    side is asked for, so a lexicon may be as wide as it is: 3.5 errors are 15 rows of 1,500, or 1 %, against none. With two
    grades and ``levels`` above 2, the higher grade is split into ``levels - 1`` bands by the share of a row's words that
    speak for it, so that severity follows how much of a text is toxic. None if only one grade occurs.
    """
    @F.arrow_udf("struct<words:binary,marks:binary>")
    def word_sets(column: pa.Array) -> pa.Array:
        words, marks = [], []
        for _, _, data, offsets in T.slices(column):
            n = len(offsets) - 1
            w = T.words(data, offsets)
            h, r = _distinct_words(w, n)
            words += [x.tobytes() for x in np.split(h, np.searchsorted(r, np.arange(1, n)))]
            row, shingle, _ = T.shingles(w.hashed, w.first, 5)
            low = np.full((n, 4), np.uint64(2**64 - 1))
            for k in range(4):
                np.minimum.at(low[:, k], row, T.mix(shingle + np.uint64(k + 1)))
            marks += [x.tobytes() for x in low]
        return pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(marks, pa.binary())], ["words", "marks"])

    T.bounded_batches(rows.sparkSession)
    sample, counts = thin(rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(grade).alias("grade")),
                          "grade", F.col("key"), per_grade)
    got = sample.select("grade", word_sets("text").alias("w")).select("grade", "w.*").collect()
    grades = np.array([r[0] for r in got], int)
    if len(np.unique(grades)) < 2:
        return None
    sets = [np.frombuffer(r[1], np.uint64) for r in got]
    marks = np.array([np.frombuffer(r[2], np.uint64) for r in got])
    copies = np.ones(len(got))
    for k in range(4):
        _, at, many = np.unique(marks[:, k], return_inverse=True, return_counts=True)
        copies = np.maximum(copies, many[at])
    single = 1 / copies
    totals = totals or counts
    each = {g: totals.get(g, 0) / (grades == g).sum() for g in np.unique(grades)}
    weight = single * np.array([each[g] for g in grades])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    high = grades > 0
    of_high, of_low = single[high].sum(), single[~high].sum()
    in_high = np.bincount(at, (single * high)[row], minlength=len(words))
    in_low = np.bincount(at, (single * ~high)[row], minlength=len(words))
    a, b = (in_high + 0.5) / (of_high + 1), (in_low + 0.5) / (of_low + 1)
    odds = np.log(a / (1 - a)) - np.log(b / (1 - b))
    pooled = (in_high + in_low) / (of_high + of_low)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / of_high + 1 / of_low))
    surprise = np.abs(in_high / of_high - in_low / of_low) / error
    speaks_for = np.where(in_high / of_high > in_low / of_low, in_high, in_low)
    surprise[speaks_for < least] = 0
    chosen = np.sort(np.argsort(-surprise, kind="stable")[:max_words])
    chosen = chosen[surprise[chosen] > deviation]
    if levels is not None and levels > 2 and grades.max() == 1:
        speaks = np.zeros(len(words), bool)
        speaks[chosen[odds[chosen] > 0]] = True
        part = np.bincount(row, speaks[at], minlength=len(sets)) / np.maximum(1, np.bincount(row, minlength=len(sets)))
        positive = part[high & (part > 0)]
        bands = np.quantile(positive, np.arange(1, levels - 1) / (levels - 1)) if len(positive) else np.zeros(0)
        grades = np.where(high, 1 + np.searchsorted(bands, part), 0)
    x = np.zeros((len(sets), len(chosen)))
    place = np.full(len(words), -1)
    place[chosen] = np.arange(len(chosen))
    own = place[at] >= 0
    x[row[own], place[at[own]]] = 1
    weights, cuts = _fit(x, grades, weight, int(grades.max()) + 1, penalty, steps)
    return OrdinalModel(words[chosen], weights, cuts)


def score(text: Column, model: OrdinalModel | None) -> Column:
    """Struct of ``severity`` (expected grade), ``score`` (chance of any grade above 0) and ``grade`` (most grades exceeded).

    Null and empty texts get the model's intercepts; without a model everything is 0.
    """
    @F.arrow_udf(SCORE)
    def run(column: pa.Array) -> pa.Array:
        parts = []
        for _, _, data, offsets in T.slices(column):
            n = len(offsets) - 1
            if model:
                h, r = _distinct_words(T.words(data, offsets), n)
                exceed = model.exceed(model.linear(h, r, n))
            else:
                exceed = np.zeros((n, 1))
            parts.append(np.stack([exceed.sum(1), exceed[:, 0], (exceed >= 0.5).sum(1)], 1))
        out = np.concatenate(parts) if parts else np.zeros((0, 3))
        return pa.StructArray.from_arrays(
            [pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype(np.int32))], fields=list(_SCORE_TYPE))

    return run(text)
