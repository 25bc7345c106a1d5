"""Language identification in two levels (operator 9).

The first level tells language families apart, the second the languages of one family by one-versus-one linear
support vector machines. Features are hashed byte trigrams of the whole lower-cased text, as square roots of shares.
The machines are fitted on a bounded sample (``per_language`` rows of each language, chosen by a hash of the id);
prediction runs over Arrow batches of all rows without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authwatch.llm import text as T
from authwatch.llm.sampling import thin

UNDETERMINED = "und"
#: ISO 639-1 codes by family; a language in none of them is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
PREDICTION = "lang_pred string, score double"
_PREDICTION_TYPE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
_LETTER_BYTES = np.zeros(256, np.uint8)
_LETTER_BYTES[0x41:0x5B] = _LETTER_BYTES[0x61:0x7B] = 1


def features(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """One row of hashed trigram weights for each text, of length 1; all zero where a text has no trigram."""
    low = T.WORD_BYTES[data]
    low[(low >= 0x30) & (low < 0x3A)] = 0
    n = len(offsets) - 1
    out = np.zeros((n, dims), np.float32)
    if len(low) < 3:
        return out
    code = low[:-2].astype(np.uint64) << np.uint64(16) | low[1:-1].astype(np.uint64) << np.uint64(8) | low[2:]
    row = np.repeat(np.arange(n), np.diff(offsets))
    keep = (row[:-2] == row[2:]) & (low[1:-1] > 0)
    at = row[:-2][keep] * dims + (T.mix(code[keep]) % np.uint64(dims)).astype(np.int64)
    out = np.sqrt(np.bincount(at, minlength=n * dims).reshape(n, dims)).astype(np.float32)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def has_letter(text: str | bytes | None) -> bool:
    text = text.decode(errors="ignore") if isinstance(text, bytes) else text or ""
    return any(c.isalpha() for c in text)


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER_BYTES[data], dtype=np.int64)])
    found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = has_letter(data[offsets[i]:offsets[i + 1]].tobytes())
    return found


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias of an L2-regularised squared-hinge machine; y is -1 or 1, both sides weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, momentum = w.copy(), 1.0
    rate = 1 / (penalty + 2 * 2)  # rows have length sqrt(2), the weights sum to 1
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (penalty * ahead - 2 * (x.T @ (weight * y * slack)))
        momentum, before = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2, momentum
        ahead = step + (before - 1) / momentum * (step - w)
        w = step
    return w


@dataclass
class LanguageModel:
    """Fitted machines: one for each family against the rest, and one for each pair of languages in a family."""

    dims: int
    families: list[tuple[str, ...]]
    family_weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: its family's share times the language's mean chance against each other of its family.

        A clear text scores near 1 and the winner's mean chance is at least 0.5, however many languages a family has.
        """
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if len(self.families) > 1:
            chance = 1 / (1 + np.exp(-4 * (x @ self.family_weights.T).astype(float)))
            chance /= np.maximum(chance.sum(1, keepdims=True), 1e-12)
        else:
            chance = np.ones((len(x), 1))
        family = chance.argmax(1)
        names, scores = np.empty(len(x), object), np.zeros(len(x))
        for k, members in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            votes = np.zeros((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    p = 1 / (1 + np.exp(-4 * (x[rows] @ self.pairs[a, members[j]]).astype(float)))
                    votes[:, i] += p
                    votes[:, j] += 1 - p
            share = votes / (len(members) - 1) if len(members) > 1 else np.ones_like(votes)
            best = share.argmax(1)
            names[rows] = np.array(members, object)[best]
            scores[rows] = chance[rows, k] * share[np.arange(len(rows)), best]
        return names, scores


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", dims: int = 4096,
        per_language: int = 500, families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel | None:
    """Fit on about ``per_language`` rows of each non-null language; rows without a letter take no part.

    None if there is nothing to learn from.
    """
    @F.arrow_udf("binary")
    def vectors(column: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offsets in T.slices(column):
            out += [v.astype(np.float16).tobytes() for v in features(data, offsets, dims)]
        return pa.array(out, pa.binary())

    T.bounded_batches(docs.sparkSession)
    rows, _ = thin(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")),
                   "lang", F.col("key"), per_language)
    rows = rows.where("text IS NOT NULL").select("lang", vectors("text").alias("v")).toPandas()
    if not len(rows):
        return None
    x = np.stack([np.frombuffer(v, np.float16).astype(np.float32) for v in rows["v"]])
    rows, x = rows[x.any(1)], x[x.any(1)]
    known = sorted(rows["lang"].unique())
    if not known:
        return None
    groups = [tuple(m for m in known if m in f) for f in families.values()]
    groups = [g for g in groups if g] + [(m,) for m in known if not any(m in f for f in families.values())]
    label = rows["lang"].to_numpy()
    top = np.stack([linear_svm(x, np.where(np.isin(label, g), 1, -1).astype(np.float32)) for g in groups])
    pairs = {}
    for g in groups:
        for i, a in enumerate(g):
            for b in g[i + 1:]:
                own = np.isin(label, (a, b))
                pairs[a, b] = linear_svm(x[own], np.where(label[own] == a, 1, -1).astype(np.float32))
    return LanguageModel(dims, groups, top, pairs)


def predict(text: Column, model: LanguageModel | None) -> Column:
    """Struct of ``lang_pred`` and ``score`` (0 to 1). Null texts and texts without a letter are ``und`` with 0.

    A text with letters but no trigram gets the language its bias terms prefer. Without a model all are ``und``.
    """
    @F.arrow_udf(PREDICTION)
    def run(column: pa.Array) -> pa.Array:
        names, scores = [], []
        for _, _, data, offsets in T.slices(column):
            name = np.full(len(offsets) - 1, UNDETERMINED, object)
            score = np.zeros(len(name))
            rows = np.flatnonzero(_lettered(data, offsets)) if model else np.zeros(0, int)
            if len(rows):
                name[rows], score[rows] = model.predict(features(data, offsets, model.dims)[rows])
            names.append(name)
            scores.append(score)
        names, scores = np.concatenate([[], *names]), np.concatenate([[], *scores])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                          fields=list(_PREDICTION_TYPE))

    return run(text)


def accepted(text: Column, model: LanguageModel | None, languages: tuple[str, ...] | None = None,
             least: float = 0.0) -> Column:
    """Whether a document's language is determined, wanted (any by default) and scored at least ``least``."""
    found = predict(text, model)
    ok = (found["lang_pred"] != UNDETERMINED) & (found["score"] >= least)
    return ok if languages is None else ok & found["lang_pred"].isin(*languages)
