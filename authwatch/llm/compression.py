"""Quality rules by compression bands (operator 11).

A text's bytes are compressed by zstandard as a whole and in fixed chunks. The ratio (compressed to plain bytes) of ordinary
prose stays within a band that narrows and sinks with the length; below it a text repeats itself, above it it is noise
(encoded data, random letters). Each length class has its own limits; a text also falls if too many of its chunks lie outside
the band of a chunk, so that a repetitive or noisy stretch can't hide in a long document. Rules on words come before.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by least length in bytes; texts below the first length have no band."""

    limits: tuple[tuple[int, float, float], ...] = (
        (256, 0.25, 0.90), (1024, 0.25, 0.80), (4096, 0.22, 0.75), (16384, 0.20, 0.72), (65536, 0.18, 0.70))
    chunk: int = 4096
    chunk_limits: tuple[float, float] = (0.20, 0.75)
    most_bad_chunks: float = 0.25
    level: int = 3
    least_words: int = 50
    most_repeated: float = 0.5


_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_BLANKS = b" \t\n\x0b\x0c\r"
RESULT = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()),
    ("n_repetitive_chunks", pa.int64()), ("n_noisy_chunks", pa.int64()), ("reason", pa.string()), ("kept", pa.bool_())])
RESULT_SQL = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
              "ratio double, n_chunks bigint, n_repetitive_chunks bigint, n_noisy_chunks bigint, reason string, kept boolean")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    # pairs, then triples, numbered from 0, so that the products stay below 2^63
    _, pair = np.unique(code[:-1] * len(known) + code[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(known) + code[2:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j:len(words) - 2 + j] |= twice
    return int(covered.sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def ratios(raw: bytes, size: int, compressor: zstandard.ZstdCompressor) -> tuple[float, np.ndarray]:
    """The ratio of the whole text, and of its chunks; the last chunk ends with the text, so that chunks cover every byte."""
    whole = len(compressor.compress(raw)) / len(raw)
    if len(raw) <= size:
        return whole, np.array([whole])
    starts = [*range(0, len(raw) - size, size), len(raw) - size]
    return whole, np.array([len(compressor.compress(raw[a:a + size])) / size for a in starts])


def _judged(raw: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, _BLANKS))
    chars = len(raw.translate(None, _CONTINUED)) - blanks
    repeated = repeated_words(words)
    failed = len(words) < bands.least_words or repeated > bands.most_repeated * len(words)
    counts = (len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), repeated_lines(raw), repeated, failed)
    if not raw:
        return *counts, None, 0, 0, 0, "words" if failed else None, not failed
    whole, chunk = ratios(raw, bands.chunk, compressor)
    low, high = int((chunk < bands.chunk_limits[0]).sum()), int((chunk > bands.chunk_limits[1]).sum())
    several = len(raw) > bands.chunk
    at = bisect_right(bands.limits, len(raw), key=lambda x: x[0]) - 1
    reason = None
    if failed:
        reason = "words"
    elif at >= 0 and whole < bands.limits[at][1]:
        reason = "repetitive"
    elif at >= 0 and whole > bands.limits[at][2]:
        reason = "noise"
    elif several and low > bands.most_bad_chunks * len(chunk):
        reason = "repetitive_chunks"
    elif several and high > bands.most_bad_chunks * len(chunk):
        reason = "noisy_chunks"
    return *counts, whole, len(chunk), low, high, reason, reason is None


def judge(text: Column, bands: Bands = Bands()) -> Column:
    """Struct of the base counts, the ratios, ``reason`` (null, or the first rule that fails) and ``kept``.

    Words are maximal runs without ASCII white space. Whole texts count, however long. A null or empty text has no words, no
    ratio and falls by the rule on words (with ``least_words`` 0 it is kept); equal texts get equal verdicts. The
    reasons are ``words``, ``repetitive``, ``noise``, ``repetitive_chunks`` and ``noisy_chunks``, in this order; the counts
    of chunks outside the band are there for a text of one chunk too, which its length's own limits judge.
    """
    @F.arrow_udf(RESULT_SQL)
    def run(column: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        rows = [_judged(x.as_py() or b"", bands, compressor) for x in column.cast(pa.large_binary())]
        columns = list(zip(*rows)) if rows else [()] * len(RESULT)
        return pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, RESULT)], fields=list(RESULT))

    return run(text)
