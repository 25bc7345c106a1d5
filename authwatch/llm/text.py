"""Vectorised text helpers for Arrow batches: bounded slices, words as hashes, word shingles.

A word is a maximal run of ASCII letters (lower-cased), digits and non-ASCII characters. All functions take
whole texts; batches are cut into slices of about ``SLICE`` bytes so that temporary arrays stay small.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Byte -> lower-cased word byte, or 0 where the byte separates words.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x80:] = np.arange(0x80, 0x100)
#: The same as a table for ``bytes.translate``; separators become spaces.
WORD_TABLE = bytes(int(x) or 32 for x in WORD_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept between calls for the usual slice, as workers live long."""
    kept = n <= SLICE + (SLICE >> 2)
    have = _powers.get(base) if kept else None
    if have is None:
        have = np.full(SLICE + (SLICE >> 2) if kept else n, base, _U)
        have[:1] = 1
        np.multiply.accumulate(have, out=have)
        if kept:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j] + 1) * base^j for j < i, modulo 2^64."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of data[start:end], from prefix hashes."""
    inverse = powers(len(prefix), _INVERSE)
    return (prefix[end] - prefix[start]) * inverse[start]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with about SLICE bytes; null is empty.

    A longer text makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Words(NamedTuple):
    """The words of a slice: hash, row, first word of each row and the end, byte span, lower-cased bytes."""

    hashed: np.ndarray
    row: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Split a slice into words."""
    low = WORD_BYTES[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = low > 0
    joint = inside[:-1] & inside[1:]
    joint[offsets[(offsets > 0) & (offsets < len(data))]] = False
    start = np.flatnonzero(inside[1:-1] & ~joint[:-1])
    end = np.flatnonzero(inside[1:-1] & ~joint[1:]) + 1
    hashed = mix(span_hash(prefix_hash(low), start, end) + (end - start).astype(_U))
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(hashed, row, np.searchsorted(start, offsets), start, end, low)


def shingles(hashed: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles, sorted by row and hash.

    A row of 1 to size - 1 words is one shingle; a row without words has none.
    """
    n = len(hashed)
    count = np.diff(first)
    rows = np.arange(len(count))
    total = np.zeros(n, _U)
    for j in range(size):
        part = np.zeros(n, _U)
        part[:n - j] = hashed[j:] * _U(pow(_BASE, 2 * j + 3, 1 << 64)) if n > j else 0
        row_end = np.repeat(first[1:], count)
        part[np.arange(n) + j >= row_end] = 0
        total += part
    keep = np.arange(n) + size <= np.repeat(first[1:], count)
    short = (count > 0) & (count < size)
    keep[first[:-1][short]] = True
    h, r = mix(total[keep]), np.repeat(rows, count)[keep]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(h)))


def bounded_batches(spark, rows: int = 2000) -> None:
    """Prepare a session for the operators' Python workers.

    Arrow batches stay small enough for two workers beside the executor's heap, and workers find this package where
    only the driver's path names it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, known), root])
