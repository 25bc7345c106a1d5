"""Removal of byte strings that repeat across documents, by a hash-compared suffix sort (operator 2).

Every window of ``length`` bytes has a minimiser: its gram of GRAM bytes with the least hash. Neighbouring windows with
the same minimiser form a run, and equal windows, wherever they stand, lie in runs with equal grams. So runs are
dealt out by gram, and suffixes that can share ``length`` bytes meet in one bucket:

1. Blocks of documents send the distinct grams of their runs to buckets by gram; each bucket answers, in the same order, which
   grams occur in several documents and which of those occur so often that they must be split.
2. Blocks send the distinct runs with such grams (the bytes, and the smallest id in the block that has them). Runs of
   split grams go as single windows to buckets by the window's hash, so no gram gathers in one bucket.
3. A bucket sorts the suffixes of its runs in groups of one gram: prefix polynomial hashes and binary search give common extensions, so a
   comparison takes a few hash look-ups, and a merge sort orders the suffixes. Neighbours with an extension of ``length``
   bytes are equal windows; their bytes are compared, so a hash collision cannot pass. The answer is, for each run, which of its
   windows start in a document with a smaller id.
4. Blocks mark the bytes of those windows.

Blocks hold documents by a hash of their id and have bounded bytes, whatever the number of documents. Requests and answers
travel as arrays, one row for each pair of block and bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from authwatch.llm import text as T

GRAM = 16
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
SPLIT_ABOVE = 20_000
MOST_RUNS = (1 << 15) - 1  # a block counts a gram's runs up to here, which is beyond any SPLIT_ABOVE
_U = np.uint64
_LAST = np.int64(2 ** 63 - 1)
_PIECE = 1 << 16


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram hash, first window, number of windows, place of the gram) of all runs, as positions in ``data``.

    A window never leaves its row.
    """
    parts = []
    width = length - GRAM + 1
    inverse = T.powers(_PIECE + length, T._INVERSE)
    for at in range(0, max(0, len(data) - length + 1), _PIECE):
        stop = min(len(data), at + _PIECE + length - 1)
        prefix = T.prefix_hash(data[at:stop])
        n = stop - at - GRAM + 1
        gram = T.mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[:n])
        # the leftmost gram of least hash: high bits of the hash, then the place
        low = (gram >> _U(20) << _U(20)) | np.arange(n, dtype=_U)
        span = 1
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        place = (low & _U((1 << 20) - 1)).astype(np.int32)
        # windows that would run over the end of a row
        ends = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, stop)] - at
        over = np.zeros(len(place) + 1, np.int32)
        np.add.at(over, np.clip(ends - length + 1, 0, len(place)), 1)
        np.add.at(over, np.clip(ends, 0, len(place)), -1)
        ok = np.cumsum(over[:-1]) == 0
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
        edge = np.append(np.flatnonzero(new), len(place))
        real = ok[edge[:-1]]
        first = edge[:-1][real]
        parts.append((gram[place[first]], first + at, np.diff(edge)[real], place[first].astype(np.int64) + at))
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


class Block:
    """The documents of a block in the order of their ids, and the runs of their windows."""

    def __init__(self, rows: pd.DataFrame, length: int):
        rows = rows.assign(raw=[(t or "").encode() for t in rows["text"]])
        rows = rows.sort_values(["doc_id", "raw"], kind="stable")
        self.rows, self.length = rows, length
        self.ids = rows["doc_id"].to_numpy()
        self.data = np.frombuffer(b"".join(rows["raw"]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows["raw"]], dtype=np.int64)])
        self.gram, self.first, self.size, self.place = runs_of(self.data, self.offsets, length)
        self.run_id = self.ids[np.searchsorted(self.offsets, self.first, "right") - 1]

    @cached_property
    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams in order, and 16 bits each: runs up to MOST_RUNS, and the high bit if several documents have it."""
        order = np.argsort(self.gram)
        g, d = self.gram[order], self.run_id[order]
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1])[:len(g)])
        if not len(at):
            return g, np.zeros(0, np.uint16)
        count = np.minimum(np.diff(np.append(at, len(g))), MOST_RUNS)
        several = np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)
        return g[at], (count | several * (MOST_RUNS + 1)).astype(np.uint16)

    def shared_runs(self, verdict: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, windows, bucket key, id, gram and its place in the run, of all runs to be sorted; split ones as
        single windows."""
        known, _ = self.known
        state = verdict[np.searchsorted(known, self.gram)] if len(known) else np.zeros(0, np.uint8)
        whole, split = state == 1, state == 2
        first = np.repeat(self.first[split], self.size[split])
        nth = np.arange(len(first)) - np.repeat(np.cumsum(self.size[split]) - self.size[split], self.size[split])
        first = first + nth
        key = T.mix(_hashes(self.data, first, first + self.length) + _U(1))
        times = self.size[split]
        return tuple(np.concatenate(x) for x in (
            (self.first[whole], first), (self.size[whole], np.ones(len(first), np.int64)), (self.gram[whole], key),
            (self.run_id[whole], np.repeat(self.run_id[split], times)), (self.gram[whole], np.repeat(self.gram[split], times)),
            (self.place[whole] - self.first[whole], np.repeat(self.place[split], times) - first)))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, with prefix hashes over pieces of the data."""
    out = np.zeros(len(start), _U)
    reach = int((end - start).max()) if len(start) else 0
    order = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[order], np.arange(0, len(data) + _PIECE, _PIECE))
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        if i < j:
            own, base = order[i:j], k * _PIECE
            prefix = T.prefix_hash(data[base:base + _PIECE + reach])
            out[own] = T.span_hash(prefix, start[own] - base, end[own] - base)
    return out


def distinct_runs(data: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(representative, class) of runs with equal bytes; equal hashes are confirmed by comparing the bytes."""
    end = first + size + length - 1
    h = T.mix(_hashes(data, first, end) + size.astype(_U))
    order = np.lexsort((first, h))
    hs = h[order]
    new = np.append(True, hs[1:] != hs[:-1])[:len(hs)]
    same = np.flatnonzero(~new)
    a, b = order[same - 1], order[same]
    new[same[~equal_bytes(data, first[a], first[b], np.where(size[a] == size[b], size[a] + length - 1, -1))]] = True
    label = np.empty(len(h), np.int64)
    label[order] = np.cumsum(new) - 1
    return order[new], label


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size]; a negative size never does."""
    out = size >= 0
    for k in range(0, int(size.max()) if len(size) else 0):
        live = np.flatnonzero(out & (k < size))
        if not len(live):
            break
        out[live] = data[a[live] + k] == data[b[live] + k]
    return out


class Suffixes:
    """Suffixes of ``data`` compared over at most ``depth`` bytes by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data = np.concatenate([data, np.zeros(depth, np.uint8)])
        self.depth = depth
        self.prefix = np.zeros(len(self.data) + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * T.powers(len(self.data)), out=self.prefix[1:])
        self.inverse = T.powers(len(self.prefix), T._INVERSE)

    def head(self, start: np.ndarray) -> np.ndarray:
        """The first eight bytes as a number that orders like them."""
        out = np.zeros(len(start), _U)
        for k in range(min(8, self.depth)):
            out = out << _U(8) | self.data[start + k]
        return out

    def same(self, a: np.ndarray, b: np.ndarray, n) -> np.ndarray:
        return (self.prefix[a + n] - self.prefix[a]) * self.inverse[a] == (self.prefix[b + n] - self.prefix[b]) * self.inverse[b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most ``depth``: binary search over equal span hashes."""
        out = np.full(len(a), self.depth)
        live = np.flatnonzero(~self.same(a, b, self.depth))
        a, b = a[live], b[live]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.depth - 1)
        for _ in range(self.depth.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.same(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[live] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at a sorts before the one at b."""
        n = self.common(a, b)
        return (n < self.depth) & (self.data[a + n] < self.data[b + n])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes by group, then as strings: by their first bytes, then by a merge sort of those that
        share them."""
        head = self.head(start)
        order = np.lexsort((head, group))
        g, h = group[order], head[order]
        begin = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))[:len(g)])
        size = np.diff(np.append(begin, len(g)))
        many = np.flatnonzero(np.repeat(size, size) > 1)
        begin, size = np.repeat(begin, size)[many], np.repeat(size, size)[many]
        order[many] = self._merge_sort(start, order[many], many - begin, size)
        return order

    def _merge_sort(self, start: np.ndarray, item: np.ndarray, nth: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Bottom-up merge sort of all groups at once; ``nth``: place in the group, ``total``: its size.

        Halves that are in order already are left alone. Else an item's place after a merge is its place in its own
        half plus the number of items of the other half before it, found by binary search.
        """
        base = np.arange(len(item)) - nth
        width = 1
        while len(total) and width < int(total.max()):
            within = nth % (2 * width)
            middle = np.flatnonzero(within == width)  # first of a right half
            turned = np.zeros(len(item), bool)
            turned[middle - width] = self.less(start[item[middle]], start[item[middle - 1]])
            live = np.flatnonzero(turned[base + nth - within])
            pair, right = (nth - within)[live], within[live] >= width
            other = pair + np.where(right, 0, width)
            low, high = np.zeros(len(live), np.int64), np.clip(total[live] - other, 0, width)
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                mine, theirs = start[item[live[open_]]], start[item[base[live[open_]] + other[open_] + mid]]
                behind = right[open_]
                # equal suffixes keep their order: the right half goes behind equal ones of the left half
                before = self.less(np.where(behind, mine, theirs), np.where(behind, theirs, mine)) ^ behind
                low[open_], high[open_] = np.where(before, mid + 1, low[open_]), np.where(before, high[open_], mid)
            moved = item.copy()
            moved[base[live] + pair + within[live] - np.where(right, width, 0) + low] = item[live]
            item = moved
            width *= 2
        return item


def smaller_start(data: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int,
                  tag: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A bit for each window of each run: whether an equal window starts in a run with a smaller id.

    ``tag``: a hash of the run's gram, ``gram``: its place in the run. Equal windows have equal grams at equal places,
    so suffixes are sorted in groups of those, and a gram with one distinct run needs no sorting.
    """
    rep, label = distinct_runs(data, first, size, length)
    least = np.full(len(rep), _LAST)
    np.minimum.at(least, label, ids)
    begin = np.cumsum(size[rep]) - size[rep]
    found = np.repeat(least, size[rep])  # the smallest id that has the window
    order = np.argsort(tag[rep], kind="stable")
    t = tag[rep][order]
    alone = np.append(True, t[1:] != t[:-1])[:len(t)] & np.append(t[1:] != t[:-1], True)[:len(t)]
    meet = order[~alone]
    of = np.repeat(meet, size[rep[meet]])
    nth = np.arange(len(of)) - np.repeat(np.cumsum(size[rep[meet]]) - size[rep[meet]], size[rep[meet]])
    start = first[rep[of]] + nth
    if len(of):
        suffixes = Suffixes(data, length)
        group = tag[rep[of]].astype(_U) << _U(8) | (gram[rep[of]] - nth).astype(_U)
        order = suffixes.sort(start, group)
        s, g = start[order], group[order]
        equal = np.zeros(len(s), bool)
        near = np.flatnonzero(g[1:] == g[:-1]) + 1
        equal[near] = suffixes.common(s[near - 1], s[near]) >= length
        pairs = np.flatnonzero(equal)
        if not equal_bytes(data, s[pairs - 1], s[pairs], np.full(len(pairs), length)).all():
            # a collision of hashes: compare as plain strings instead
            text = np.lib.stride_tricks.sliding_window_view(data, length)[start]
            order = np.lexsort(text.T[::-1])
            equal[1:] = (text[order][1:] == text[order][:-1]).all(1)
        same = np.cumsum(~equal) - 1
        lowest = np.full(int(same[-1]) + 1, _LAST)
        np.minimum.at(lowest, same, least[of[order]])
        found[(begin[of] + nth)[order]] = lowest[same]
    # each run takes part with its own id
    run_of = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(run_of)) - np.repeat(np.cumsum(size) - size, size)
    hit = found[begin[label[run_of]] + place] < ids[run_of]
    bits = np.zeros(len(first), _U)
    np.bitwise_or.at(bits, run_of[hit], _U(1) << place[hit].astype(_U))
    return bits


def _blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def _short(grams: np.ndarray) -> bytes:
    """The low five bytes of each hash: enough within a bucket, and a collision only adds runs to compare."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _dealt(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets that get something, and the places of the keys that each gets, in order."""
    bucket = (keys >> _U(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    if not len(order):
        return []
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[x[0]]), x) for x in np.split(order, cut)]


def _block(rows: pa.Table, length: int) -> Block:
    return Block(rows.select(["doc_id", "text"]).to_pandas(), length)


def _request_grams(length: int, buckets: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        grams, state = _block(rows, length).known
        got = _dealt(grams, buckets)
        return pa.table({"bucket": pa.array([b for b, _ in got], pa.int32()),
                         "block": pa.array([rows["block"][0].as_py()] * len(got), pa.int32()),
                         "grams": pa.array([_short(grams[x]) for _, x in got], pa.binary()),
                         "state": pa.array([_blob(state[x]) for _, x in got], pa.binary())})

    return run


def _answer_grams(split_above: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [_long(x) for x in rows["grams"]]
        state = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["state"]])
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        g = every[order]
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        blocks = np.diff(np.append(at, len(g)))
        runs = np.add.reduceat((state[order] & MOST_RUNS).astype(np.int64), at)
        shared = (blocks > 1) | (np.maximum.reduceat(state[order], at) > MOST_RUNS)
        verdict = np.where(shared, np.where(runs > split_above, 2, 1), 0).astype(np.uint8)
        out = np.empty(len(every), np.uint8)
        out[order] = np.repeat(verdict, blocks)
        cut = np.cumsum([len(x) for x in grams])[:-1]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "verdict": [_blob(x) for x in np.split(out, cut)]})

    return run


def _verdicts(block: Block, answers: pd.DataFrame, buckets: int) -> np.ndarray:
    """The buckets' answers, brought into the order of the block's grams."""
    grams, _ = block.known
    out = np.zeros(len(grams), np.uint8)
    answer = dict(zip(answers["bucket"], answers["verdict"]))
    for b, x in _dealt(grams, buckets):
        out[x] = np.frombuffer(answer[b], np.uint8)
    return out


def _chosen(block: Block, verdict: np.ndarray, buckets: int):
    """Distinct runs to be sorted with the block's least id, by bucket; and the class of each run of the block."""
    first, size, key, ids, gram, place = block.shared_runs(verdict)
    rep, label = distinct_runs(block.data, first, size, block.length)
    least = np.full(len(rep), _LAST)
    np.minimum.at(least, label, ids)
    return first, size, ids, rep, label, least, _dealt(key[rep], buckets), (gram >> _U(8)).astype(np.uint32), place.astype(np.uint8)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return data[at]


def _request_runs(length: int, buckets: int) -> Callable:
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["bucket", "block", "bytes", "size", "ids", "tag", "place"]
        columns = {c: [] for c in names}
        if len(rows) and len(answers):
            block = _block(rows, length)
            first, size, _, rep, _, least, by_bucket, tag, place = _chosen(block, _verdicts(block, answers.to_pandas(), buckets), buckets)
            for b, x in by_bucket:
                columns["bucket"].append(b)
                columns["block"].append(rows["block"][0].as_py())
                columns["bytes"].append(_blob(_gather(block.data, first[rep[x]], size[rep[x]] + length - 1)))
                columns["size"].append(_blob(size[rep[x]].astype(np.uint8)))
                columns["ids"].append(_blob(least[x]))
                columns["tag"].append(_blob(tag[rep[x]]))
                columns["place"].append(_blob(place[rep[x]]))
        return pa.table({c: pa.array(columns[c], pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(names)})

    return run


def _answer_runs(length: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in rows["size"]]
        size = np.concatenate(sizes)
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"]])
        data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
        span = size + length - 1
        tag = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["tag"]])
        place = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["place"]]).astype(np.int64)
        bits = smaller_start(data, np.cumsum(span) - span, size, ids, length, tag, place)
        cut = np.cumsum([len(x) for x in sizes])[:-1]
        return pd.DataFrame({"block": rows["block"], "run_bucket": rows["bucket"], "bits": [_blob(x) for x in np.split(bits, cut)]})

    return run


def _finish(length: int, buckets: int, as_text: bool) -> Callable:
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = _block(rows, length)
        covered = np.zeros(len(block.data) + 1, np.int32)
        answers = answers.to_pandas()
        grams, runs = answers[answers["verdict"].notna()], answers[answers["bits"].notna()]
        if len(grams):
            first, size, ids, rep, label, least, by_bucket, *_ = _chosen(block, _verdicts(block, grams, buckets), buckets)
            bits = np.zeros(len(rep), _U)
            answer = dict(zip(runs["run_bucket"], runs["bits"]))
            for b, x in by_bucket:
                bits[x] = np.frombuffer(answer[b], _U)
            # beyond the least id of the block, every window of the run starts in a document with a smaller id
            whole = (_U(1) << size.astype(_U)) - _U(1)
            mine = np.where(ids > least[label], whole, bits[label])
            all_ = mine == whole
            np.add.at(covered, first[all_], 1)
            np.add.at(covered, first[all_] + size[all_] + length - 1, -1)
            first, mine = first[~all_ & (mine > 0)], mine[~all_ & (mine > 0)]
            for k in range(length - GRAM + 1):
                start = first[(mine >> _U(k)) & _U(1) == 1] + k
                np.add.at(covered, start, 1)
                np.add.at(covered, start + length, -1)
        gone = np.cumsum(covered[:-1]) > 0
        edge = gone & ~np.append(False, gone[:-1])
        edge[block.offsets[:-1][block.offsets[:-1] < len(gone)]] |= gone[block.offsets[:-1][block.offsets[:-1] < len(gone)]]
        kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.offsets, block.offsets[1:])]
        size, left = np.diff(block.offsets), np.array([len(x) for x in kept], np.int64)
        spans = np.diff(np.concatenate([[0], np.cumsum(edge)])[block.offsets])
        # all other columns stay as they came, in the block's order
        own = rows.select(["doc_id", "no_id", "carried"]).take(pa.array(block.rows.index.to_numpy(), pa.int64()))
        return pa.table({
            **{c: own[c] for c in own.column_names}, "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(size - left, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            "kept": pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())})

    return run


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50,
                   block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
                   split_above: int = SPLIT_ABOVE, carry: Column | None = None, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row for each row of ``docs``; and ``carried``, the
    value of the column ``carry`` (of any type, untouched) where one is given.

    Removed are the UTF-8 bytes covered by a string of ``length`` bytes that also starts in a row with a smaller id.
    ``kept`` is what remains, as binary, or with ``as_text`` as a string without cut characters. Null texts are empty. Rows with the same id do not act on each other, and a
    null id counts as larger than all others. ``length`` is at least GRAM + 1 and at most GRAM + 63, ``split_above``
    less than MOST_RUNS.
    """
    if not GRAM < length < GRAM + 64 or not split_above < MOST_RUNS:
        raise ValueError("length or split_above out of range")
    spark = docs.sparkSession
    T.bounded_batches(spark)
    docs = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(int(_LAST))).alias("doc_id"),
                       F.col(key).isNull().alias("no_id"), F.col(text).alias("text"),
                       (F.lit(None).cast("boolean") if carry is None else carry).alias("carried"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(tasks, math.ceil(total / block_bytes))
    buckets = max(tasks, math.ceil(total / bucket_bytes))
    # by id and text: rows of one id, or without one, fill many blocks
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    grams = docs.groupBy("block").applyInArrow(
        _request_grams(length, buckets), "bucket int, block int, grams binary, state binary")
    # one plan for all steps, so that the exchanges of the texts and of the grams are made once and used again
    verdicts = grams.groupBy("bucket").applyInPandas(
        _answer_grams(split_above), "block int, bucket int, verdict binary")
    runs = docs.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(
        _request_runs(length, buckets), "bucket int, block int, bytes binary, size binary, ids binary, tag binary, place binary")
    bits = runs.groupBy("bucket").applyInPandas(_answer_runs(length), "block int, run_bucket int, bits binary")
    answers = verdicts.unionByName(bits, allowMissingColumns=True)
    kind = T_.StructType([docs.schema[c] for c in ("doc_id", "no_id", "carried")] + T_.StructType.fromDDL(
        "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept " + ("string" if as_text else "binary")).fields)
    out = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(length, buckets, as_text), kind)
    out = out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
    return out.drop("carried") if carry is None else out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns, with the repeats taken out of the text (and out of ``n_chars``, where there is such a column).

    A character that lost some of its bytes goes as a whole. Texts without repeats stay as they are, also null ones. The
    other columns travel with the text as one struct, so that no second exchange of texts joins them again.
    """
    others = [c for c in docs.columns if c not in (key, text)]
    # by place, as names may differ in case only
    row = F.struct(F.col(text).isNull().alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    # texts are decoded where they are cut, so that no task keeps a second Python worker for it
    found = repeated_bytes(docs, key, text, carry=row, as_text=True, **options)
    out = found.select(F.col("doc_id").cast(docs.schema[key].dataType).alias("doc_id"), "n_removed",
                       F.when(~F.col("carried.none"), F.col("kept")).alias("kept"), "carried")
    columns = []
    for c in docs.columns:
        if c == key:
            column = F.col("doc_id")
        elif c == text:
            column = F.col("kept")
        else:
            column = F.col("carried")[f"c{others.index(c)}"]
            if c == "n_chars":
                column = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[c].dataType)).otherwise(column)
        columns.append(column.alias(c))
    return out.select(*columns)
