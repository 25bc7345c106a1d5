"""Benchmark decontamination with a generalised suffix automaton over words (operator 6).

The test items are normalised to words and put into one automaton. Every document streams through it: the length
of the longest suffix of the words read so far that occurs in an item is tracked, and where it reaches the window
the window's words are hit. Work on a document is linear in its words and needs no shuffle.

The automaton is sent to the tasks in parts of at most ``max_words`` item words; more items make more parts, each
a further pass over the same rows, so what one task holds does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authwatch.llm import text as T
from authwatch.llm.columns import free_name

SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()),
                                ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
MATCH_TYPE = pa.struct([("n_words", pa.int64()), ("spans", SPAN_TYPE), ("items", pa.list_(pa.string()))])
MATCH_SQL = ("n_words bigint, spans array<struct<first:int,end:int,first_byte:bigint,end_byte:bigint>>, "
             "items array<string>")


class Automaton:
    """Suffix automaton of many word sequences, with the items of each window.

    ``found(v, l)`` tells, for a state and a matched length, how many words back the longest window that ends here
    reaches, and which items have a window that ends here.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, item_words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item_words]
            if ids:
                sequences.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in sequences)]) if sequences else 0
        self._mark(sequences)
        bigrams = {(a, b) for _, ids in sequences for a, b in zip(ids, ids[1:])}
        n = len(self.vocabulary) + 1
        self.bigrams = np.array(sorted(a * n + b for a, b in bigrams), np.int64)
        self.spelling = [b"", *self.vocabulary]
        blob = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        offsets = np.cumsum([0, *map(len, self.vocabulary)])
        hashed = T.words(blob, offsets).hashed if sequences else np.zeros(0, np.uint64)
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, nxt: dict[int, int], length: int) -> int:
        self.next.append(nxt)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, sequences: list[tuple[str, list[int]]]) -> None:
        """Windows: the state of each full window or whole short item, with its items; then the nearest marks."""
        marks: dict[int, dict[int, set[str]]] = {}
        for item, ids in sequences:
            size = min(self.window, len(ids))
            v, matched = 0, 0
            for c in ids:
                v = self.next[v][c]
                matched += 1
                if matched < size:
                    continue
                u = v
                while self.length[self.link[u]] >= size:
                    u = self.link[u]
                marks.setdefault(u, {}).setdefault(size, set()).add(item)
        self.marks = {u: sorted(m.items(), reverse=True) for u, m in marks.items()}
        self.marked = [-1] * len(self.next)  # nearest marked state on the way to the root, itself included
        for v in np.argsort(self.length, kind="stable"):
            self.marked[v] = int(v) if v in self.marks else self.marked[self.link[v]] if v else -1

    def found(self, v: int, matched: int) -> tuple[int, list[set[str]]]:
        longest, items = 0, []
        u = self.marked[v]
        while u > 0:
            for size, found in self.marks[u]:
                if u != v or matched >= size:
                    longest = max(longest, size)
                    items.append(found)
            u = self.marked[self.link[u]]
        return longest, items

    def ids(self, w: T.Words) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(w.hashed), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, w.hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w.hashed, self.order[at] + 1, 0)

    def stretches(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal stretches whose adjacent words all are adjacent in some item; only there can windows match."""
        n = len(self.vocabulary) + 1
        joint = np.zeros(len(ids) + 1, bool)
        if len(ids) > 1 and len(self.bigrams):
            pair = ids[:-1] * n + ids[1:]
            at = np.minimum(np.searchsorted(self.bigrams, pair), len(self.bigrams) - 1)
            joint[1:-1] = (self.bigrams[at] == pair) & (ids[:-1] > 0) & (ids[1:] > 0)
        joint[first] = False
        start = np.flatnonzero(~joint[:-1] & (ids > 0))
        end = np.flatnonzero(~joint[1:] & (ids > 0)) + 1
        long = end - start >= self.shortest
        return start[long], end[long]

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [first, end) of hit words, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        nxt, link, length = self.next, self.link, self.length
        v = matched = 0
        for i, c in enumerate(ids):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                matched += 1
            if matched < self.shortest or self.marked[v] < 0:
                continue
            longest, found = self.found(v, matched)
            if longest:
                for f in found:
                    items |= f
                first = i + 1 - longest
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))
        return spans, items


def _matcher(automaton: Automaton) -> Callable[[pa.Array], pa.Array]:
    def match(text: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offsets in T.slices(text):
            w = T.words(data, offsets)
            rows = [{"n_words": int(n), "spans": [], "items": set()} for n in np.diff(w.first)]
            ids = automaton.ids(w)
            for start, end in zip(*automaton.stretches(ids, w.first)):
                known = ids[start:end].tolist()
                # equal hashes are not enough: compare the words themselves
                known = [k if automaton.spelling[k] == w.low[w.start[j]:w.end[j]].tobytes() else 0
                         for j, k in enumerate(known, start)]
                spans, items = automaton.stream(known)
                row = w.row[start]
                for a, b in spans:
                    a, b = a + start, b + start
                    rows[row]["spans"].append({
                        "first": int(a - w.first[row]), "end": int(b - w.first[row]),
                        "first_byte": int(w.start[a] - offsets[row]), "end_byte": int(w.end[b - 1] - offsets[row])})
                rows[row]["items"] |= items
            out += [r | {"items": sorted(r["items"], key=lambda x: (x is None, x))} for r in rows]
        return pa.array(out, MATCH_TYPE)

    return match


def item_words(texts: list[str | None]) -> list[list[bytes]]:
    """Normalised words of each item; null has none."""
    return [(t or "").encode().translate(T.WORD_TABLE).split() for t in texts]


def match(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          window: int = 13, max_words: int = 500_000, out: str = "match") -> DataFrame:
    """Add a struct column ``out``: ``n_words``, hit ``spans`` in words and bytes, ``items`` with occurring windows.

    A window is ``window`` consecutive words of an item, or a whole item of fewer words. Null and empty texts have no
    words; items without words have no window; equal items are all listed; items with a null id are one null in the list. Items are
    read in parts of at most ``max_words`` words (an item is never split), and each part is one more column of work.
    """
    parts: list[Callable] = []
    held: list[tuple[str, list[bytes]]] = []
    size = 0

    def close() -> None:
        nonlocal held, size
        parts.append(F.arrow_udf(_matcher(Automaton(held, window)), MATCH_SQL))
        held, size = [], 0

    chosen = items.select(F.col(item_id).cast("string"), F.col(item_text))
    for name, value in chosen.toLocalIterator():
        w = item_words([value])[0]
        if held and size + len(w) > max_words:
            close()
        held.append((name, w))
        size += len(w)
    close()
    T.bounded_batches(docs.sparkSession)
    if len(parts) == 1:
        return docs.withColumn(out, parts[0](F.col(text)))
    names = [free_name(docs, f"match_part_{i}_") for i in range(len(parts))]
    got = docs.withColumns({n: p(F.col(text)) for n, p in zip(names, parts)})
    joined = F.struct(
        F.col(names[0])["n_words"].alias("n_words"),
        merged_spans(F.array_sort(F.flatten(F.array(*[F.col(n)["spans"] for n in names])))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(n)["items"] for n in names])))).alias("items"))
    return got.withColumn(out, joined).drop(*names)


def merged_spans(spans: Column) -> Column:
    """Union of sorted spans: overlapping and touching ones become one."""
    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"),
            last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], s["end_byte"]).alias("end_byte"))
        return F.when((F.size(acc) > 0) & (s["first"] <= F.try_element_at(acc, F.lit(-1))["end"]),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(s)))

    return F.aggregate(F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), F.slice(spans, 1, 1), step)


def n_hit(matched: Column) -> Column:
    return F.aggregate(matched["spans"], F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["first"]))


def contaminated(matched: Column, share: int = 20) -> Column:
    """Hit words make up at least one in ``share`` of the document's words."""
    return (n_hit(matched) > 0) & (share * n_hit(matched) >= matched["n_words"])


def cut_spans(text: Column, matched: Column) -> Column:
    """The text without its hit spans (whole words, so the rest stays valid UTF-8)."""
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist()):
            raw, at, kept = (t or "").encode(), 0, []
            for s in found or ():
                kept.append(raw[at:s["first_byte"]])
                at = s["end_byte"]
            out.append(None if t is None else b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    return cut(text, matched["spans"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", action: str = "drop", share: int = 20,
                  **options) -> DataFrame:
    """Documents without test items: ``drop`` contaminated documents, or ``cut`` the hit spans out of every document.

    All columns are kept. Documents below the coverage limit pass ``drop`` unchanged, also null and empty ones.
    """
    name = free_name(docs, "found_")
    got = match(docs, items, text, out=name, **options)
    if action == "cut":
        return got.withColumn(text, cut_spans(F.col(text), F.col(name))).drop(name)
    return got.where(~contaminated(F.col(name), share)).drop(name)
