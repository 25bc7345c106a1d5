"""Ranked lexical search by bit-sliced Bloom signatures (operator 12).

Index: blocks of documents of similar size. A block has one bitmap over its documents for each of its slots; a term that a document
holds at least 1, 2, 3, ... times (``LEVELS``) sets the document's bit in the slots of (term, level). The
bitwise and of these slots, and of those of lower levels, overestimates who holds the term so often, never the reverse. Summed with the weights of an item's
terms, level by level, and multiplied by the most that a level can add to a document of that length, the slices give an upper
bound of the score of each document for each item.

Search: the best bounds of each item are scored exactly on their whole texts; the k-th best of these scores is the item's
threshold. Every document whose bound reaches it is then scored exactly, all others are provably no better.

Items pass in parts of bounded size, each part one run over the index; the vocabulary of the items filters terms as a bitmap
of fixed size, and what it lets through by chance finds no partner in the join that follows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from authwatch.llm import text as T
from authwatch.runtime import cut_lineage, discard, stored_so_far

SLOTS_PER_TERM, HASHES, LEVEL_HASHES = 16, 8, 3
BLOCK_BYTES, BLOCK_DOCS = 1 << 19, 4096
LEVELS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 28, 40, 64)  # least occurrences of a level; the next level's minus 1 is the most
PART_TERMS = 200_000
FILTER_BITS = 1 << 23
_BITMAP = 1 << 15  # bits of one bitmap of bitmap_construct_agg
_U = np.uint64
_STEPS = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
_INDEX = "slots int, n_docs int, ids binary, n binary, slices binary"


class Totals(NamedTuple):
    """Documents with a term, and all their terms with repeats."""

    documents: int
    terms: int


def _terms(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(T.WORD_TABLE).split()


def _hashed(terms: list[bytes]) -> np.ndarray:
    """The hashes that ``text.words`` gives these terms."""
    if not terms:
        return np.zeros(0, _U)
    size = np.array([len(t) for t in terms])
    end = np.cumsum(size)
    return T.mix(T.span_hash(T.prefix_hash(np.frombuffer(b"".join(terms), np.uint8)), end - size, end) + size.astype(_U))


def _slots(hashed: np.ndarray, level: np.ndarray | int, slots: int) -> list[np.ndarray]:
    """The slots of each (term, level): HASHES for the first level, LEVEL_HASHES for the others."""
    seed = hashed + np.asarray(level).astype(_U) * _U(0x9E3779B97F4A7C15)
    first = np.broadcast_to(np.asarray(level) == 0, hashed.shape)
    return [(T.mix((seed if j < LEVEL_HASHES else seed[first]) + step) & _U(slots - 1)).astype(np.int64)
            for j, step in enumerate(_STEPS) if j < LEVEL_HASHES or first.any()]


def _by_term(hashed: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words ordered by row and term, and where each term of each row begins in that order."""
    order = np.lexsort((hashed, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashed[order[1:]] != hashed[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    return order, np.flatnonzero(new)


class _Class:
    """Documents of one size class that wait for their block to fill."""

    def __init__(self, slots: int):
        self.slots, self.room = slots, int(min(BLOCK_DOCS, max(8, 8 * BLOCK_BYTES // slots)))
        self.ids: list[int] = []
        self.n: list[int] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []

    def block(self) -> tuple:
        bits = np.zeros((self.slots, -(-len(self.ids) // 8) * 8), bool)
        for d, (hashed, level) in enumerate(self.entries):
            for slot in _slots(hashed, level, self.slots):
                bits[slot, d] = True
        return (self.slots, len(self.ids), np.array(self.ids, np.int64).tobytes(), np.array(self.n, np.int64).tobytes(),
                np.packbits(bits, axis=1, bitorder="little").tobytes())


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, _Class] = {}
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def out(block: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block, kinds)], ["slots", "n_docs", "ids", "n", "slices"])

    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        for begin, _, data, offsets in T.slices(batch["text"]):
            w = T.words(data, offsets)
            order, at = _by_term(w.hashed, w.row)
            row, hashed = w.row[order[at]], w.hashed[order[at]]
            times = np.diff(np.append(at, len(order)))
            first = np.searchsorted(row, np.arange(len(offsets)))
            # one entry for each level that a term reaches
            reached = np.searchsorted(LEVELS, times, "right")
            upto = np.concatenate([[0], np.cumsum(reached)])
            entry = np.repeat(hashed, reached)
            level = np.arange(upto[-1]) - np.repeat(upto[:-1], reached)
            for d in np.flatnonzero(np.diff(first)):
                a, b = upto[first[d]], upto[first[d + 1]]
                slots = SLOTS_PER_TERM << max(0, int(b - a - 1).bit_length())
                kind = waiting.setdefault(slots, _Class(slots))
                kind.ids.append(int(ids[begin + d]))
                kind.n.append(int(w.first[d + 1] - w.first[d]))
                kind.entries.append((entry[a:b], level[a:b]))
                if len(kind.ids) == kind.room:
                    yield out(waiting.pop(slots).block())
    for kind in waiting.values():
        yield out(kind.block())


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Signature blocks of all documents with an id and a term, stored: slots, n_docs, ids, term counts and slices."""
    T.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    return cut_lineage(rows.mapInArrow(_index_rows, _INDEX))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, term, repeats), stored; ``item`` numbers the rows, so rows of one id stay apart."""
    @F.arrow_udf("array<binary>")
    def split(column: pa.Array) -> pa.Array:
        return pa.array([_terms(x.as_py()) for x in column.cast(pa.large_binary())], pa.list_(pa.binary()))

    T.bounded_batches(items.sparkSession)
    numbered = cut_lineage(items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_id"), F.col(text).alias("text")))
    return cut_lineage(numbered.select("item", "item_id", F.explode(split(F.col("text"))).alias("term")).groupBy(
        "item", "item_id", "term").agg(F.count("*").alias("repeats")))


def term_filter(terms: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits, set at the hashes of the terms, made by the executors: at most bits / 8 bytes reach the driver."""
    @F.arrow_udf("bigint")
    def place(column: pa.Array) -> pa.Array:
        return pa.array((_hashed(column.to_pylist()) % _U(bits)).astype(np.int64))

    spots = terms.select(place(F.col("term")).alias("at")).select(
        F.expr(f"at div {_BITMAP}").alias("bucket"), F.expr(f"at % {_BITMAP}").alias("at"))
    out = np.zeros(bits // 8, np.uint8)
    for r in spots.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect():  # at most bits / 2^15 rows
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["bucket"] * (_BITMAP // 8):][:len(part)] = part[:bits // 8 - r["bucket"] * (_BITMAP // 8)]
    return out


def _frequencies(wanted: np.ndarray):
    """(term, df) of each batch for the wanted terms, and one row (null, documents, terms)."""
    bits = _U(len(wanted) * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        for batch in batches:
            found: Counter[bytes] = Counter()
            for _, _, data, offsets in T.slices(batch["text"]):
                w = T.words(data, offsets)
                count = np.diff(w.first)
                documents += int((count > 0).sum())
                total += int(count.sum())
                at = w.hashed % bits
                near = np.flatnonzero(wanted[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1)
                order, at = _by_term(w.hashed[near], w.row[near])
                once = near[order[at]]  # one place of each term of each document
                low = w.low.tobytes()
                found.update(low[a:b] for a, b in zip(w.start[once].tolist(), w.end[once].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64()), pa.nulls(len(found), pa.int64())],
                ["term", "df", "terms"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.binary()), pa.array([documents], pa.int64()), pa.array([total], pa.int64())], ["term", "df", "terms"])

    return run


def weighed(docs: DataFrame, terms: DataFrame, text: str = "text") -> tuple[DataFrame, Totals]:
    """Item terms with their weight over all documents (stored), and the totals of the documents."""
    found = cut_lineage(docs.select(F.col(text).alias("text")).mapInArrow(
        _frequencies(term_filter(terms.select("term").distinct())), "term binary, df bigint, terms bigint"))
    row = found.where("term IS NULL").agg(F.sum("df"), F.sum("terms")).first()
    totals = Totals(row[0] or 0, row[1] or 0)
    df = found.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    odds = F.lit(2.0 * totals.documents + 2) / (2 * F.coalesce("df", F.lit(0)) + 1)
    weight = F.floor(1000 * F.log(odds)).cast("bigint")
    return cut_lineage(terms.join(df, "term", "left").withColumn("weight", weight)), totals


class Part(NamedTuple):
    """A bounded part of the items: their numbers, and each item's terms with weight times repeats."""

    items: list[int]
    terms: list[dict[bytes, int]]


def parts(terms: DataFrame, most: int = PART_TERMS) -> Iterator[Part]:
    """The items in parts of about ``most`` terms, one at a time; an item is never split."""
    number = max(1, math.ceil(terms.count() / most))
    dealt = terms.where("weight > 0").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(number)))
    for p in range(number):
        held: dict[int, dict[bytes, int]] = {}
        for r in dealt.where(F.col("part") == p).select("item", "term", (F.col("weight") * F.col("repeats")).alias("w")).toLocalIterator():
            held.setdefault(r["item"], {})[bytes(r["term"])] = r["w"]
        if held:
            yield Part(list(held), list(held.values()))


def _damping(n: np.ndarray, totals: Totals) -> np.ndarray:
    return 25 + (75 * n * totals.documents) // max(totals.terms, 1)


def _bounds(part: Part, totals: Totals, keep: int | None, floor: dict[int, int] | None):
    """Rows (item, doc_id): each task's ``keep`` best bounds of each item, or all bounds that reach the item's floor."""
    words = list(dict.fromkeys(t for terms in part.terms for t in terms))
    place = {t: i for i, t in enumerate(words)}
    hashed = _hashed(words)
    chosen = [np.array([place[t] for t in terms]) for terms in part.terms]
    weights = [np.array(list(terms.values()), np.float64) for terms in part.terms]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Ids and the bounds of every item, for each block."""
        for batch in batches:
            for r in batch.to_pylist():
                ids, n = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["n"], np.int64)
                slices = np.frombuffer(r["slices"], np.uint8).reshape(r["slots"], -1)
                most = [np.minimum(n, hi) for hi in [x - 1 for x in LEVELS[1:]]] + [n]
                value = [1_000_000_000 * tf // (1000 * tf + 8 * _damping(n, totals)) for tf in most]
                total = [np.zeros(len(ids)) for _ in chosen]
                held = np.uint8(255)  # who reaches a level reaches all levels below
                for level in range(len(LEVELS)):
                    gain = value[level] - (value[level - 1] if level else 0)
                    for slot in _slots(hashed, level, r["slots"]):
                        held = held & slices[slot]
                    some = held.any(1)
                    if not some.any():
                        break
                    for i, (at, w) in enumerate(zip(chosen, weights)):
                        live = some[at]
                        if live.any():
                            bits = np.unpackbits(held[at[live]], axis=1, count=len(ids), bitorder="little")
                            total[i] += gain * (w[live] @ bits)
                yield ids, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, total in blocks(batches):
            for item, bound in zip(part.items, total):
                if keep is None:
                    near = np.flatnonzero(bound >= floor.get(item, 1))
                    if len(near):
                        yield out(item, ids[near], bound[near])
                else:
                    old = best.get(item, (np.zeros(0, np.int64), np.zeros(0)))
                    all_ids, all_bounds = np.concatenate([old[0], ids]), np.concatenate([old[1], bound])
                    top = np.argsort(-all_bounds, kind="stable")[:keep]
                    top = top[all_bounds[top] > 0]
                    best[item] = all_ids[top], all_bounds[top]
        for item, (ids, bound) in best.items():
            yield out(item, ids, bound)

    def out(item: int, ids: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(bound)], ["item", "doc_id", "bound"])

    return run


def _exact(part: Part, totals: Totals):
    """Rows (item, doc_id, score) of texts with the items that they may answer."""
    of = dict(zip(part.items, part.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, doc, score = [], [], []
            for doc_id, raw, wanted in zip(batch["doc_id"], batch["text"].cast(pa.large_binary()), batch["items"]):
                words = _terms(raw.as_py())
                count = Counter(words)
                damping = int(_damping(np.int64(len(words)), totals))
                for i in wanted.as_py():
                    terms = of[i]
                    value = sum(w * ((1_000_000_000 * count[t]) // (1000 * count[t] + 8 * damping)) for t, w in terms.items() if t in count)
                    if value > 0:
                        item.append(i)
                        doc.append(doc_id.as_py())
                        score.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                             ["item", "doc_id", "score"])

    return run


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def _over_blocks(spark: SparkSession, blocks: DataFrame, run) -> DataFrame:
    """Blocks are wide rows, so few of them share an Arrow batch while this runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        return cut_lineage(blocks.mapInArrow(run, "item bigint, doc_id bigint, bound double"))
    finally:
        spark.conf.set(name, before)


def search(docs: DataFrame, blocks: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", part_terms: int = PART_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, ties to the smaller id.

    ``blocks`` is the index of ``docs``. Each row of ``items`` is an item of its own, also where ids repeat or are null;
    each row of ``docs`` is a document. Rows without id count in the statistics and are never returned; null and empty
    texts have no term. Items without a term, or without a document that holds one, return no rows. The score is exact.
    """
    spark = docs.sparkSession
    T.bounded_batches(spark)
    terms, totals = weighed(docs, item_terms(items, item_id, item_text), text)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")

    def scored(pairs: DataFrame, part: Part) -> DataFrame:
        # at most the items of a part for each document; stored, so that Spark knows its size before it plans the join
        asked = cut_lineage(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")))
        return cut_lineage(rows.join(asked, "doc_id").mapInArrow(_exact(part, totals), "item bigint, doc_id bigint, score bigint"))

    found = None
    for part in parts(terms, part_terms):
        begun = stored_so_far()
        bounds = _over_blocks(spark, blocks, _bounds(part, totals, 2 * k, None))
        first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))
        seeds = scored(bounds.withColumn("first", first).where(F.col("first") <= 2 * k).select("item", "doc_id"), part)
        floor = {r["item"]: r["score"] for r in _best(seeds, k).where(F.col("rank") == k).collect()}  # one row for an item of the part
        near = _over_blocks(spark, blocks, _bounds(part, totals, None, floor))
        top = cut_lineage(_best(scored(near.select("item", "doc_id"), part), k))
        discard(spark, begun, keep=1)
        found = top if found is None else found.unionByName(top)
    names = terms.select("item", "item_id").distinct()
    if found is None:
        found = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint, rank int")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
