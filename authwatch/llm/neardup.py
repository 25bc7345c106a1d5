"""Near duplicates by DartMinHash signatures and banded joining (operator 8).

Every element of a weighted set throws darts at the plane (weight x rank): each unit-area cell above the element holds a hashed
Poisson number of darts with hashed places. A dart counts if it lies within the element's weight and below the
set's rank limit, which is chosen so that about t ln t + 2t darts of the whole set count. Each dart belongs to one of t
coordinates; a coordinate keeps its dart of lowest rank. Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity, and a signature costs time in the darts, not in elements x coordinates.

Texts with equal shingle sets collapse first. Signatures are cut in bands; texts that share a band are compared
exactly: all with the band's first text, and then, in bands that still hold several components, every text outside
the main component with all texts of other components, unless long one-bit sketches (from darts again) show
that a pair is far below the limit: SKETCH bits put a pair of similarity s within about 0.013 of s, and the margin is almost five
times that. That join is by family, the bands that overlap. So every pair in a band is judged or already linked, while a
band of thousands of copies costs a comparison for each, not for each pair, and no unlike pairs leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authwatch.llm import text as T
from authwatch.llm.columns import free_name
from authwatch.llm.graph import components
from authwatch.runtime import cut_lineage, discard, stored_so_far

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SKETCH, SKETCH_MARGIN = 2048, 0.0625
_U = np.uint64
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)])))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from scrambled 64-bit values."""
    return (x >> _U(11)).astype(np.float64) * 2.0 ** -53


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, t: int) -> np.ndarray:
    """rows x t ranks of the lowest darts; infinite where a row has no element. ``row`` is sorted."""
    out = np.full(rows * t, np.inf)
    total = np.bincount(row, weight, minlength=rows)
    limit = np.divide(t * np.log(t) + 2 * t, total, out=np.zeros(rows), where=total > 0)
    todo = total > 0
    for _ in range(40):
        own = np.flatnonzero(todo[row])
        if not len(own):  # no row with an element is left, as in a slice of blank texts
            break
        cells = np.cumsum(np.ceil(limit[row[own]] * (2 * weight[own] + 1)))
        for at in np.split(own, np.searchsorted(cells, np.arange(250_000, cells[-1], 250_000))):  # small arrays of cells
            _throw(row[at], element[at], weight[at], limit, t, out)
        filled = np.isfinite(out.reshape(rows, t)).all(1)
        todo &= ~filled
        if not todo.any():
            break
        limit = limit * 2  # an empty coordinate: more darts for that row
    return out.reshape(rows, t)


def _throw(row: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, t: int, out: np.ndarray) -> None:
    level = 0
    while len(row):
        wide = 2.0 ** level  # weight from 2^level - 1, cells 2^level wide and 2^-level high
        cells = np.ceil(limit[row] * wide).astype(np.int64)
        of = np.repeat(np.arange(len(row)), cells)
        cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = T.mix(element[of] + T.mix(cell.astype(_U) * _U(64) + _U(level) + _U(1)))
        darts = np.searchsorted(_POISSON, _unit(seed), "right")
        of, cell, seed = np.repeat(of, darts), np.repeat(cell, darts), np.repeat(seed, darts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
        seed = T.mix(seed + (nth.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        rank = (cell + _unit(seed)) / wide
        seed = T.mix(seed + _U(1))
        place = wide - 1 + wide * _unit(seed)
        hit = (rank < limit[row[of]]) & (place < weight[of])
        seed = T.mix(seed[hit] + _U(2))
        np.minimum.at(out, row[of[hit]] * t + (seed % _U(t)).astype(np.int64), rank[hit])
        level += 1
        deeper = weight > 2.0 ** level - 1
        row, element, weight = row[deeper], element[deeper], weight[deeper]


def signatures(text: Column, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> Column:
    """Struct of ``n`` (distinct shingles), ``same`` (hash of the whole weighted set) and ``bands`` (band keys).

    Shingles weigh 1, or with ``weighted`` as often as they occur. A text without words has n = 0 and no bands.
    """
    kind = pa.struct([("n", pa.int64()), ("same", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("n bigint, same bigint, bands array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        n, same, keys = [], [], []
        for _, _, data, offsets in T.slices(column):
            count = len(offsets) - 1
            w = T.words(data, offsets)
            row, h, times = T.shingles(w.hashed, w.first, size)
            weight = times.astype(float) if weighted else np.ones(len(h))
            n.append(np.bincount(row, minlength=count))
            # two sums of differently scrambled elements, folded: equal for equal sets only, up to chance
            both = T.mix(h + weight.astype(_U))
            sums = np.zeros(count, _U)
            np.add.at(sums, row, T.mix(both ^ _U(0x5DEECE66D)))
            same.append(T.mix(sums + n[-1].astype(_U)).view(np.int64))
            got = dart_signatures(row, h, weight, count, bands * rows).view(_U).reshape(count, bands, rows)
            key = np.zeros((count, bands), _U) + np.arange(1, bands + 1, dtype=_U)
            for j in range(rows):
                key = T.mix(key * _U(0x9E3779B97F4A7C15) + got[:, :, j])
            keys.append(key.view(np.int64))
        if not n:
            return pa.array([], kind)
        n, key = np.concatenate(n), np.concatenate(keys)
        full = np.where(n > 0, bands, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]), pa.int32()),
                                         pa.array(key[n > 0].ravel()))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(np.concatenate(same)), lists], fields=list(kind))

    return run(text)


def sketch(text: Column, size: int = SHINGLE, weighted: bool = False, bits: int = SKETCH) -> Column:
    """One bit of each of ``bits`` lowest darts, as an array of bigint: equal with probability (1 + similarity) / 2."""
    @F.arrow_udf("array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offsets in T.slices(column):
            w = T.words(data, offsets)
            row, h, times = T.shingles(w.hashed, w.first, size)
            weight = times.astype(float) if weighted else np.ones(len(h))
            for a in range(0, len(offsets) - 1, 64):  # the ranks of 64 rows at a time
                n = min(64, len(offsets) - 1 - a)
                i, j = np.searchsorted(row, (a, a + n))
                rank = dart_signatures(row[i:j] - a, h[i:j], weight[i:j], n, bits)
                out.append(np.packbits((T.mix(rank.view(_U)) & _U(1)).astype(np.uint8), axis=1).view(np.int64))
        words_ = np.concatenate(out) if out else np.zeros((0, bits // 64), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words_) + 1) * (bits // 64), pa.int32()), pa.array(words_.ravel()))

    return run(text)


def _similarity(size: int, weighted: bool):
    """Exact (weighted) Jaccard similarity of text pairs; the sets of the last few left texts are kept."""
    def sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for _, _, data, offsets in T.slices(pa.array(texts, pa.large_string())):
            w = T.words(data, offsets)
            row, h, times = T.shingles(w.hashed, w.first, size)
            cut = np.searchsorted(row, np.arange(1, len(offsets) - 1))
            out += list(zip(np.split(h, cut), np.split(times, cut)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            value = []
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128).to_pydict()
                right = sets(part["right_text"])
                for a, text, (h2, c2) in zip(part["a"], part["left_text"], right):
                    if a not in kept:
                        if len(kept) >= 8:
                            kept.pop(next(iter(kept)))
                        kept[a] = sets([text])[0]
                    h1, c1 = kept[a]
                    _, i, j = np.intersect1d(h1, h2, True, return_indices=True)
                    if weighted:
                        common = np.minimum(c1[i], c2[j]).sum()
                        union = c1.sum() + c2.sum() - common
                    else:
                        common, union = len(i), len(h1) + len(h2) - len(i)
                    value.append(float(common / union) if union else 0.0)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(value, pa.float64())], ["a", "b", "similarity"])

    return run


def compared(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """Add the exact similarity to distinct pairs (a, b) of ``texts`` (node, text)."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right_text"))
    full = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left_text", "right_text")
    return full.mapInArrow(_similarity(size, weighted), "a bigint, b bigint, similarity double")


def links(texts: DataFrame, banded: DataFrame, least: float = SIMILARITY, size: int = SHINGLE,
          weighted: bool = False) -> DataFrame:
    """(a, b, similarity) of similar pairs that connect all similar texts which share a band.

    ``texts``: node, text; ``banded``: node, band. Not all links between members of one component are returned, but
    each pair of a band that is similar ends up in one component.
    """
    shared = banded.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1")
    member = cut_lineage(banded.join(shared.select("band", "a"), "band"))
    stars = member.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    found = cut_lineage(compared(stars, texts, size, weighted).where(F.col("similarity") >= least))
    part = components(found)
    own = member.join(part, "node", "left").select("band", "node", F.coalesce("component", "node").alias("part"))
    apart = own.groupBy("band").agg(F.min("node").alias("first"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    own = cut_lineage(own.join(apart.select("band", "first"), "band"))
    # bands that overlap make a family, so that each text and each pair in it counts once, not once for each band
    family = components(own.select(F.col("first").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "family")
    n = SKETCH // 64
    nodes = own.select("node", "part").distinct().join(family, "node")
    nodes = cut_lineage(nodes.join(texts, "node").select(
        "node", "part", "family", sketch(F.col("text"), size, weighted).alias("s")))
    sizes = nodes.groupBy("family", "part").agg(F.count("*").alias("m"))
    main = sizes.groupBy("family").agg(F.max_by("part", F.struct("m", "part")).alias("main"))
    nodes = nodes.join(main, "family").select(
        "node", "part", "family", (F.col("part") == F.col("main")).alias("main"), *[F.col("s")[i].alias(f"s{i}") for i in range(n)])

    def side(name: str) -> DataFrame:
        return nodes.select("family", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "part", "main", *[f"s{i}" for i in range(n)])])

    differ = sum((F.bit_count(F.col(f"x_s{i}").bitwiseXOR(F.col(f"y_s{i}"))) for i in range(1, n)),
                 F.bit_count(F.col("x_s0").bitwiseXOR(F.col("y_s0"))))
    most = int(SKETCH * (1 - least + SKETCH_MARGIN) / 2)
    once = F.col("y_main") | (F.col("x_node") < F.col("y_node"))
    rest = side("x").where("NOT x_main").join(side("y"), "family").where(
        once & (F.col("x_part") != F.col("y_part")) & (differ <= most)).select(
        F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    rest = rest.join(stars, ["a", "b"], "left_anti")
    more = cut_lineage(compared(rest, texts, size, weighted).where(F.col("similarity") >= least))
    return found.unionByName(more)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY,
                    size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, class_id, n_shingles): documents of one class are connected by similarities of ``least`` or more.

    One row for each row of ``docs`` with an id; the class id is the smallest id in the class. Documents whose shingle
    sets are equal share a class. A text of fewer words than a shingle is one shingle; null texts and texts without words are
    classes of their own. Rows with a null id are left out. An id on several rows is one document: each of its texts is
    compared by itself, and the classes of all of them are one.
    """
    T.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    begun = stored_so_far()
    repeated = _repeated(docs)
    # rows are the nodes: the id names its row, or where ids repeat, a number that is stored with the text
    docs = cut_lineage(docs.withColumn("row", F.monotonically_increasing_id())) if repeated else docs.withColumn("row", F.col("doc_id"))
    marks = cut_lineage(docs.select("doc_id", "row", signatures(F.col("text"), size, bands, rows, weighted).alias("s")).select(
        "doc_id", "row", "s.*"))
    equal = marks.where("n > 0").groupBy("same", "n").agg(F.min("row").alias("node"))
    member = marks.select("doc_id", "row", "n", "same").join(equal, ["same", "n"], "left").select(
        "doc_id", "row", "n", F.coalesce("node", "row").alias("node"))
    banded = marks.where("n > 0").join(equal, ["same", "n"]).where("row = node").select("node", F.explode("bands").alias("band")).distinct()
    linked = links(docs.select(F.col("row").alias("node"), "text"), banded, least, size, weighted)
    joined = linked.select("a", "b").unionByName(member.where("row <> node").select(F.col("row").alias("a"), F.col("node").alias("b")))
    if repeated:
        first = marks.groupBy("doc_id").agg(F.min("row").alias("a"), F.count("*").alias("m")).where("m > 1")
        joined = joined.unionByName(marks.join(first, "doc_id").select("a", F.col("row").alias("b")))
    part = components(joined)
    found = member.join(part.withColumnRenamed("node", "row"), "row", "left").select(
        "doc_id", F.coalesce("component", "row").alias("class_id"), F.col("n").alias("n_shingles"))
    if repeated:
        found = cut_lineage(found)
        smallest = found.groupBy("class_id").agg(F.min("doc_id").alias("smallest"))
        found = found.join(smallest, "class_id").select("doc_id", F.col("smallest").alias("class_id"), "n_shingles")
    found = cut_lineage(found)
    discard(docs.sparkSession, begun, keep=1)
    return found


def _repeated(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def keep_one(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """All columns of one document of each class, the one with the smallest id, on however many rows it stands.

    Rows with a null id stay.
    """
    classes = near_duplicates(docs, key, **options)
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("gone")).distinct()
    name = free_name(docs, "gone_id")
    return docs.join(gone.withColumnRenamed("gone", name), F.col(key) == F.col(name), "left_anti")
