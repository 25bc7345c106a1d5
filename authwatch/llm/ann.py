"""Approximate nearest neighbours by inner product (operator 7): one layered small-world graph for each shard.

Vectors that are equal count once, with their k + 1 smallest ids: no other of their ids can be among k nearest. Distinct vectors are
dealt out to shards of bounded size by a hash; each shard becomes one row of flat arrays (vectors, ids, and for
each layer the members and a fixed-width table of neighbours). Blocks of queries meet every shard, one row for each
pair; all queries of a block walk the graph at once. The shards' results are merged by query.

Inner products become distances by one more coordinate, sqrt(R^2 - |x|^2) with R the largest norm of the shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authwatch.llm import text as T
from authwatch.runtime import cut_lineage

SHARD_ROWS = 8192
QUERY_BLOCK = 256
WIDTH = 24
CANDIDATES = 48
BEAM = 96
_NONE = -1


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each row and their squared distances, nearest first, by blocks of rows."""
    n, norm = len(x), (x * x).sum(1)
    ids, dist = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for a in range(0, n, 512):
        d = norm[a:a + 512, None] + norm[None] - 2 * (x[a:a + 512] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k] if k < n - 1 else np.argsort(d, 1)[:, :k]
        own = np.take_along_axis(d, near, 1)
        order = np.argsort(own, 1, kind="stable")
        ids[a:a + 512], dist[a:a + 512] = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    return ids, dist


def _spread(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates those nearer to the row than to any chosen before, then the nearest others, up to width."""
    n, k = ids.shape
    chosen = np.zeros((n, k), bool)
    for a in range(0, n, 256):
        c = x[ids[a:a + 256]]
        norm = (c * c).sum(2)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (c @ c.transpose(0, 2, 1))
        took = chosen[a:a + 256]
        for j in range(k):
            blocked = (took & (between[:, j] < dist[a:a + 256, j, None])).any(1)
            took[:, j] = ~blocked & (took.sum(1) < width)
    order = np.argsort(~chosen, 1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1)


def layer(x: np.ndarray, width: int = WIDTH, candidates: int = CANDIDATES) -> np.ndarray:
    """Table of neighbours of one layer: spread-out links of each row, then links back to it, nearest first."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), _NONE, np.int32)
    ids, dist = _nearest(x, min(candidates, n - 1))
    links = _spread(x, ids, dist, min(width, n - 1))
    u, v = np.repeat(np.arange(n), links.shape[1]), links.ravel().astype(np.int64)
    d = ((x[u] - x[v]) ** 2).sum(1)
    u, v, back, d = np.concatenate([u, v]), np.concatenate([v, u]), np.repeat([0, 1], len(u)), np.concatenate([d, d])
    order = np.lexsort((d, back, u))
    u, v = u[order], v[order]
    pair = u * n + v
    _, keep = np.unique(pair, return_index=True)
    keep.sort()
    u, v = u[keep], v[keep]
    place = np.arange(len(u)) - np.searchsorted(u, u)
    table = np.full((n, 2 * width), _NONE, np.int32)
    own = place < 2 * width
    table[u[own], place[own]] = v[own]
    return table[:, :max(1, int(place[own].max()) + 1)]


def build(vectors: np.ndarray, keys: np.ndarray, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the bottom up: (members, table of neighbours by place in the members). Levels are hashed from keys."""
    x = lifted(vectors)
    u = (T.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(7)) >> np.uint64(11)).astype(float) * 2.0 ** -53
    level = np.floor(-np.log(np.maximum(u, 1e-300)) / math.log(width)).astype(int)
    out, members = [], np.arange(len(x))
    while len(members):
        out.append((members.astype(np.int32), layer(x[members], width)))
        if len(members) <= width + 1:
            break
        members = members[level[members] >= len(out)]
    return out


def lifted(vectors: np.ndarray) -> np.ndarray:
    norm = (vectors.astype(np.float64) ** 2).sum(1)
    rest = np.sqrt(np.maximum(norm.max() - norm, 0)) if len(norm) else norm
    return np.hstack([vectors, rest[:, None].astype(vectors.dtype)])


def search(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, k: int,
           beam: int = BEAM) -> np.ndarray:
    """Rows of the ``k`` largest inner products found for each query, -1 where there are fewer."""
    n, q = len(vectors), len(queries)
    start = np.tile(layers[-1][0].astype(np.int64), (q, 1))
    valid = np.ones(start.shape, bool)
    for depth in range(len(layers) - 1, -1, -1):
        members, table = layers[depth]
        place = np.full(n, _NONE)
        place[members] = np.arange(len(members))
        wide = beam if depth == 0 else 16
        seen = np.zeros((q, n), bool)
        rows = np.arange(q)[:, None]
        seen[rows, start] = True
        best, score = start, np.where(valid, np.einsum("qd,qbd->qb", queries, vectors[start]), -np.inf)
        order = np.argsort(-score, 1, kind="stable")[:, :wide]
        best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
        open_ = np.isfinite(score)
        live = np.arange(q)
        while len(live):
            first = open_[live].argmax(1)
            ready = open_[live, first]
            live, first = live[ready], first[ready]
            if not len(live):
                break
            open_[live, first] = False
            near = table[place[best[live, first]]]
            node = members[np.maximum(near, 0)].astype(np.int64)
            new = (near >= 0) & ~seen[live[:, None], node]
            seen[live[:, None], node] |= near >= 0
            got = np.where(new, np.einsum("qd,qbd->qb", queries[live], vectors[node]), -np.inf)
            all_ids = np.concatenate([best[live], node], 1)
            all_scores = np.concatenate([score[live], got], 1)
            all_open = np.concatenate([open_[live], new], 1)
            order = np.argsort(-all_scores, 1, kind="stable")[:, :wide]
            if order.shape[1] > best.shape[1]:
                grow = order.shape[1] - best.shape[1]
                best = np.pad(best, ((0, 0), (0, grow)))
                score = np.pad(score, ((0, 0), (0, grow)), constant_values=-np.inf)
                open_ = np.pad(open_, ((0, 0), (0, grow)))
            best[live, :order.shape[1]] = np.take_along_axis(all_ids, order, 1)
            score[live, :order.shape[1]] = np.take_along_axis(all_scores, order, 1)
            open_[live, :order.shape[1]] = np.take_along_axis(all_open, order, 1)
        valid = np.isfinite(score)
        start = np.where(valid, best, best[:, :1])
    best = np.where(np.isfinite(score), best, _NONE)[:, :k]
    return best


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("first_id")
    vectors = np.stack([np.asarray(v, np.float32) for v in rows["vector"]])
    ids = [np.asarray(x, np.int64) for x in rows["ids"]]
    layers = build(vectors, rows["first_id"].to_numpy())
    return pd.DataFrame({
        "dim": [vectors.shape[1]], "shard": [rows["shard"].iloc[0]], "vectors": [vectors.tobytes()],
        "ids": [np.concatenate(ids).tobytes()], "id_counts": [np.array([len(x) for x in ids], np.int32).tobytes()],
        "widths": [[int(t.shape[1]) for _, t in layers]], "members": [[m.tobytes() for m, _ in layers]],
        "tables": [[t.tobytes() for _, t in layers]]})


_INDEX = ("dim int, shard int, vectors binary, ids binary, id_counts binary, widths array<int>, "
          "members array<binary>, tables array<binary>")


def vectors_of(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) that take part: no null id or vector, no null or non-finite component, not all zero."""
    rows = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad
                      & F.exists("vector", lambda v: v != 0))


def index(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of flat arrays for each shard of at most about ``shard_rows`` distinct vectors, stored.

    Every row is indexed; of equal vectors the ``k + 1`` smallest ids are kept, which decide all ties.
    """
    T.bounded_batches(rows.sparkSession)
    rows = vectors_of(rows, key, vector).distinct()
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    same = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vector").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))
    same = cut_lineage(same.select("vector", "ids", F.element_at("ids", 1).alias("first_id"), F.size("vector").alias("dim")))
    shards = max(1, math.ceil(same.count() / shard_rows))
    dealt = same.withColumn("shard", F.pmod(F.xxhash64("first_id"), F.lit(shards)).cast("int"))
    return cut_lineage(dealt.groupBy("dim", "shard").applyInPandas(_build_shard, _INDEX))


def _searcher(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if last != (dim, row["shard"]):
                    vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, dim)
                    layers = [(np.frombuffer(m, np.int32), np.frombuffer(t, np.int32).reshape(-1, w))
                              for m, t, w in zip(row["members"], row["tables"], row["widths"])]
                    counts = np.frombuffer(row["id_counts"], np.int32)
                    held = vectors, layers, np.frombuffer(row["ids"], np.int64), counts, np.cumsum(counts) - counts
                    last = dim, row["shard"]
                vectors, layers, ids, counts, begin = held
                queries = np.frombuffer(row["queries"], np.float64).reshape(-1, dim)
                found = search(vectors, layers, queries.astype(np.float32), k + 1, max(beam, k + 1))
                out_q, out_i, out_s = [], [], []
                for q, query, near in zip(row["query_ids"], queries, found):
                    near = near[near >= 0]
                    exact = (vectors[near].astype(np.float64) * query).sum(1)
                    each = np.repeat(np.arange(len(near)), counts[near])
                    place = np.arange(len(each)) - np.repeat(np.cumsum(counts[near]) - counts[near], counts[near])
                    own = ids[begin[near][each] + place]
                    other = own != q
                    own, value = own[other], exact[each[other]]
                    order = np.lexsort((own, -value))[:k]
                    out_q.append(np.full(len(order), q))
                    out_i.append(own[order])
                    out_s.append(value[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_i)), pa.array(np.concatenate(out_s))],
                    ["query_id", "vec_id", "score"])

    return run


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({
        "dim": [rows["dim"].iloc[0]], "query_ids": [rows["vec_id"].to_numpy()],
        "queries": [np.stack([np.asarray(v, np.float64) for v in rows["vector"]]).tobytes()]})


def neighbours(graphs: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
               beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, without the query's own id.

    Score is the inner product in double precision, ties go to the smaller id. Vectors that ``vectors_of`` refuses
    get no rows; queries meet vectors of their own dimension only. Fewer than k candidates give fewer rows. Of several
    query rows with one id, the one with the greatest vector counts.
    """
    spark = graphs.sparkSession
    asked = vectors_of(queries, key, vector).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    asked = cut_lineage(asked.withColumn("dim", F.size("vector")))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy(
        "dim", "block").applyInPandas(_pack, "dim int, query_ids array<bigint>, queries binary")
    shards = graphs.select("dim", "shard")
    # a block is small and meets each shard once; the shards' arrays are not copied in the exchange
    aimed = packed.join(shards, "dim")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row holds a whole shard
    found = cut_lineage(graphs.join(aimed, ["dim", "shard"]).mapInArrow(
        _searcher(k, beam), "query_id bigint, vec_id bigint, score double"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
