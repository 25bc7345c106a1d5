import numpy as np
import pytest

from authwatch.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, vector string, dim int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "own", 1) for i, v in zip(ids, vectors)], SCHEMA)


def exact(vectors, ids, queries, k):
    out = {}
    for q in queries:
        rows = sorted(((-float(vectors[q].astype(np.float64) @ vectors[i].astype(np.float64)), i) for i in ids if i != q))[:k]
        out[q] = [(i, -s) for s, i in rows]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard_rows", [100_000, 300])
def test_recall_and_scores(spark, shard_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    x = (centres[rng.integers(0, 8, 1500)] + 0.5 * rng.normal(size=(1500, 24))).astype(np.float32)  # lengths differ
    rows = frame(spark, x.tolist())
    got = found(ann.neighbours(ann.index(rows, 10, shard_rows=shard_rows), rows.where("vec_id % 20 = 0"), 10))
    want = exact(x, range(1500), range(0, 1500, 20), 10)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    for q, rows_ in got.items():
        for i, s in rows_:
            assert s == pytest.approx(float(x[q].astype(np.float64) @ x[i].astype(np.float64)), abs=1e-12)


def test_equal_vectors_and_ties(spark):
    x = np.zeros((60, 3), np.float32)
    x[:, 0] = 1
    x[40:, 1] = 1
    rows = frame(spark, x.tolist())
    got = found(ann.neighbours(ann.index(rows, 5), rows, 5))
    want = exact(x, range(60), range(60), 5)
    assert got == {q: [(i, pytest.approx(s)) for i, s in w] for q, w in want.items()}


def test_unusable_vectors_and_few_candidates(spark):
    good = [[1.0, 0.0], [0.5, 0.5], [-1.0, 0.25]]
    bad = [None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], []]
    rows = frame(spark, good + bad + [[1.0, 2.0, 3.0], [1.0, 0.0]], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 1])
    rows = rows.unionByName(frame(spark, [[9.0, 9.0]], [None]))
    got = found(ann.neighbours(ann.index(rows, 20), rows, 20))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {1: [2, 3], 2: [1, 3], 3: [2, 1]}


def test_empty_tables(spark):
    rows = frame(spark, [[1.0, 0.0]])
    assert ann.neighbours(ann.index(rows.limit(0), 5), rows, 5).count() == 0
    assert ann.neighbours(ann.index(rows, 5), rows.limit(0), 5).count() == 0
    assert ann.neighbours(ann.index(rows, 5), rows, 5).count() == 0
