"""Ranked lexical search against a plain version: equal scores, ties, hot terms, several parts, odd inputs."""

import math
from collections import Counter

import numpy as np
import pytest

from authwatch.llm import lexical
from authwatch.llm import text as T
from tests.llm.naive import corpus, words


def plain(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            n = sum(c.values())
            m = 25 + 75 * n * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in words(text) if t in c)
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item_id, r + 1, doc_id, -s) for r, (s, doc_id) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(map(tuple, lexical.search(table, lexical.index(table), asked, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t, *_ in corpus(9, 150)]


def test_equals_plain(spark, rows):
    items = [(i, t) for i, (_, t) in enumerate(rows[:12])] + [(90, "abc changed1 unknown"), (91, None), (92, "!!"), (93, "漢字だけの文 X x"), (94, "nowhere")]
    assert found(spark, rows, items) == plain(rows, items)
    assert found(spark, rows, items, k=3) == plain(rows, items, 3)


def test_parts_of_items_and_repeated_items(spark, rows):
    items = [(i % 5 if i % 4 else None, t) for i, (_, t) in enumerate(rows[:15])] + [(7, rows[3][1]), (7, rows[3][1])]
    assert found(spark, rows, items, part_terms=60) == plain(rows, items)


def test_ties_copies_and_repeated_ids(spark):
    docs = [(i, "alpha beta gamma") for i in range(200, 0, -1)] + [(5, "alpha alpha"), (5, "alpha alpha"), (900, "Alpha ALPHA beta"), (901, "delta")]
    items = [(1, "alpha beta"), (2, "alpha alpha alpha"), (3, "delta")]
    got = found(spark, docs, items)
    assert got == plain(docs, items)
    assert [r[2] for r in sorted(got) if r[0] == 2][:2] == [5, 5]


def test_a_term_in_every_text_weighs_little(spark):
    docs = [(i, "the " * (i + 1) + f"w{i}") for i in range(60)]
    items = [(1, "the"), (2, "the w7"), (3, "w7 W8 w9")]
    assert found(spark, docs, items) == plain(docs, items)


def test_statistics_count_rows_without_id(spark):
    docs = [(None, "alpha beta"), (None, "alpha"), (1, "alpha"), (2, None), (3, ""), (4, "?"), (5, "beta beta " * 90_000 + "alpha")]
    items = [(1, "alpha beta")]
    got = found(spark, docs, items)
    assert got == plain(docs, items) and {r[2] for r in got} == {1, 5}


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_clashing_columns(spark, rows):
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows[:20]], "doc_id bigint, text string, item string, score int, rank int")
    asked = spark.createDataFrame([(1, rows[0][1], "y", 3)], "item_id bigint, text string, doc_id string, term int")
    got = lexical.search(table, lexical.index(table), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows[:20], [(1, rows[0][1])])


def test_bounds_are_never_below_the_score(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    terms, totals = lexical.weighed(docs, lexical.item_terms(spark.createDataFrame(
        [(i, t) for i, (_, t) in enumerate(rows[:10])], "item_id bigint, text string")))
    part = next(lexical.parts(terms))
    batches = lexical.index(docs).toArrow().to_batches()
    bound = {}
    for batch in lexical._bounds(part, totals, None, {})(iter(batches)):
        bound |= {(r["item"], r["doc_id"]): r["bound"] for r in batch.to_pylist()}
    text = dict(rows)
    for item, held in zip(part.items, part.terms):
        for doc_id, t in text.items():
            c = Counter(lexical._terms((t or "").encode()))
            m = int(lexical._damping(np.int64(sum(c.values())), totals))
            score = sum(w * (10 ** 9 * c[x] // (1000 * c[x] + 8 * m)) for x, w in held.items() if x in c)
            assert bound.get((item, doc_id), 0) >= score


def test_filter_holds_every_term(spark):
    words_ = [f"w{i}".encode() for i in range(500)]
    bits = lexical.term_filter(spark.createDataFrame([(bytearray(w),) for w in words_], "term binary"), 1 << 16)
    at = (lexical._hashed(words_) % np.uint64(1 << 16)).astype(np.int64)
    assert all(bits[at >> 3] >> (at & 7) & 1) and np.unpackbits(bits).sum() == len(set(at.tolist()))


def test_terms_hash_alike_in_texts_and_items():
    terms = [b"alpha", "é漢".encode(), b"x1"]
    data = np.frombuffer(b"Alpha, " + "é漢".encode() + b" X1", np.uint8)
    assert T.words(data, np.array([0, len(data)])).hashed.tolist() == lexical._hashed(terms).tolist()
