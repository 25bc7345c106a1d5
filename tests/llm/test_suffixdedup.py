import random

import numpy as np
import pandas as pd
import pytest

from authwatch.llm import suffixdedup
from tests.llm import naive


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"split_above": 2, "block_bytes": 3000, "bucket_bytes": 9000}])
def test_equals_brute_force(spark, options):
    rows = naive.corpus()
    got = result(suffixdedup.repeated_bytes(spark.createDataFrame(rows, naive.SCHEMA), **options))
    assert got == naive.removed([r[:2] for r in rows])


def test_periodic_texts_and_length(spark):
    rows = [(i, t) for i, t in enumerate(["a" * 49, "a" * 50, "a" * 500, "ab" * 300, "ba" * 300, "\0" * 80, "\0" * 70])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for length in (50, 20):
        assert result(suffixdedup.repeated_bytes(df, length=length)) == naive.removed(rows, length)
    with pytest.raises(ValueError):
        suffixdedup.repeated_bytes(df, length=10)


def test_repeated_and_null_ids(spark):
    text = "The same passage of more than fifty bytes stands in every one of these rows."
    rows = [(1, text), (1, text), (None, text), (None, text), (0, "short")]
    got = suffixdedup.repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [
        (False, 0), (False, 0), (False, 0), (True, len(text)), (True, len(text))]


def test_empty_table(spark):
    assert suffixdedup.repeated_bytes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_suffix_sort_orders_like_bytes():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(600)), np.uint8)
    start = np.arange(540)
    order = suffixdedup.Suffixes(data, 50).sort(start, np.zeros(len(start), np.uint64))
    raw = data.tobytes()
    keys = [raw[s:s + 50] for s in order]
    assert keys == sorted(keys)


def test_collision_is_caught(monkeypatch):
    """With a useless hash all windows seem equal; the comparison of bytes must still tell them apart."""
    data = np.frombuffer(b"abcdefghij" * 3 + b"klmnopqrst" * 3, np.uint8)
    args = (data, np.array([0, 10, 30]), np.array([1, 1, 1]), np.array([5, 7, 9]), 20, np.zeros(3, np.uint32), np.full(3, 2))
    right = suffixdedup.smaller_start(*args)
    monkeypatch.setattr(suffixdedup.Suffixes, "common", lambda self, a, b: np.full(len(a), self.depth))
    assert suffixdedup.smaller_start(*args).tolist() == right.tolist() == [0, 1, 0]


def test_remove_repeats_keeps_columns_and_valid_text(spark):
    passage = "é" * 40
    rows = [(0, "x" + passage, 1, "k"), (1, "yé" + passage + "z", 2, "k"), (2, None, 3, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, kept_text string")
    out = {r.doc_id: r for r in suffixdedup.remove_repeats(df).collect()}
    assert out[0].text == rows[0][1] and out[2].text is None
    assert out[1].text == "yz" and out[1].n_chars == 2 and out[1].kept_text == "k"


def test_other_columns_come_back_as_they_were(spark):
    passage = "The same passage of more than fifty bytes stands in both of these two rows."
    rows = spark.range(4).selectExpr(
        "id AS doc_id", f"concat(id, ' {passage}') AS text", "timestamp_micros(1700000000123456 + id) AS seen",
        "map(id, 'x', id + 7, null) AS by_number", "unhex('00ff10') AS raw", "double('NaN') AS odd", "cast(1.50 AS decimal(20,4)) AS price",
        "array(struct(date'0001-01-01' AS d, null AS n)) AS nested", "CAST(NULL AS string) AS nothing", "'b' AS carried", "'c' AS kept")
    want = {r["doc_id"]: r for r in rows.collect()}
    got = suffixdedup.remove_repeats(rows)
    assert got.schema.simpleString() == rows.schema.simpleString()
    for r in got.collect():
        plain = [(c, r[c], want[r.doc_id][c]) for c in rows.columns if c not in ("text", "odd")]
        assert all(a == b for _, a, b in plain), plain
        assert r.odd != r.odd and r.text == (f"0 {passage}" if r.doc_id == 0 else str(r.doc_id))


def test_rows_without_id_fill_many_blocks(spark):
    passage = "This passage of more than fifty bytes stands in a row with an id and in all others."
    rows = [(1, passage)] + [(None, f"{i} {passage} {i * i}") for i in range(300)]
    got = suffixdedup.repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=2000).collect()
    assert len(got) == 301 and [r.n_removed for r in got if r.doc_id == 1] == [0]
    assert all(r.n_removed == len(passage) for r in got if r.doc_id is None)


def test_a_block_counts_all_runs_of_a_gram():
    text = "x".join(f"{i:06d}abcdefghijklmnopqrstuvwxyz" for i in range(900))
    block = suffixdedup.Block(pd.DataFrame({"doc_id": [1], "text": [text]}), 50)
    grams, state = block.known
    known, times = np.unique(block.gram, return_counts=True)
    assert grams.tolist() == known.tolist() and state.tolist() == times.tolist() and times.max() > 127
