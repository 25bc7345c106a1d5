import hashlib

import pytest
from pyspark.sql import functions as F

from authwatch.llm import decontaminate
from authwatch.llm.queries import op6_decontamination
from tests.llm import naive

ITEMS = "item_id bigint, text string"


def inputs():
    rows = naive.corpus(2)
    long = rows[0][1]
    items = [(1, long), (2, long), (3, " ".join(naive.words(rows[1][1])[:6]) or "x"), (4, "x"), (5, None), (6, "..."),
             (7, "ab ab"), (10, long.upper()), (None, long)]
    return rows, items


@pytest.mark.parametrize("max_words", [500_000, 5])
def test_equals_brute_force(spark, max_words):
    rows, items = inputs()
    docs = spark.createDataFrame(rows, naive.SCHEMA)
    got = decontaminate.match(docs, spark.createDataFrame(items, ITEMS), max_words=max_words)
    got = {r.doc_id: (r.n, r.h, r["items"]) for r in got.select(
        "doc_id", F.col("match.n_words").alias("n"), decontaminate.n_hit(F.col("match")).alias("h"), "match.items").collect()}
    assert got == naive.contamination([r[:2] for r in rows], items)


def test_query_digest(spark, tmp_path):
    rows, items = inputs()
    spark.createDataFrame(rows, naive.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = naive.contamination([r[:2] for r in rows], items)
    for r in op6_decontamination(spark, str(tmp_path)).collect():
        n, hit, names = want[r.doc_id]
        digest = hashlib.sha256(",".join(x for x in names if x is not None).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(names), digest)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_drop_and_cut(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "Pré, " + passage.upper() + "! fin", "kept"), (2, passage + " o" * 900, "kept"), (3, "clean", "kept"), (4, None, "kept")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found_ string")
    items = spark.createDataFrame([(1, passage)], ITEMS)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, action="cut").collect()}
    assert cut == {1: "Pré, ! fin", 2: " o" * 900, 3: "clean", 4: None}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], ITEMS)
    assert decontaminate.match(docs, items).first()["match"]["n_words"] == 2
    assert decontaminate.match(docs.limit(0), items).count() == 0


def test_an_item_without_id_still_hits(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, passage), (2, "w1 w2")], "doc_id bigint, text string")
    got = {r.doc_id: r.match for r in decontaminate.match(docs, spark.createDataFrame([(None, passage)], ITEMS)).collect()}
    assert [(s["first"], s["end"]) for s in got[1]["spans"]] == [(0, 15)] and got[1]["items"] == [None]
    assert got[2]["spans"] == [] and got[2]["items"] == []
