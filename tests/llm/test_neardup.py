import numpy as np

from authwatch.llm import graph, neardup
from tests.llm import naive


def result(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_equals_brute_force(spark):
    rows = naive.corpus(3)
    got = neardup.near_duplicates(spark.createDataFrame(rows, naive.SCHEMA))
    assert result(got) == naive.classes([r[:2] for r in rows])
    sizes = {r.doc_id: r.n_shingles for r in got.collect()}
    assert sizes == {r[0]: len(naive.shingles(r[1])) for r in rows}


def test_pairs_without_the_first_text_are_found(spark):
    """In one band: texts unlike its first one, but like each other."""
    w = [f"w{i}" for i in range(60)]
    texts = [(0, " ".join(w)), (1, " ".join(["z"] * 30 + w[30:])), (2, " ".join(["z"] * 30 + w[30:] + ["end"])), (3, "q r s t u v"),
             (4, " ".join(w + ["end"]))]
    nodes = spark.createDataFrame(texts, "node bigint, text string")
    banded = spark.createDataFrame([(i, 7) for i, _ in texts], "node bigint, band bigint")
    found = neardup.links(nodes, banded)
    got = {r.node: r.component for r in graph.components(found).collect()}
    assert got == {0: 0, 4: 0, 1: 1, 2: 1}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    element = rng.integers(0, 2**63, 600).astype(np.uint64)
    for top in (1, 7):
        weight = rng.integers(1, top + 1, 600).astype(float)
        a = neardup.dart_signatures(np.zeros(600, int), element, weight, 1, 4096)[0]
        b = neardup.dart_signatures(np.zeros(450, int), element[150:], weight[150:], 1, 4096)[0]
        assert np.isfinite(a).all() and abs((a == b).mean() - weight[150:].sum() / weight.sum()) < 0.03


def test_weighted_counts_repeats(spark):
    a, b = "a b c d e " * 20, "a b c d e " * 8
    docs = spark.createDataFrame([(0, a), (1, b)], "doc_id bigint, text string")
    assert result(neardup.near_duplicates(docs)) == {0: 0, 1: 0}
    assert result(neardup.near_duplicates(docs, weighted=True)) == {0: 0, 1: 1}


def test_repeated_null_and_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A, b. c d e f"), (7, None), (8, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(5, 5), (5, 5), (7, 7), (8, 8), (9, 5)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(empty).count() == 0


def test_keep_one_keeps_columns(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other words", "z"), (None, "a b c d e f", "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, gone_id string")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.gone_id for r in kept.collect())) == ["n", "x", "z"]


def test_rounds_of_few_links_write_few_files(spark):
    """However many partitions a shuffle has; an empty task's start and file cost more than its links."""
    from pyspark.sql import functions as F

    from authwatch import runtime

    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("b % 4 <> 0")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    begun = runtime.stored_so_far()
    try:
        got = {r.node: r.component for r in graph.components(links).collect()}
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert got == {i: i // 4 * 4 for i in range(400)}
    files = [len(spark.read.parquet(path).inputFiles()) for path in runtime._stored[begun:]]
    assert max(files[1:]) <= spark.sparkContext.defaultParallelism < 24


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_slice_of_blank_texts(spark):
    rows = [(i, (None, "", " ", "?!")[i % 4]) for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert all(r.class_id == r.doc_id and r.n_shingles == 0 for r in got) and len(got) == 40


def test_one_id_with_several_texts(spark):
    """Each text of an id is compared by itself, and the id joins the classes of all its texts."""
    a, z = [f"a{i}" for i in range(60)], [f"z{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(z)), (1, ""), (2, " ".join(z + ["end"])), (3, " ".join(["start"] + a)), (4, "a b c d e f"), (4, "a b c d e f"),
            (0, " ".join(z[1:]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(0, 0)] + [(1, 0)] * 3 + [(2, 0), (3, 0), (4, 4), (4, 4)]


def test_a_family_of_unlike_texts(spark):
    """Thousands of texts that share half their words stay apart; one pair of them is alike."""
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(common + [f"w{i}x{k}" for k in range(40)])) for i in range(2500)]
    rows.append((9000, rows[77][1] + " end"))
    got = result(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {i: c for i, c in got.items() if c != i} == {9000: 77}
