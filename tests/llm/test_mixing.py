from pyspark.sql import functions as F

from authwatch.llm import mixing
from tests.llm import naive


def test_marginals_meet_their_targets(spark):
    cells = spark.createDataFrame([(s, x, t, 10 + 7 * i % 23 + 50 * (s == "a"), 1) for i, (s, x, t) in enumerate(
        (s, x, t) for s in "abc" for x in ("en", "fr") for t in "uv")], "source string, lang string, topic string, tokens bigint, documents bigint")
    targets = {"source": {"a": .2, "b": .3, "c": .5}, "lang": {"en": .5, "fr": .5}, "topic": {"u": .9, "v": .1}}
    frames = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in targets.items()}
    out = mixing.rake(cells, frames, 20).collect()
    weight = sum(r.tokens * r.factor for r in out)
    for d, goal in targets.items():
        for value, share in goal.items():
            assert abs(sum(r.tokens * r.factor for r in out if r[d] == value) / weight - share) < 1e-6


def test_empty_cells_keep_their_factor(spark):
    cells = spark.createDataFrame([("a", "en", "u", 0, 3), ("b", "en", "u", 10, 1)], "source string, lang string, topic string, tokens bigint, documents bigint")
    out = {r.source: r for r in mixing.calibrate(mixing.rake(cells, mixing.power_targets(cells, {"source": .5, "lang": .5}))).collect()}
    assert 0 < out["a"].probability <= 1 and out["b"].probability > 0


def test_sample_follows_probabilities(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("source"), F.lit("en").alias("lang"),
        F.lit("four words of text").alias("text"), F.lit("mine").alias("cell"))
    got = mixing.mix(docs, {"source": 0.0})
    assert got.columns == [*docs.columns, "mix_topic", "mix_tokens", "mix_probability"]
    count = {r[0]: r[1] for r in got.groupBy("source").count().collect()}
    assert count["cold"] == 6000 and abs(count["hot"] - 6000) < 300
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in mixing.mix(docs.repartition(7), {"source": 0.0}).collect())


def test_odd_rows(spark):
    rows = naive.corpus(6)
    docs = spark.createDataFrame(rows + rows[:5] + [(None, "x", None, None, 1)], naive.SCHEMA)
    got = mixing.mix(docs, {"source": .5, "lang": .7, "topic": .7}, topic=F.when(F.col("doc_id") > 5, "t"))
    ids = [r.doc_id for r in got.collect()]
    assert all(ids.count(i) == 2 for i in set(ids) if i is not None and i < 5)
    assert {r.mix_topic for r in got.collect()} <= {"t", "(none)"}
    assert all(0 < r.mix_probability <= 1 for r in got.collect())
    assert mixing.mix(docs.limit(0), {"source": .5}).count() == 0
