"""Language, quality and toxicity models: held-out accuracy on the given tables, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from authwatch.llm import langid, quality, queries, toxicity
from authwatch.llm.sampling import thin

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "   "), (4, "123 !?"), (5, "é"), (6, "x"), (6, "x"), (7, "word " * 200_000), (None, "some text")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_language(spark, SF).join(docs, "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_language_of_odd_texts(spark, odd):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"),
                                                        ("le chat et le chien", "fr"), ("kissa ja koira", "fi"), ("no label", None), (None, "en")] * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.families == [("de", "en"), ("fr",), ("fi",)]
    got = odd.select("doc_id", langid.predict(F.col("text"), model).alias("p")).select("doc_id", "p.*").collect()
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 4)) and 0 <= r.score <= 1
    learned = spark.createDataFrame([(1, "the dog and the cat"), (2, "die Katze und der Hund"), (3, "koira ja kissa")], "i bigint, text string")
    assert [r[0] for r in learned.orderBy("i").select(langid.predict(F.col("text"), model)["lang_pred"]).collect()] == ["en", "de", "fi"]


def test_language_score_does_not_fall_with_the_size_of_a_family(spark):
    names = langid.FAMILIES["germanic"] if "germanic" in langid.FAMILIES else max(langid.FAMILIES.values(), key=len)
    letters = dict(zip(names, ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op")))
    rows = [(i, " ".join(2 * [x + y + x, y + x + y, x + x + y]), n) for i, (n, (x, y)) in enumerate(list(letters.items()) * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert len(model.families) == 1 and len(names) > 3
    got = docs.limit(len(names)).select("lang", langid.predict(F.col("text"), model).alias("p")).select("lang", "p.*").collect()
    assert all(r.lang == r.lang_pred and 0.75 < r.score <= 1 for r in got)


def test_language_without_training(spark, odd):
    assert langid.fit(spark.createDataFrame([], "doc_id bigint, text string, lang string")) is None
    assert {r[0] for r in odd.select(langid.predict(F.col("text"), None)["lang_pred"]).collect()} == {"und"}
    one = langid.fit(spark.createDataFrame([(1, "only one", "en")], "doc_id bigint, text string, lang string"))
    assert odd.where("doc_id = 7").select(langid.predict(F.col("text"), one)["lang_pred"]).first()[0] == "en"
    assert odd.limit(0).select(langid.predict(F.col("text"), one)).count() == 0


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op3_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good = [r.predicted for r in got if r.quality == 1]
    bad = [r.predicted for r in got if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2


def test_quality_equals_plain_discriminant(spark):
    rng = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (60, d)), rng.normal(1, 2, (40, d))])
    y = np.repeat([0, 1], [60, 40])
    rows = [(int(k), v.tolist()) for k, v in zip(y, x)] + [(None, x[0].tolist()), (2, x[0].tolist())]
    model = quality.fit(spark.createDataFrame(rows, "label int, x array<double>").repartition(5), 0.1, 0.05)
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = 0.6 * cov[0] + 0.4 * cov[1]
    log = []
    for k in (0, 1):
        c = 0.95 * cov[k] + 0.05 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-6 * np.eye(d)
        z = x - x[y == k].mean(0)
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) + np.linalg.slogdet(c)[1]))
    want = 1 / (1 + np.exp(log[0] - log[1] - np.log(40 / 60)))
    assert np.allclose(model.score(x), want)


def test_quality_of_odd_texts(spark, odd):
    got = odd.select("doc_id", quality.with_statistics(F.col("text")).alias("x")).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.x).all() and len(r.x) == len(quality.STATISTICS) for r in got)
    assert quality.fit(spark.createDataFrame([(1, [0.0] * 10)], "label int, x array<double>")) is None
    assert {r[0] for r in odd.select(quality.score(quality.with_statistics(F.col("text")), None)).collect()} == {0.5}
    same = quality.fit(spark.createDataFrame([(k, [1.0] * len(quality.STATISTICS)) for k in (0, 1, 1)], "label int, x array<double>"))
    assert np.isfinite(same.score(np.zeros((2, len(quality.STATISTICS))))).all()


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marked = labels.select("doc_id", F.col("toxic").alias("marked"))
    got = queries.op5_toxicity(spark, SF).where("held_out").join(marked, "doc_id").collect()
    clean = [r.toxic for r in got if r.marked == 0]
    assert np.mean(clean) < 0.02
    assert np.mean([r.severity for r in got if r.marked == 1]) > 4 * np.mean([r.severity for r in got if r.marked == 0])


def test_ordinal_thresholds_share_weights(spark):
    rows = [(i, "calm " + "bad " * (i % 3 > 0) + "awful " * (i % 3 > 1) + f"n{i}", i % 3) for i in range(450)] + [(500, "calm", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, grade int"))
    assert len(model.cuts) == 2 and model.cuts[0] > model.cuts[1]
    got = spark.createDataFrame([(0, "calm"), (1, "calm bad"), (2, "calm bad awful")], "i bigint, text string").orderBy("i").select(
        toxicity.score(F.col("text"), model).alias("s")).select("s.*").collect()
    assert [r.grade for r in got] == [0, 1, 2]
    assert got[0].severity < got[1].severity < got[2].severity <= 2


def test_toxicity_of_a_broad_lexicon(spark):
    draw = np.random.default_rng(5)
    bad, plain = [f"bad{i}" for i in range(100)], [f"plain{i}" for i in range(500)]
    often = np.repeat([1, 3], 50) / 200  # two words a toxic text: each word is in 1 % or 3 % of them

    def made(i):
        words = [*draw.choice(plain, 15), *(draw.choice(bad, 2, replace=False, p=often) if i % 2 else [])]
        return i, " ".join(draw.permutation(words)), i % 2

    rows = spark.createDataFrame([made(i) for i in range(3600)], "doc_id bigint, text string, grade int")
    model = toxicity.fit(rows.where("doc_id < 3000"), levels=3)
    got = rows.where("doc_id >= 3000").select("grade", toxicity.score(F.col("text"), model)["score"].alias("score")).collect()
    assert np.mean([r.score >= 0.5 for r in got if r.grade == 1]) > 0.9
    assert np.mean([r.score >= 0.5 for r in got if r.grade == 0]) < 0.02


def test_toxicity_of_odd_texts(spark, odd):
    assert toxicity.fit(spark.createDataFrame([(1, "a", 0)], "doc_id bigint, text string, grade int")) is None
    assert {tuple(r.s) for r in odd.select(toxicity.score(F.col("text"), None).alias("s")).collect()} == {(0.0, 0.0, 0)}
    model = toxicity.OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([0.5, -1.0]))
    got = odd.select(toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == len(ODD) and len({tuple(r.s) for r in got}) == 1
    assert odd.limit(0).select(toxicity.score(F.col("text"), model)).count() == 0


def test_sample_is_bounded_and_steady(spark):
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN 'rare' WHEN id % 7 = 0 THEN NULL ELSE 'hot' END AS label")
    sample, counts = thin(rows, "label", F.col("id"), 300)
    assert counts["rare"] == 60 and sum(counts.values()) == rows.where("label IS NOT NULL").count()
    got = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    assert got["rare"] == 60 and 230 < got["hot"] < 370 and None not in got
