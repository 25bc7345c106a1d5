from pyspark.sql import functions as F

import corpus_pipeline
from authwatch.llm import langid, mixing
from authwatch.llm.columns import fold_of
from tests.llm import naive

ITEMS = "item_id bigint, text string"


def folder(spark, path, rows, items):
    spark.createDataFrame(rows, naive.SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_equal_their_plain_versions(spark, tmp_path):
    rows = naive.corpus(8)
    item = " ".join(naive.words(rows[1][1] + rows[2][1])[:30])
    rows[3] = (3, item + " and a little more", "en", "a", 10)
    path = folder(spark, tmp_path, rows, [(1, item)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "mixing"]

    docs = stages["language_id"](spark, docs, path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(texts) == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}

    docs = stages["near_dedup"](spark, docs, path)
    want = {i for i, c in naive.classes(list(texts.items())).items() if i == c}
    texts = {i: texts[i] for i in want}
    assert {r.doc_id: r.text for r in docs.collect()} == texts and docs.columns == columns

    docs = stages["suffix_dedup"](spark, docs, path)
    gone = naive.removed(list(texts.items()))
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(texts) and docs.columns == columns
    for i, r in got.items():
        assert r.n_chars == (len(r.text) if gone[i][1] else rows[i][4])
        assert (r.text == texts[i]) == (gone[i][1] == 0) and len(r.text.encode()) <= gone[i][0] - gone[i][1]

    texts = {i: r.text for i, r in got.items()}
    docs = stages["decontamination"](spark, docs, path)
    found = naive.contamination(list(texts.items()), [(1, item)])
    want = {i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in docs.collect()} == want and len(want) < len(texts) and docs.columns == columns

    final = stages["mixing"](spark, docs, path)
    assert set(final.columns) == {*columns, "mix_topic", "mix_tokens", "mix_probability"}
    assert {r.doc_id for r in final.collect()} <= want
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == {r.doc_id for r in final.collect()}


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [(1, "a b c")])).count() == 0


def test_one_document(spark, tmp_path):
    path = folder(spark, tmp_path, [(1, "one short text", "en", "a", 14)], [])
    assert [r.doc_id for r in corpus_pipeline.run(spark, path).collect()] == [1]
    assert mixing.MISSING


def test_identified_language_reaches_the_mixture(spark, tmp_path):
    """Rows whose source names no language or a wrong one are mixed under the language of their text."""
    rows = [list(r) for r in naive.corpus(8)]
    known = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    lost = {r[0] for r in known[::5]}
    for r in known[::5]:
        r[2] = None if r[0] % 2 else "xx"
    path = folder(spark, tmp_path, [tuple(r) for r in rows], [(1, "no such passage anywhere")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.fit(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    want = {r.doc_id: r.lang_pred for r in docs.select("doc_id", langid.predict(F.col("text"), model)["lang_pred"].alias("lang_pred")).collect()}
    staged = corpus_pipeline.identify_language(spark, docs, path).collect()
    assert {r.doc_id: r.lang for r in staged} == {i: p for i, p in want.items() if p != langid.UNDETERMINED}
    assert lost & {r.doc_id for r in staged}
    final = corpus_pipeline.run(spark, path).collect()
    assert final and all(r.lang == want[r.doc_id] for r in final)
    assert [r for r in final if r.doc_id in lost]
