"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authwatch.llm import (
    ann, compression, decontaminate, interactions, langid, lexical, mixing, neardup, quality, suffixdedup, toolcalls, toxicity, urlfilter,
)
from authwatch.llm import text as T
from authwatch.llm.columns import fold_of
from authwatch.runtime import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
TOOLS = {"search": {"text": ("string", True), "limit": ("integer", False)}, "summarise": {"text": ("string", True)}}
#: Sources and topics are flattened, languages a little: shares proportional to tokens^power.
MIX_POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, fold: int, key: str = "doc_id") -> Column:
    return F.coalesce(fold_of(F.col(key), modulus) == fold, F.lit(False))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = urlfilter.classify(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    T.bounded_batches(spark)
    known = cut_lineage(docs.select("doc_id", quality.with_statistics(F.col("text")).alias("x")))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    train = known.where(fold_of(F.col("doc_id"), 3) != 1).join(labels, "doc_id")
    model = quality.fit(train)
    out = known.select("doc_id", held_out(3, 1).alias("held_out"), quality.score(F.col("x"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns stand for calls, the user turns right after them for results; each call needs the first one's result."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.where("role = 'assistant'")
    name = F.element_at(F.array(*map(F.lit, ("search", "summarise", "unlisted"))), (F.length("text") % 3 + 1).cast("int"))
    limit = F.when(F.length("text") % 5 == 0, F.concat(F.lit('"'), F.col("turn"), F.lit('"'))).otherwise(F.col("turn").cast("string"))
    # written with blanks and unsorted keys, as a model would: {"t":x} gives x as a JSON text
    quoted = F.to_json(F.struct(F.col("text").alias("t")), {"ignoreNullFields": "false"})
    quoted = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    raw = F.concat(F.lit('{ "text" : '), quoted, F.lit(' , "limit" : '), limit, F.lit(" }"))
    call_id = F.concat(F.lit("c"), F.col("turn"))
    calls = asked.select("conv_id", "turn", call_id.alias("call_id"), name.alias("name"), raw.alias("arguments"))
    answered = asked.select("conv_id", (F.col("turn") + 1).alias("turn")).distinct()
    users = turns.where("role = 'user'")
    results = users.join(answered, ["conv_id", "turn"], "left_semi").select(
        "conv_id", "turn", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    plain = turns.where("role NOT IN ('user', 'assistant')").unionByName(
        users.join(answered, ["conv_id", "turn"], "left_anti").select(turns.columns))
    first = asked.groupBy("conv_id").agg(F.min("turn").alias("first"))
    needs = asked.select("conv_id", "turn").join(first, "conv_id").where("turn > first").select(
        "conv_id", call_id.alias("call_id"), F.concat(F.lit("c"), F.col("first")).alias("needed_id"))
    return toolcalls.link(plain, calls, results, toolcalls.schema_rows(spark, TOOLS), needs).withColumn(
        "errors", F.array_join("errors", ","))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    sampled, totals = toxicity.thin(labels.where(fold_of(F.col("doc_id"), 3) != 1), "grade", F.col("doc_id"), 1500)
    # at most about 1,500 ids of each grade
    model = toxicity.fit(docs.join(F.broadcast(sampled), "doc_id"), levels=3, totals=totals)
    scored = docs.select("doc_id", held_out(3, 1).alias("held_out"), toxicity.score(F.col("text"), model).alias("s"))
    return scored.select("doc_id", "held_out", "s.severity", "s.score", "s.grade", (F.col("s.score") >= 0.5).alias("toxic"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "match")
    m = F.col("match")
    return found.select(
        "doc_id", m["n_words"].alias("n_words"), decontaminate.n_hit(m).alias("n_hit"),
        F.size(m["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(m["items"]), ","), 256).alias("items_sha256"),
        decontaminate.contaminated(m).alias("contaminated"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.neighbours(ann.index(rows, 20), rows.where("vec_id % 20 = 0"), 20)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    out = docs.select("doc_id", held_out(4, 2).alias("held_out"), langid.predict(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    kept = mixing.mix(docs, MIX_POWERS, columns=["doc_id", "source", "lang"])
    return kept.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
                       F.round("mix_probability", 9).alias("probability"))


def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", compression.judge(F.col("text")).alias("c")).select("doc_id", "c.*")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lexical.search(docs, lexical.index(docs), table(spark, sf_dir, "benchmark"), 10)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return interactions.orders(interactions.failure_counts(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_url_filter, op2_suffix_dedup, op3_quality, op4_tool_calls, op5_toxicity, op6_decontamination, op7_neighbours,
    op8_near_duplicates, op9_language, op10_mixing, op11_compression, op12_lexical_search, op13_filter_audit)}
