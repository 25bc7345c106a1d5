"""From raw documents to a training mixture: five stages, each an operator of ``authwatch.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authwatch.llm import decontaminate, langid, mixing, neardup, suffixdedup
from authwatch.llm.columns import fold_of
from authwatch.llm.queries import MIX_POWERS, table
from authwatch.runtime import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be determined, with whatever score, and with that language as ``lang``.

    Only texts without a letter are left out. The mixture counts and balances languages by what is identified here, so a
    missing or wrong ``lang`` of the source does not reach it.
    """
    model = langid.fit(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    found = langid.predict(F.col("text"), model)["lang_pred"]
    return docs.withColumn("lang", F.nullif(found, F.lit(langid.UNDETERMINED))).where("lang IS NOT NULL")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return suffixdedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares by source, language and topic."""
    return mixing.mix(docs, MIX_POWERS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", sample_mixture),
]
#: Language models and signatures are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
