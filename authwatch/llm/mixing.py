"""Mixing sources to target weights by iterative proportional fitting (operator 10, DataFrame operations only).

Tokens are counted by cell (source x language x topic). Raking multiplies the cells' factors until the weighted tokens meet the
target share of every source, language and topic. A document is then kept with the probability of its cell: its
factor, scaled so that the largest probability is 1 (or to a wanted number of tokens). A hash of the id decides, so
the sample is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authwatch.llm.columns import free_name
from authwatch.runtime import cut_lineage

MISSING = "(none)"
DIMENSIONS = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """Words between blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("bigint")


def size_topic(n_tokens: Column) -> Column:
    """A stand-in where documents carry no topic: the kind of text by its length."""
    return F.when(n_tokens < 100, "note").when(n_tokens < 800, "article").otherwise("long read")


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the id: the first 52 bits of an MD5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/" + seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def power_targets(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Target shares that flatten a dimension: proportional to tokens^power of each of its values."""
    out = {}
    for dim, power in powers.items():
        sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
        out[dim] = sums.select(dim, F.pow("t", F.lit(power)).alias("target"))
    return out


def cells_of(docs: DataFrame) -> DataFrame:
    """Documents and tokens by cell; ``docs`` has the dimensions and ``n_tokens``."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 8) -> DataFrame:
    """Add ``factor`` to the cells: tokens * factor has (nearly) the target share in each dimension.

    ``targets``: by dimension, a value column of that name and a weight ``target`` (any scale, summed over the values
    that have tokens). Values without a target, or without tokens, keep their factor in that dimension's step. Each
    round adjusts the dimensions in their order, so after the last round the last one is met exactly.
    """
    rows = cells.withColumn("factor", F.lit(1.0))
    for dim in DIMENSIONS:
        if dim in targets:
            rows = rows.join(targets[dim].groupBy(dim).agg(F.sum("target").alias(f"{dim}_target")), dim, "left")
    for i in range(rounds):
        for dim in DIMENSIONS:
            if dim in targets:
                have = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(dim))
                ratio = F.col(f"{dim}_target") / have
                rows = rows.withColumn("factor", F.when((have > 0) & F.col(f"{dim}_target").isNotNull(),
                                                        F.col("factor") * ratio).otherwise(F.col("factor")))
    return rows.select(*DIMENSIONS, "tokens", "documents", "factor")


def calibrate(cells: DataFrame, wanted_tokens: float | None = None) -> DataFrame:
    """Add ``probability``: factor x scale, at most 1; the scale makes the largest 1, or meets ``wanted_tokens``."""
    expected = cells.agg(F.max("factor").alias("most"), F.sum(F.col("tokens") * F.col("factor")).alias("weighted"))
    scale = 1 / F.col("most") if wanted_tokens is None else F.lit(float(wanted_tokens)) / F.col("weighted")
    one = expected.select(scale.alias("scale"))  # one row
    return cells.join(F.broadcast(one), F.lit(True)).withColumn(
        "probability", F.least(F.lit(1.0), F.col("factor") * F.col("scale"))).drop("scale")


def mix(docs: DataFrame, powers: dict[str, float], topic: Column | None = None, text: str = "text",
        key: str = "doc_id", targets: dict[str, DataFrame] | None = None, rounds: int = 8,
        wanted_tokens: float | None = None, seed: str = "mix", columns: list[str] | None = None) -> DataFrame:
    """Sample documents so that their expected tokens have the target shares.

    Returns ``columns`` (all by default) of the kept documents with ``mix_topic``, ``mix_tokens`` and
    ``mix_probability`` (replacing columns of those names). Null sources, languages and topics form a value of their
    own. Null and empty texts have 0 tokens and are kept by their cell's probability. Rows with the same id are kept
    or left out together. ``targets`` replace the ones from ``powers`` by dimension.
    """
    docs = docs.drop("mix_topic", "mix_tokens", "mix_probability")
    n = tokens(F.col(text))
    kind = F.coalesce((size_topic(n) if topic is None else topic).cast("string"), F.lit(MISSING))
    keep = columns or docs.columns
    full = docs.select(*docs.columns, n.alias("mix_tokens"), kind.alias("mix_topic"))
    dims = {"source": F.coalesce(F.col("source").cast("string"), F.lit(MISSING)),
            "lang": F.coalesce(F.col("lang").cast("string"), F.lit(MISSING)), "topic": F.col("mix_topic")}
    # one row for each cell: stored, since the raking steps read it several times
    cells = cut_lineage(cells_of(full.select(*[c.alias(d) for d, c in dims.items()], F.col("mix_tokens").alias("n_tokens"))))
    goals = power_targets(cells, powers) | (targets or {})
    odds = calibrate(rake(cells, goals, rounds), wanted_tokens).select(
        F.struct(*DIMENSIONS).alias("cell"), F.col("probability").alias("mix_probability"))
    name = free_name(full, "cell")
    odds = cut_lineage(odds).withColumnRenamed("cell", name)
    placed = full.withColumn(name, F.struct(*[c.alias(d) for d, c in dims.items()])).join(odds, name)
    return placed.where(uniform(F.col(key), seed) < F.col("mix_probability")).select(
        *keep, "mix_topic", "mix_tokens", "mix_probability")
