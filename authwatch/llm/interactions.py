"""Filter interaction audit: what filters remove alone, together and in every order (operator 13).

Documents are counted by part and by the set of filters they fail. From these counts come the removals of all 2^n coalitions of
filters, and the differences of coalitions give each step of each order. A filter's Shapley value is the solution of
the constrained least squares problem over coalitions: weights by the Shapley kernel, the shares sum to what all filters remove.
Its normal equations are solved in rationals once, as they do not depend on the counts; times n! the solution is whole.
"""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
REPEATED = 16  # bit of filter E
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]")


def text_failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails: short, few distinct words, capitals, marks."""
    words = raw.split()
    chars = len(raw.translate(None, _CONTINUED))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * chars) << 2
            | (_MARKS.search(raw) is not None) << 3)


def text_marks(text: Column) -> Column:
    """Struct of ``mask`` (failed filters A to D) and ``digest`` (SHA-256 of the text); null counts as empty."""
    kind = pa.struct([("mask", pa.int32()), ("digest", pa.binary())])

    @F.arrow_udf("mask int, digest binary")
    def run(column: pa.Array) -> pa.Array:
        texts = [x.as_py() or b"" for x in column.cast(pa.large_binary())]
        return pa.StructArray.from_arrays([
            pa.array([text_failures(x) for x in texts], pa.int32()),
            pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())], fields=list(kind))

    return run(text)


def failure_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, and how many of them are labelled so.

    ``labels`` has the key, ``quality`` and ``toxic``; a document with several rows there is good or toxic if one of them
    says so. A null part is the empty one. A null text is empty and equal to other empty texts. A row without id is equal to no
    smaller id and has no label. Rows of one id and text fail E together, or not at all.

    Rows are counted by text, part and labels before texts meet, so a text that a third of all rows share is a few counts.
    """
    # rows without id get a number of their own, or they would all land in one task
    lone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    marked = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                         text_marks(F.col(text)).alias("m")).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), lone.alias("lone"), "part", "m.*")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("lone")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = marked.join(known, ["id", "lone"], "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "mask", "part", "good", "toxic"]
    rows = labelled.groupBy("id", "lone", *kind).agg(F.count("*").alias("n")).withColumn(
        "doc_id", F.when(F.col("lone") < 0, F.col("id")))
    # of each group only rows of its smallest id can be first of their text
    groups = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_lone"))
    first = groups.groupBy("digest").agg(F.min("least").alias("first"))
    passed = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0) + F.col("n_lone")
    # each mask with its count: those that stand first, and the rest, which fail E
    both = F.array(F.struct(F.col("mask").alias("mask"), passed.alias("n")),
                   F.struct((F.col("mask") + REPEATED).alias("mask"), (F.col("n") - passed).alias("n")))
    return groups.join(first, "digest").select("part", "good", "toxic", F.explode(both).alias("c")).groupBy(
        "part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"),
        F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with matrix X = right, by elimination in rationals."""
    rows = [a + b for a, b in zip(matrix, right)]
    size = len(rows)
    for i in range(size):
        pivot = next(r for r in range(i, size) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(size):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [r[size:] for r in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """W[i][S] so that n! times the Shapley value of filter i is the sum of W[i][S] * removed(S) over coalitions S.

    Least squares of removed(S) against the sums of members' shares, weighted by (n - 1) / (C(n, s) s (n - s)), under the
    constraint that all shares sum to removed(all): normal equations with a multiplier, one right side for each coalition.
    """
    full = 2 ** n - 1
    if n == 1:
        return [[0, 1]]
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, full)}
    held = range(n)
    matrix = [[sum((k for s, k in kernel.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in held] + [Fraction(1)] for i in held]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel[s] if s in kernel and s >> i & 1 else Fraction(0) for s in range(full + 1)] for i in held]
    right.append([Fraction(int(s == full)) for s in range(full + 1)])
    scaled = [[x * factorial(n) for x in row] for row in solve(matrix, right)[:n]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("Shapley values times n! must be whole")
    return [[int(x) for x in row] for row in scaled]


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from counts by failed set (part, mask, n, good, toxic).

    Bit i of a mask stands for the i-th letter. An empty table of counts gives no rows; a part's missing masks count 0.
    """
    n, full = len(filters), 2 ** len(filters) - 1
    measures = ("n", "good", "toxic")
    by_mask = counts.groupBy("part").agg(*[
        F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(full + 1)]).alias(f"{c}_of") for c in measures])

    def removed(c: str) -> Column:
        """Removals of all coalitions: documents that fail one of their filters."""
        of = F.col(f"{c}_of")
        return F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: F.aggregate(
            F.sequence(F.lit(1), F.lit(full)), F.lit(0).cast("bigint"),
            lambda acc, m: acc + F.when(m.bitwiseAND(s) != 0, F.get(of, m)).otherwise(0)))

    sums = by_mask.select("part", "n_of", *[removed(c).alias(c) for c in measures])
    weights = shapley_weights(n)
    values = F.array(*[sum(F.lit(w) * F.get("n", F.lit(s)) for s, w in enumerate(row) if w) for row in weights])
    sums = sums.select("part", "n", "good", "toxic", "n_of", values.alias("values"),
                       F.aggregate("n_of", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
    every = F.lit(["".join(p) for p in permutations(filters)])
    steps = sums.select("*", F.explode(every).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))

    def bit(at: Column) -> Column:
        return F.instr(F.lit(filters), F.substring(F.col("filter_order"), at, F.lit(1))) - 1

    before = F.when(F.col("step") == 1, 0).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("step") - 1, F.lit(1))), F.lit(0),
        lambda acc, at: acc + F.pow(F.lit(2), bit(at)).cast("int"))).cast("int")
    steps = steps.withColumns({"at": bit(F.col("step")), "before": before})
    steps = steps.withColumn("own", F.pow(F.lit(2), F.col("at")).cast("int"))

    def gained(c: str) -> Column:
        return F.get(c, F.col("before") + F.col("own")) - F.get(c, F.col("before"))

    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.get("n", F.col("before") + F.col("own"))).alias("kept"),
        gained("n").alias("removed"), (F.get("n", "own") - gained("n")).alias("redundant"),
        F.get("n_of", "own").alias("unique_fails"), gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"),
        F.get("values", "at").alias("shapley"))
