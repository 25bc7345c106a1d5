"""Least and greatest value of points inside intervals, without a range join.

Time is cut into blocks. Blocks are summed up in nodes of RADIX^level blocks, one row for each node with a point, so every
interval is the union of a few nodes (at most 2 * RADIX for each level), which it meets by an equality join, and of parts of its
first and last block, whose instants it meets by an equality join on the block. Points are never listed by interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket
from ..runtime import cut_lineage

RADIX, LEVELS = 8, 7
_BITS = 3  # RADIX is 2 to this power


def _between(start: Column, end: Column) -> Column:
    """The whole numbers of [start, end), none where it is empty."""
    return F.when(start < end, F.sequence(start, F.greatest(start, end - 1))).otherwise(F.array().cast("array<bigint>"))


def covering_nodes(first: Column, end: Column) -> Column:
    """Array of (level, node) whose nodes together are the blocks of [first, end).

    Each level takes what is left over beside the next level's whole nodes; the last level takes all that remains.
    """
    def placed(nodes: Column, level: int) -> Column:
        return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))

    def bounds(level: int) -> tuple[Column, Column]:
        """The whole nodes of a level inside the interval; a shift rounds down, also below zero."""
        return F.shiftright(first + (RADIX ** level - 1), _BITS * level), F.shiftright(end, _BITS * level)

    found = []
    for level in range(LEVELS):
        own_first, own_end = bounds(level)
        nodes = _between(own_first, own_end)
        if level < LEVELS - 1:
            inner_first, inner_end = bounds(level + 1)
            nodes = F.when(inner_first < inner_end, F.concat(
                _between(own_first, inner_first * RADIX), _between(inner_end * RADIX, own_end))).otherwise(nodes)
        found.append(placed(nodes, level))
    return F.concat(*found)


def interval_extremes(points: DataFrame, intervals: DataFrame, keys: list[str], value: str, block_us: int = 60_000_000) -> DataFrame:
    """Rows of ``intervals`` with ``least`` and ``greatest`` value of the points of their key in [first_us, last_us].

    ``points``: the keys, ``us`` and the value; ``intervals``: the keys, a unique ``interval_id``, ``first_us`` and
    ``last_us``. Both ends count. Both results are null without a point, or where an end or a key is null, or the ends are
    turned round. Points with a null value or instant take no part.
    """
    instants = points.where(F.col(value).isNotNull() & F.col("us").isNotNull()).groupBy(*keys, "us").agg(
        F.min(value).alias("least"), F.max(value).alias("greatest")).withColumn("block", bucket(F.col("us"), block_us))
    instants = cut_lineage(instants)
    blocks = instants.groupBy(*keys, "block").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    levels = F.explode(F.array(*[F.struct(F.lit(j).alias("level"), bucket(F.col("block"), RADIX ** j).alias("node"))
                                 for j in range(LEVELS)]))
    nodes = blocks.select(*keys, levels.alias("at"), "least", "greatest").groupBy(*keys, "at.level", "at.node").agg(
        F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    asked = cut_lineage(intervals.select(
        *keys, "interval_id", "first_us", "last_us", bucket(F.col("first_us"), block_us).alias("a"),
        bucket(F.col("last_us"), block_us).alias("b")).where("first_us <= last_us"))
    inner = asked.select(*keys, "interval_id", F.explode(covering_nodes(F.col("a") + 1, F.col("b"))).alias("at")).select(
        *keys, "interval_id", "at.level", "at.node").join(nodes, [*keys, "level", "node"])
    edges = asked.select(*keys, "interval_id", "first_us", "last_us", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(
        instants, [*keys, "block"]).where("us BETWEEN first_us AND last_us")
    both = inner.select("interval_id", "least", "greatest").unionByName(edges.select("interval_id", "least", "greatest"))
    found = both.groupBy("interval_id").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return intervals.join(found, "interval_id", "left")
