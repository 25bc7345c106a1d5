"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authwatch.runtime import cut_lineage

#: Links that one task writes; a table of few links becomes few files, however many partitions a shuffle has.
TASK_LINKS = 100_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of the links (a, b), component being its smallest node.

    Alternates two steps until nothing changes: link each node's larger neighbours to its smallest one, then its
    smaller neighbours and itself. Each is an aggregate and a join on the node; rounds grow with the logarithm of the
    largest component. A hub's neighbours are never gathered: only their minimum is. No round has more links than the one before, so
    the tasks that write a round follow the last count.
    """
    least_tasks = links.sparkSession.sparkContext.defaultParallelism
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, count = None, edges.count()
    for _ in range(most_rounds):
        tasks = max(least_tasks, count // TASK_LINKS + 1)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        edges = cut_lineage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks))
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut_lineage(down.unionByName(least.withColumnRenamed("m", "v")).distinct().coalesce(tasks))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, count = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
