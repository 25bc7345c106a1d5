"""Exact order statistics without gathering a group's values in one place.

Nearest-rank selection by refined histograms. Equal values are counted first. While the range that holds a wanted rank has many distinct
values, it is cut into CELLS cells of equal width, the cells are counted in one aggregate, and the cell with the rank becomes the new
range. Only ranges with few distinct values are ever ordered, so no task sees more than FEW values or CELLS cells of a key and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

CELLS, FEW = 1024, 4096
#: Each round cuts the range by CELLS, so ten rounds are beyond any integer's; doubles that crowd around one point may need more.
MOST_ROUNDS = 120


def _in_range(counts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The counted values inside each range; without keys there are only as many ranges as ranks."""
    inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    return counts.join(ranges, keys).where(inside) if keys else counts.join(F.broadcast(ranges), inside)


def _narrowed(counts: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Each wide range cut down to the cell that holds its rank."""
    names = [*keys, "name", "rank"]
    share = (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    cells = _in_range(counts, wide.withColumnRenamed("__before", "__start"), keys).groupBy(
        *names, "__start", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).alias("__cell")).agg(
        F.sum("__c").alias("__m"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__distinct"))
    upto = Window.partitionBy(*names).orderBy("__cell")
    cells = cells.withColumn("__before", F.col("__start") + F.sum("__m").over(upto) - F.col("__m"))
    return cells.where((F.col("__before") < F.col("rank")) & (F.col("rank") <= F.col("__before") + F.col("__m"))).select(
        *names, "__lo", "__hi", "__before", "__distinct")


def select_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], few: int = FEW) -> DataFrame:
    """One row per key with, per name, the value at a 1-based rank; null where the rank is outside 1 to ``__n``.

    ``ranks`` are expressions over ``__n`` (the key's number of non-null values). Values are finite numbers; rows with a null
    value take no part, a key without any is left out, and a null key is no key. Without ``keys`` the result is one row, of
    nulls if there is no value. ``few`` is the number of distinct values up to which a range is ordered; it does not change results.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")).dropna(subset=keys or None)
    counts = cut_lineage(rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c")))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()]))
    ranges = counts.groupBy(*keys).agg(
        F.sum("__c").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__distinct"),
    ).where("__n > 0").select("*", wanted.alias("__w")).select(
        *keys, "__w.name", "__w.rank", "__lo", "__hi", F.lit(0).cast("long").alias("__before"), "__distinct")
    ranges = cut_lineage(ranges)
    for _ in range(MOST_ROUNDS):
        if ranges.where(F.col("__distinct") > few).isEmpty():
            break
        wide = ranges.where(F.col("__distinct") > few)
        ranges = cut_lineage(ranges.where(F.col("__distinct") <= few).unionByName(_narrowed(counts, wide, keys)))
    names = [*keys, "name", "rank"]
    upto = Window.partitionBy(*names).orderBy("__v")
    placed = _in_range(counts, ranges, keys).withColumn("__upto", F.col("__before") + F.sum("__c").over(upto))
    here = (F.col("__upto") >= F.col("rank")) & (F.col("__upto") - F.col("__c") < F.col("rank"))
    at = F.when(here, F.col("__v"))
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("name") == name, at)).alias(name) for name in ranks])


def nearest_rank(fraction: float) -> Column:
    """Rank ceil(f * n), at least 1, as used by every nearest-rank percentile here."""
    return F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("__n")))
