"""Bounded training samples: every class is thinned by a hash of the id to about the same number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thin(rows: DataFrame, label: str, key: Column, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label value (all of them where there are fewer), the same ones in every run;
    and how many rows each label has in all.

    The label must have few distinct values; only their counts reach the driver. Rows are chosen by a hash of the key,
    so no task holds a whole class.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect() if r[0] is not None}
    if not counts:
        return rows.where(F.lit(False)), counts
    share = F.coalesce(*[F.when(F.col(label) == F.lit(v), F.lit(min(1.0, per_class / n))) for v, n in counts.items()])
    position = F.pmod(F.xxhash64(key.cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rows.where(F.col(label).isNotNull() & (position < share)), counts
