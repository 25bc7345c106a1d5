"""Running aggregates and neighbour lookups that never hold a whole key in one task.

Every function works on rows already tagged with a time chunk.  Inside a chunk
a plain Spark window does the work; between chunks one small table with a row
per (key, chunk) carries the state forward.  The carry table is the only thing
ordered per key and has at most (time range / chunk length) rows per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket

CHUNK = "__chunk"
#: True where the row's key has too many rows to stay in one chunk.
LONG = "__long"


def with_chunk(df: DataFrame, time: str, width_us: int) -> DataFrame:
    """Tag rows with their time chunk; where a column ``LONG`` says that a key is short, the key is a single chunk."""
    chunk = bucket(F.col(time), width_us)
    return df.withColumn(CHUNK, F.when(F.col(LONG), chunk).otherwise(F.lit(0)) if LONG in df.columns else chunk)


def running(
    df: DataFrame,
    keys: list[str],
    time: str,
    measures: dict[str, tuple[str, str]],
    tie_break: str | None = None,
) -> DataFrame:
    """Add running aggregates of ``measures`` = {name: (sum|max|min, SQL expression)}.

    Without ``tie_break`` a row sees only rows with a strictly smaller time.
    With it, rows are totally ordered by (time, tie_break) and a row sees itself.
    """
    group = ", ".join([*keys, CHUNK])
    if tie_break is None:
        frame = f"ORDER BY {time} RANGE BETWEEN UNBOUNDED PRECEDING AND 1L PRECEDING"
    else:
        frame = f"ORDER BY {time}, {tie_break} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    rows = df.selectExpr("*", *[f"{expr} AS __in_{n}" for n, (_, expr) in measures.items()])
    # State at the start of each chunk: the aggregate over all earlier chunks of the key.
    totals = rows.groupBy(*keys, CHUNK).agg(
        *[F.expr(f"{op}(__in_{n})").alias(n) for n, (op, _) in measures.items()])
    earlier = (f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {CHUNK} "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    carried = totals.selectExpr(
        *keys, CHUNK, *[f"{op}({n}) {earlier} AS __carry_{n}" for n, (op, _) in measures.items()])
    local = rows.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"{op}(__in_{n}) OVER (PARTITION BY {group} {frame}) AS __local_{n}"
          for n, (op, _) in measures.items()])
    joined = local.join(carried, [*keys, CHUNK], "left")
    combine = {
        "sum": "coalesce(__local_{n}, 0L) + coalesce(__carry_{n}, 0L)",
        "max": "greatest(__local_{n}, __carry_{n})",
        "min": "least(__local_{n}, __carry_{n})",
    }
    return joined.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"{combine[op].format(n=n)} AS {n}" for n, (op, _) in measures.items()])


def neighbour(df: DataFrame, keys: list[str], time: str, name: str, forward: bool) -> DataFrame:
    """Add the time of the next (or previous) row of the key; ties are neighbours with equal time."""
    edge, direction = ("min", "ASC") if forward else ("max", "DESC")
    by_key, by_chunk = ", ".join(keys), ", ".join([*keys, CHUNK])
    edges = df.groupBy(*keys, CHUNK).agg(F.expr(f"{edge}({time})").alias("__edge")).selectExpr(
        *keys, CHUNK,
        f"lead(__edge) OVER (PARTITION BY {by_key} ORDER BY {CHUNK} {direction}) AS __across")
    inside = f"lead({time}) OVER (PARTITION BY {by_chunk} ORDER BY {time} {direction}) AS __inside"
    return (
        df.selectExpr("*", inside)
        .join(edges, [*keys, CHUNK], "left")
        .select(*df.columns, F.coalesce("__inside", "__across").alias(name))
    )


def neighbours(df: DataFrame, keys: list[str], time: str, before: str, after: str) -> DataFrame:
    """Add the times of the previous and the next row of the key, as two calls of ``neighbour`` would, in one pass."""
    by_key, by_chunk = ", ".join(keys), ", ".join([*keys, CHUNK])
    across = f"OVER (PARTITION BY {by_key} ORDER BY {CHUNK})"
    inside = f"OVER (PARTITION BY {by_chunk} ORDER BY {time})"
    edges = df.groupBy(*keys, CHUNK).agg(F.min(time).alias("__first"), F.max(time).alias("__last")).selectExpr(
        *keys, CHUNK, f"lag(__last) {across} AS __back", f"lead(__first) {across} AS __on")
    return (
        df.selectExpr("*", f"lag({time}) {inside} AS __lag", f"lead({time}) {inside} AS __lead")
        .join(edges, [*keys, CHUNK], "left")
        .select(*df.columns, F.coalesce("__lag", "__back").alias(before), F.coalesce("__lead", "__on").alias(after))
    )
