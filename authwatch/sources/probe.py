"""Unreadable Parquet files: found one by one, reported, and left out of the read.

A scan without columns reads footers only and gives the rows of each file. Files that yield no row are either empty or
unreadable; those alone are opened a second time. Everything is read by Spark's own readers, so any path it knows will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AuthwatchError
from ..runtime import cut_lineage

#: A file without rows is hardly more than its footer; a longer one that yields no row is damaged.
MOST_FOOTER_BYTES = 64 << 20


def _binary(spark: SparkSession, paths: str | list[str], base: str) -> DataFrame:
    """(path, length, content, file) of each file; only the columns that are selected are read."""
    return spark.read.format("binaryFile").option("basePath", base).load(paths).withColumn("file", F.col("_metadata.file_path"))


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Problem of each file without rows, or null where it is a sound and empty Parquet file."""
    for batch in batches:
        problems = []
        for content in batch["content"]:
            try:
                rows = pq.ParquetFile(pa.BufferReader(content)).metadata.num_rows
                problems.append("damaged" if rows else None)
            except (pa.ArrowException, OSError):
                problems.append("no_parquet")
        yield pd.DataFrame({"file": batch["file"], "problem": problems})


def probe_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file under ``path``: (path, file, length, row_count, problem).

    ``problem`` is null for files that can be read, ``no_parquet`` for files whose start, end or footer is none of a
    Parquet file (files of no bytes too), ``damaged`` for others that yield no row although they should. Damage behind
    a sound footer is not looked for. A folder without files gives no row.

    The paths of files pass the driver, which holds the list of all files for any read. No scan visits a file of no
    bytes, so that list is where those come from.
    """
    binary = _binary(spark, path, path)
    # an empty authority is written as :/// here and as :/ elsewhere
    files = spark.createDataFrame([(re.sub("^([^/:]+):///", r"\1:/", f),) for f in binary.inputFiles()], "file string").join(
        binary.select("path", "file", "length"), "file", "left")
    counts = spark.read.schema("nothing int").option("ignoreCorruptFiles", True).option("basePath", path).parquet(path).groupBy(
        F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("row_count"))
    found = cut_lineage(files.join(counts, "file", "left").selectExpr(
        "coalesce(path, file) AS path", "file", "coalesce(length, 0L) AS length", "row_count"))
    suspects = [r.path for r in found.where("row_count IS NULL AND length > 0").select("path").collect()]
    if not suspects:
        return found.selectExpr("path", "file", "length", "coalesce(row_count, 0L) AS row_count",
                                "CASE WHEN length = 0 THEN 'no_parquet' END AS problem")
    small = _binary(spark, suspects, path).where(f"length <= {MOST_FOOTER_BYTES}").select("file", "content")
    judged = small.mapInPandas(_judge, "file string, problem string")
    out = found.join(judged.withColumn("judged", F.lit(True)), "file", "left").selectExpr(
        "path", "file", "length", "coalesce(row_count, 0L) AS row_count",
        "CASE WHEN length = 0 THEN 'no_parquet' WHEN row_count IS NULL AND judged IS NULL THEN 'damaged' ELSE problem END AS problem")
    return cut_lineage(out)


def file_findings(probed: DataFrame, code: str = "V001") -> DataFrame:
    """One finding (code, field, level, violations) for each unreadable file, its path as the field.

    Fixed values: V001 for event tables, F001 for feature tables.
    """
    return probed.where("problem IS NOT NULL").select(
        F.lit(code).alias("code"), F.col("path").alias("field"), F.lit("error").alias("level"), F.lit(1).cast("long").alias("violations"))


def read_sound(spark: SparkSession, path: str, probed: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of all files that the probe could read, partition columns included."""
    sound = [r.path for r in probed.where("problem IS NULL").select("path").collect()]
    if not sound:
        raise AuthwatchError(f"V001: no readable file in {path}")
    return spark.read.schema(schema).option("basePath", path).parquet(*sound)
