"""Session helpers: lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="authwatch-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_stored: list[str] = []


def stored_so_far() -> int:
    """A mark for ``discard``."""
    return len(_stored)


def discard(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Delete what ``cut_lineage`` stored since the mark, but for the last ``keep`` tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _stored[mark:len(_stored) - keep]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    del _stored[mark:len(_stored) - keep]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store an intermediate result as a table in the shared folder and read it back.

    It is computed once, survives lost executors, and later passes prune its columns.
    """
    path = f"{shared_folder(df.sparkSession)}/authwatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a generated method up to which the JVM compiles it.
COMPILED_METHOD = 8000


def compile_wide_rows(spark: SparkSession) -> None:
    """Let Spark split the generated code of wide rows; one method beyond the JVM's limit would stay interpreted for every row."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD)


def keep_dealt(spark: SparkSession) -> None:
    """Let Spark join tables where they lie if both are dealt out by some of the join's keys, instead of dealing them out by all."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", False)


def utc(spark: SparkSession) -> SparkSession:
    """Calendar and timestamp semantics are UTC throughout."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
