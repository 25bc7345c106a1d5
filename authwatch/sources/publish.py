"""Typed reads and all-or-nothing publication of result tables."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AuthwatchError
from ..plans.fingerprint import fingerprint
from ..schema import (
    AUTH_EVENTS, ENTITY_SCOPE, FEATURE_LABELS, FEATURE_SPLITS, GROUND_TRUTH, RISK_ASSESSMENTS,
    RULE_DETECTIONS, SCHEMA_VERSION, SECURITY_ALERTS,
)

TABLES = {
    "auth_events": AUTH_EVENTS, "ground_truth": GROUND_TRUTH, "feature_labels": FEATURE_LABELS,
    "feature_splits": FEATURE_SPLITS, "entity_scope": ENTITY_SCOPE, "rule_detections": RULE_DETECTIONS,
    "risk_assessments": RISK_ASSESSMENTS, "security_alerts": SECURITY_ALERTS,
}


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType))


def to_storage(df: DataFrame) -> DataFrame:
    """Nested columns become ``*_json`` text, as stored tables have no nested types."""
    return df.select(*[
        F.to_json(f.name).alias(f"{f.name}_json") if _is_nested(f.dataType) else F.col(f.name)
        for f in df.schema.fields])


def from_storage(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[
        F.from_json(f"{f.name}_json", f.dataType).alias(f.name) if _is_nested(f.dataType) else F.col(f.name)
        for f in schema.fields])


def ordered(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Canonical column order; missing or undeclared columns raise."""
    if set(df.columns) != set(schema.names):
        raise AuthwatchError(f"columns differ from the declared ones: {sorted(set(df.columns) ^ set(schema.names))}")
    return df.select(*schema.names)


def require_not_null(df: DataFrame, schema: T.StructType) -> None:
    """Parquet columns are written nullable, so declared non-null ones are checked in what was stored."""
    names = [f.name for f in schema.fields if not f.nullable]
    row = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    bad = [n for n in names if row[n]]
    if bad:
        raise AuthwatchError(f"nulls in required columns: {bad}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table in its declared types."""
    return _read_typed(spark, path, TABLES[name])


def _read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    stored = T.StructType([
        T.StructField(f"{f.name}_json", T.StringType()) if _is_nested(f.dataType) else T.StructField(f.name, f.dataType)
        for f in schema.fields])
    return from_storage(spark.read.schema(stored).parquet(path), schema)


def write_jsonl(events: DataFrame, path: str) -> None:
    events.write.mode("errorifexists").json(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _move_new(spark: SparkSession, source, target) -> None:
    """Give the file its final name; unlike a plain rename, never in place of another file."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(source, target, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise AuthwatchError("another run published first") from None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], extra: dict | None = None) -> str:
    """Write all tables under a fresh run folder; the manifest, written last, is the commit.

    A failure before the manifest leaves nothing a reader would see, and of two runs at one place the later is refused. The
    manifest keeps each table's declared schema, so that tables whose columns are chosen by settings are read typed too.
    """
    fs, manifest_path = _files(spark, f"{root}/manifest.json")
    if fs.exists(manifest_path):
        raise AuthwatchError("a published manifest exists already; publish to a new location")
    run = f"run_id={uuid.uuid4().hex}"
    entries = {}
    for name, df in tables.items():
        schema = TABLES.get(name)
        if schema is not None:
            df = ordered(df, schema)
        path = f"{root}/{run}/{name}"
        to_storage(df).write.mode("errorifexists").parquet(path)
        # Counts and digests describe what was stored, so they are taken from there.
        stored = spark.read.parquet(path)
        if schema is not None:
            require_not_null(read_table(spark, path, name), schema)
        digest = fingerprint(stored).first()
        entries[name] = {"path": f"{run}/{name}", "rows": digest.row_count, "digest": digest.digest,
                         "columns": stored.columns, "types": dict(stored.dtypes), "schema": (schema or df.schema).jsonValue()}
    body = json.dumps({"schema_version": SCHEMA_VERSION, "tables": entries, **(extra or {})}, sort_keys=True)
    jvm = spark.sparkContext._jvm
    staged = jvm.org.apache.hadoop.fs.Path(f"{root}/{run}/manifest.tmp")
    stream = fs.create(staged)
    stream.write(body.encode())
    stream.close()
    _move_new(spark, staged, manifest_path)
    return f"{root}/{run}"


def read_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(f"{root}/manifest.json").first().value)


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    entry = read_manifest(spark, root)["tables"][name]
    return _read_typed(spark, f"{root}/{entry['path']}", TABLES.get(name) or T.StructType.fromJson(entry["schema"]))


def verify_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(table, field, matches): stored row counts, digests, columns and their types against the manifest."""
    rows = []
    for name, entry in read_manifest(spark, root)["tables"].items():
        stored = spark.read.parquet(f"{root}/{entry['path']}")
        now = fingerprint(stored).first()
        rows += [(name, "rows", now.row_count == entry["rows"]), (name, "digest", now.digest == entry["digest"]),
                 (name, "columns", stored.columns == entry["columns"]), (name, "types", dict(stored.dtypes) == entry["types"])]
    return spark.createDataFrame(rows, "table string, field string, matches boolean")
