"""CSV and JSON-lines ingestion: header scan, normalisation, pseudonyms, quarantine."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AuthwatchError
from ..functions.privacy import DOMAINS, MAX_DEPTH, prohibited, pseudonymise
from ..plans.validate import event_checks
from ..schema import AUTH_EVENTS, GROUND_TRUTH_COLUMNS

# Cell texts read as null, after trimming and lower-casing.
NULL_TOKENS = ("", "none", "null", "na", "n/a")
_BAD = ("error_code", "error_field")


_LOCATOR = ("source_file", "row_number")
# What a quarantine record says; never a value of the row.
_MESSAGES = {
    "I002": "a field is missing, malformed or out of range",
    "I003": "an identifier is missing, so no pseudonym can be made",
    "I005": "the line is not a record",
}


class Ingested:
    """``accepted`` has the event schema; ``quarantined`` says where a bad row stands and why, without its content."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.accepted = rows.where("error_code IS NULL").select(*AUTH_EVENTS.names)
        text = F.coalesce(*[F.when(F.col("error_code") == c, m) for c, m in _MESSAGES.items()])
        self.quarantined = rows.where("error_code IS NOT NULL").select(*_LOCATOR, *_BAD, text.alias("message"))

    def counts(self):
        return self.rows.agg(
            F.count("*").alias("total"), F.count_if(F.col("error_code").isNull()).alias("accepted")).first()

    def enforce(self, policy: str = "quarantine") -> "Ingested":
        """``fail`` raises on the first bad row; both policies refuse an empty result."""
        if policy == "fail":
            first = self.quarantined.limit(1).collect()
            if first:
                raise AuthwatchError(f"{first[0].error_code}: row rejected on {first[0].error_field}")
        counts = self.counts()
        if counts.total == 0:
            raise AuthwatchError("E001: no rows")
        if counts.accepted == 0:
            raise AuthwatchError("E002: every row was quarantined")
        return self


def normalise_header(name: str) -> str:
    return re.sub(r"[-\s]+", "_", name.strip().lower())


def _scan(names, extra: dict[str, str] | None) -> dict[str, str]:
    """Original column -> canonical name; refuses the whole input on a prohibited name."""
    found = prohibited(names)
    if found:
        raise AuthwatchError(f"input rejected: {len(found)} sensitive field name(s)")
    mapping = {}
    for name in names:
        canonical = normalise_header(name)
        canonical = (extra or {}).get(canonical, (extra or {}).get(name, canonical))
        mapping[name] = canonical
    leaked = sorted(set(mapping.values()) & set(GROUND_TRUTH_COLUMNS))
    if leaked:
        raise AuthwatchError(f"input rejected: ground-truth column(s) {leaked}")
    return mapping


def _shape(rows: DataFrame, key: bytes | None) -> Ingested:
    """Typed events plus error columns, from all-string columns, the locator and ``parse_error``."""
    present = set(rows.columns)
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    texts = {
        f.name: (f"CASE WHEN lower(trim(`{f.name}`)) IN ({tokens}) THEN NULL ELSE trim(`{f.name}`) END"
                 if f.name in present else "cast(null as string)")
        for f in AUTH_EVENTS.fields
    }
    rows = rows.selectExpr(*_LOCATOR, "parse_error", *[f"{e} AS {n}" for n, e in texts.items()])
    raw_missing = " OR ".join(f"{c} IS NULL" for c in DOMAINS)
    rows = rows.withColumn("pseudonym_error", F.expr(raw_missing))
    if key is not None:
        rows = pseudonymise(rows, key)
    typed, failed = [], []
    for field in AUTH_EVENTS.fields:
        n, t = field.name, field.dataType.simpleString()
        if t == "string":
            continue
        typed.append(n)
        failed.append(f"CASE WHEN {n} IS NOT NULL AND try_cast({n} AS {t}) IS NULL THEN '{n}' END")
    # A naive time stamp has no zone and is refused.
    failed.append(r"CASE WHEN event_time IS NOT NULL AND NOT event_time RLIKE '(Z|[+-][0-9]{2}:?[0-9]{2})$' "
                  "THEN 'event_time' END")
    rows = rows.withColumn("cast_error", F.expr(f"coalesce({', '.join(failed)})"))
    rows = rows.withColumns({
        n: F.expr(f"try_cast({n} AS {AUTH_EVENTS[n].dataType.simpleString()})") for n in typed})
    required = [f"CASE WHEN {f.name} IS NULL THEN '{f.name}' END" for f in AUTH_EVENTS.fields if not f.nullable]
    invalid = [f"CASE WHEN {cond} THEN '{field}' END" for (_, field), cond in event_checks(AUTH_EVENTS.names).items()]
    uuid = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"
    invalid.append(f"CASE WHEN NOT (event_id RLIKE {uuid}) THEN 'event_id' END")
    schema_field = f"coalesce(cast_error, {', '.join(required + invalid)})"
    rows = rows.withColumn("schema_error", F.expr(schema_field))
    rows = rows.selectExpr(
        "*",
        "CASE WHEN parse_error THEN 'I005' WHEN pseudonym_error THEN 'I003' "
        "WHEN schema_error IS NOT NULL THEN 'I002' END AS error_code",
        f"CASE WHEN parse_error THEN NULL WHEN pseudonym_error THEN coalesce("
        f"{', '.join(f'''CASE WHEN {c} IS NULL THEN '{c}' END''' for c in DOMAINS)}) "
        "ELSE schema_error END AS error_field")
    return Ingested(rows.select(*_LOCATOR, *_BAD, *AUTH_EVENTS.names))


def located_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_file, row_number): every line of every file, numbered from 1 within its file.

    Numbers come from the place in a block plus the lines of the file's earlier blocks, which are one small row each.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"))
    blocks = lines.groupBy("source_file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return lines.join(blocks, ["source_file", "block"]).select(
        "value", "source_file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("row_number"))


def _csv_cells(value: str, width: int) -> Column:
    struct = F.from_csv(F.col(value), ", ".join(f"c{i} string" for i in range(width)))
    return F.array(*[struct[f"c{i}"] for i in range(width)])


def ingest_csv(
    spark: SparkSession, path: str, key: bytes | None = None, extra_field_map: dict[str, str] | None = None
) -> Ingested:
    """Each file is read by its own first line; a bad header in any of them refuses the whole input.

    One record is one line. A column that a file lacks is null in its rows; of two columns with one canonical name the
    first counts.
    """
    lines = located_lines(spark, path)
    # one row for each wording of the header, however many files share it
    headers = [r.value for r in lines.where("row_number = 1").select("value").distinct().orderBy("value").collect()]
    if not headers:
        raise AuthwatchError("E001: no rows")
    mappings = []
    for header in headers:
        names = next(csv.reader([header.removeprefix("\ufeff")]))
        mapping = _scan(names, extra_field_map)
        mappings.append([mapping[n] for n in names])
    heads = lines.where("row_number = 1").select("source_file", F.col("value").alias("header"))
    width = max(map(len, mappings))
    rows = lines.where("row_number > 1 AND trim(value) != ''").join(heads, "source_file").withColumn(
        "cells", _csv_cells("value", width))
    columns = []
    for name in AUTH_EVENTS.names:
        at = [F.when(F.col("header") == h, F.col("cells")[m.index(name)]) for h, m in zip(headers, mappings) if name in m]
        if at:
            columns.append(F.coalesce(*at).alias(name))
    return _shape(rows.select(*_LOCATOR, F.lit(False).alias("parse_error"), *columns), key)


def _walk(schema: T.DataType, depth: int = 0):
    if isinstance(schema, T.StructType):
        if depth > MAX_DEPTH:
            raise AuthwatchError(f"input rejected: nesting deeper than {MAX_DEPTH}")
        for field in schema.fields:
            yield field.name
            yield from _walk(field.dataType, depth + 1)
    elif isinstance(schema, T.ArrayType):
        yield from _walk(schema.elementType, depth)


def scan_json_keys(lines: DataFrame) -> list[str]:
    """All key names of a JSON text column, merged by one distributed aggregate."""
    text = lines.agg(F.expr("schema_of_variant_agg(try_parse_json(value))").alias("s")).first().s
    if text is None or "OBJECT" not in text:
        return []
    # Variant schemas say OBJECT where SQL types say STRUCT; VOID marks null values.
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", text)
    schema = T._parse_datatype_string(ddl)
    top = [f.name for f in schema.fields] if isinstance(schema, T.StructType) else []
    return [*dict.fromkeys([*top, *_walk(schema)])]


def ingest_jsonl(
    spark: SparkSession, path: str, key: bytes | None = None, extra_field_map: dict[str, str] | None = None
) -> Ingested:
    lines = located_lines(spark, path).where("trim(value) != ''")
    parsed = lines.selectExpr(*_LOCATOR, "value", "try_parse_json(value) AS v")
    names = scan_json_keys(lines)
    found = prohibited(names)
    if found:
        raise AuthwatchError(f"input rejected: {len(found)} sensitive field name(s)")
    _scan(names, extra_field_map)
    top = [r.k for r in lines.select(F.explode(F.json_object_keys("value")).alias("k")).distinct().collect()]
    mapping = _scan(sorted(top), extra_field_map)
    fields = []
    for name, canonical in mapping.items():
        if canonical in AUTH_EVENTS.names:
            quoted = name.replace("'", "\\'")
            fields.append(f"""try_variant_get(v, "$['{quoted}']", 'string') AS `{canonical}`""")
    rows = parsed.selectExpr(
        *_LOCATOR,
        "v IS NULL OR coalesce(schema_of_variant(v), '') NOT LIKE 'OBJECT%' AS parse_error", *fields)
    return _shape(rows, key)
