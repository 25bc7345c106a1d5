"""Artifact validators: every check of a table is one expression of one wide aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DetectionConfig, FeatureConfig, config_fingerprint
from ..functions.scalar import micros_of, uuid5
from ..operators.extremes import interval_extremes
from ..schema import (
    AUTH_METHODS, AUTH_OUTCOMES, BLOCKED_REASONS, CLIENT_TYPES, FAILURE_REASONS, GROUND_TRUTH_COLUMNS,
    MFA_OUTCOMES, PROHIBITED_FEATURE_COLUMNS, RISK_ASSESSMENTS, RULE_DETECTIONS, SCHEMA_VERSION,
    SECURITY_ALERTS, SPARK_TYPES, feature_catalog,
)
from .alerts import rule_agreement
from .rules import CATEGORY_GROUP, META, RULE_IDS, RULE_VERSION
from .scoring import severity_rank

FINDINGS = "code string, field string, level string, violations bigint"
# Format of pseudonymous identifiers and the columns every event table must have.
PSEUDONYM = "^(u|s|d|sess):[0-9a-f]{32}$"
ID_COLUMNS = ("user_id", "source_id", "device_id", "session_id")
REQUIRED_EVENT_COLUMNS = (
    "schema_version", "event_id", "event_time", "user_id", "source_id", "device_id", "session_id",
    "application_id", "authentication_method", "authentication_outcome",
)
NULL_RATE_WARNING = 0.5
MEAN_TOLERANCE = 1e-3  # fixed value: published means are rounded


def _in(column: str, values, nullable: bool) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"({column} IS NOT NULL AND {column} NOT IN ({listed}))" + ("" if nullable else f" OR {column} IS NULL")


def event_checks(columns: list[str], pseudonym: str = PSEUDONYM) -> dict[tuple[str, str], str]:
    """(code, field) -> SQL condition that is true for a bad row."""
    reasons = ", ".join(f"'{r}'" for r in BLOCKED_REASONS)
    o, r = "authentication_outcome", "failure_reason"
    checks = {
        ("V004", "schema_version"): f"schema_version IS NULL OR schema_version != '{SCHEMA_VERSION}'",
        ("V008", "authentication_method"): _in("authentication_method", AUTH_METHODS, False),
        ("V009", o): _in(o, AUTH_OUTCOMES, False),
        ("V010", r): _in(r, FAILURE_REASONS, True),
        ("V011", "mfa_outcome"): _in("mfa_outcome", MFA_OUTCOMES, True),
        ("V012", "client_type"): _in("client_type", CLIENT_TYPES, True),
        ("V013", "country_code"): "NOT (country_code RLIKE '^[A-Z]{2}$')",
        ("V014", "coarse_latitude"): "NOT (coarse_latitude BETWEEN -90 AND 90)",
        ("V015", "coarse_longitude"): "NOT (coarse_longitude BETWEEN -180 AND 180)",
        ("V016", "response_time_ms"): "NOT (response_time_ms BETWEEN 0 AND 30000)",
        ("V017", r): (
            f"({o} = 'success' AND {r} IS NOT NULL) OR ({o} = 'failure' AND {r} IS NULL) "
            f"OR ({o} = 'blocked' AND ({r} IS NULL OR {r} NOT IN ({reasons}))) "
            f"OR ({o} = 'challenged' AND {r} IS NOT NULL)"),
        ("V018", "mfa_outcome"): f"mfa_outcome = 'bypassed' AND {o} NOT IN ('success', 'failure')",
        **{("V019", c): f"NOT coalesce({c} RLIKE '{pseudonym}', false)" for c in ID_COLUMNS},
    }
    needs = {("V017", r): {o, r}, ("V018", "mfa_outcome"): {o, "mfa_outcome"}}
    return {k: f"coalesce({v}, false)" for k, v in checks.items() if needs.get(k, {k[1]}) <= set(columns)}


def _sum_checks(df: DataFrame, checks: dict) -> DataFrame:
    """One scan: (code, field, level, violations) per check, zeros included."""
    keys = list(checks)
    sums = df.agg(*[F.expr(f"count_if({checks[k]})").alias(f"c{i}") for i, k in enumerate(keys)])
    entries = ", ".join(f"'{code}', '{field}', 'error', c{i}" for i, (code, field) in enumerate(keys))
    return sums.selectExpr(f"stack({len(keys)}, {entries}) AS (code, field, level, violations)")


def validate_events(events: DataFrame, pseudonym: str = PSEUDONYM) -> DataFrame:
    """Findings of the event validator as (code, field, level, violations), zeros included."""
    columns = events.columns
    spark = events.sparkSession
    fixed = [("V003", c, "error", 1) for c in REQUIRED_EVENT_COLUMNS if c not in columns]
    fixed += [("V005", c, "error", 1) for c in GROUND_TRUTH_COLUMNS if c in columns]
    if "event_time" in columns and not isinstance(events.schema["event_time"].dataType, T.TimestampType):
        fixed.append(("V007", "event_time", "error", 1))
    out = _sum_checks(events, event_checks(columns, pseudonym))
    out = out.unionByName(events.agg(F.count("*").alias("n")).selectExpr(
        "'V002' AS code", "'' AS field", "'error' AS level", "cast(n = 0 as bigint) AS violations"))
    if "event_id" in columns:
        out = out.unionByName(events.groupBy("event_id").count().agg(
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("v")).selectExpr(
            "'V006' AS code", "'event_id' AS field", "'error' AS level", "v AS violations"))
    rates = events.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    entries = ", ".join(f"'V020', '{c}', 'warning', cast(`{c}` > {NULL_RATE_WARNING} as bigint)" for c in columns)
    out = out.unionByName(rates.selectExpr(f"stack({len(columns)}, {entries}) AS (code, field, level, violations)"))
    if fixed:
        out = out.unionByName(spark.createDataFrame(fixed, FINDINGS))
    return out.withColumn("violations", F.coalesce(F.col("violations"), F.lit(0)).cast("long"))


def accepted_rejected(events: DataFrame, pseudonym: str = PSEUDONYM) -> DataFrame:
    """One row (accepted, rejected): a row is rejected by any failed check or as a repeat of an id."""
    tainted = any(c in events.columns for c in GROUND_TRUTH_COLUMNS)
    bad = " OR ".join(event_checks(events.columns, pseudonym).values())
    order = F.struct("event_time", F.xxhash64(*events.columns).alias("tie"))
    flagged = events.select("event_id", F.expr(f"({bad}) OR {str(tainted).lower()} AS bad"), order.alias("place"))
    # The first row of an id (by time, then by a hash of the row) is kept; all but it are repeats.
    groups = flagged.groupBy("event_id").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("b"), F.min_by("bad", "place").alias("first_bad"))
    repeats = "CASE WHEN n > 1 THEN n - 1 + cast(first_bad as int) ELSE b END"
    return groups.agg(
        F.coalesce(F.sum(F.expr(f"n - ({repeats})")), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(F.expr(repeats)), F.lit(0)).alias("rejected"))


def status(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.coalesce(F.sum(F.when(F.col("level") == "error", F.col("violations"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("level") == "warning", F.col("violations"))), F.lit(0)).alias("warnings"),
    ).selectExpr("errors", "warnings",
                 "CASE WHEN errors > 0 THEN 'INVALID' WHEN warnings > 0 THEN 'WARNING' ELSE 'VALID' END AS status")


def validate_features(
    snapshot: DataFrame, config: FeatureConfig, labels: DataFrame | None = None,
    splits: DataFrame | None = None, null_warning: float = 0.95,
) -> DataFrame:
    """Feature-table findings; data checks share one scan."""
    catalog = feature_catalog(config)
    names = [f.name for f in catalog]
    columns = snapshot.columns
    fixed = [("F003", c, "error", 1) for c in names if c not in columns]
    fixed += [("F003", c, "error", 1) for c in columns if c not in names]
    if sorted(columns) == sorted(names) and columns != names:
        fixed.append(("F004", "", "error", 1))
    fixed += [("F006", c, "error", 1) for c in columns if c in PROHIBITED_FEATURE_COLUMNS]
    known = [f for f in catalog if f.name in columns]
    for f in known:
        dtype = snapshot.schema[f.name].dataType
        if dtype != SPARK_TYPES[f.dtype]:
            fixed.append(("F008" if f.name == "anchor_event_time" else "F009", f.name, "error", 1))
    checks: dict[tuple[str, str], str] = {}
    for f in known:
        n = f.name
        if n == "feature_schema_version":
            checks["F005", n] = f"coalesce({n} != '{SCHEMA_VERSION}', true)"
        if not f.nullable:
            checks["F010", n] = f"{n} IS NULL"
        if f.dtype == "float64":
            checks["F011", n] = f"abs({n}) = double('Infinity')"
            checks["F012", n] = f"isnan({n})"
        if f.aggregate in ("count", "unique"):
            checks["F013", n] = f"{n} < 0"
        if f.aggregate == "delta" and n.startswith("seconds"):
            checks["F016", n] = f"{n} < 0"
        if f.value_range is not None and f.dtype in ("float64", "int64"):
            lo, hi = f.value_range
            upper = "" if hi == float("inf") else f" OR {n} > {hi}D"
            # A NaN is F012 alone; Spark orders it above every number.
            guard = f"NOT isnan({n}) AND " if f.dtype == "float64" else ""
            checks["F017", n] = f"{guard}({n} < {lo}D{upper})"
    out = _sum_checks(snapshot, checks)
    out = out.unionByName(snapshot.groupBy("anchor_event_id").count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("v"), F.count("*").alias("n")).selectExpr(
        "stack(2, 'F007', 'anchor_event_id', 'error', v, 'F002', '', 'error', cast(n = 0 as bigint)) "
        "AS (code, field, level, violations)"))
    stats = snapshot.agg(*[F.expr(e) for i, f in enumerate(known) for e in (
        f"avg(cast({f.name} IS NULL as double)) AS n{i}", f"min({f.name}) AS lo{i}", f"max({f.name}) AS hi{i}")])
    entries = ", ".join(
        f"'F022', '{f.name}', 'warning', cast(n{i} > {null_warning} as bigint), "
        f"'F023', '{f.name}', 'warning', cast(coalesce(lo{i} = hi{i}, false) as bigint)"
        for i, f in enumerate(known) if f.group != "key")
    pairs = 2 * sum(f.group != "key" for f in known)
    out = out.unionByName(stats.selectExpr(f"stack({pairs}, {entries}) AS (code, field, level, violations)"))
    for code, other in (("F018", labels), ("F019", splits)):
        if other is not None:
            sides = snapshot.select(F.col("anchor_event_id").alias("event_id"), F.lit(1).alias("a")).join(
                other.select("event_id", F.lit(1).alias("b")), "event_id", "full_outer")
            out = out.unionByName(sides.agg(F.count_if(F.expr("a IS NULL OR b IS NULL")).alias("v")).selectExpr(
                f"'{code}' AS code", "'event_id' AS field", "'error' AS level", "v AS violations"))
    if fixed:
        out = out.unionByName(snapshot.sparkSession.createDataFrame(fixed, FINDINGS))
    return out


def validate_detection(
    detections: DataFrame, assessments: DataFrame, alerts: DataFrame, config: DetectionConfig | None = None,
    scope: DataFrame | None = None, insufficient_warning: float = 0.95,
) -> DataFrame:
    """Findings over the three detection tables and their relationships."""
    config = config or DetectionConfig()
    fixed = []
    for df, schema in ((detections, RULE_DETECTIONS), (assessments, RISK_ASSESSMENTS), (alerts, SECURITY_ALERTS)):
        if df.columns != schema.names:
            fixed.append(("D002", "", "error", 1))
        fixed += [("D003", c, "error", 1) for c in df.columns if c in PROHIBITED_FEATURE_COLUMNS and c != "risk_score"]
        fixed += [("D012", f.name, "error", 1) for f in schema.fields
                  if isinstance(f.dataType, T.TimestampType) and f.name in df.columns
                  and not isinstance(df.schema[f.name].dataType, T.TimestampType)]
    rule_list = ", ".join(f"'{r}'" for r in RULE_IDS)
    agrees = " OR ".join(
        f"(rule_id = '{r}' AND rule_family = '{f}' AND attack_category = '{c}' AND correlation_group = '{g}')"
        for r, (f, c, g, _) in META.items())
    named = detections.withColumn("expected_id", uuid5(config.id_namespace, F.concat_ws(
        "|", "anchor_event_id", "rule_id", "rule_version")))
    out = _sum_checks(named, {
        ("D004", "rule_detections"): f"detection_schema_version != '{SCHEMA_VERSION}'",
        ("D006", "detection_id"): "detection_id != expected_id",
        ("D007", "rule_id"): f"rule_id NOT IN ({rule_list})",
        ("D008", "rule_version"): f"rule_version != '{RULE_VERSION}'",
        ("D009", "rule_id"): f"NOT ({agrees})",
        ("D010", "signal_strength"): "NOT isnan(signal_strength) AND NOT (signal_strength BETWEEN 0 AND 1)",
        ("D011", "signal_strength"): "isnan(signal_strength) OR abs(signal_strength) = double('Infinity')",
        ("D013", "evidence"): "size(evidence) = 0 OR size(reason_codes) = 0",
    })
    categories = ", ".join(f"'{c}'" for c in CATEGORY_GROUP)
    floor = config.scoring.min_fired_risk_score
    out = out.unionByName(_sum_checks(assessments, {
        ("D004", "risk_assessments"): f"detection_schema_version != '{SCHEMA_VERSION}'",
        ("D011", "risk_score"): "isnan(risk_score) OR abs(risk_score) = double('Infinity')",
        ("D015", "risk_score"): "NOT isnan(risk_score) AND NOT (risk_score BETWEEN 0 AND 100)",
        ("D016", "fired_rule_count"): "fired_rule_count != size(fired_rule_ids)",
        ("D017", "risk_score"): "(risk_score = 0) != (fired_rule_count = 0)",
        ("D018", "primary_attack_category"): (
            f"fired_rule_count > 0 AND coalesce(primary_attack_category NOT IN ({categories}) "
            "OR NOT array_contains(contributing_categories, primary_attack_category), true)"),
        ("D019", "risk_score"): f"fired_rule_count > 0 AND risk_score < {float(floor)}D",
        ("D020", "configuration_fingerprint"): f"configuration_fingerprint != '{config_fingerprint(config)}'",
        ("D032", "scoring_version"): "scoring_version != '1.0.0'",
    }))
    least = f"{severity_rank('current_severity')} < {severity_rank(repr(config.alerting.min_alert_severity))}"
    out = out.unionByName(_sum_checks(alerts, {
        ("D004", "security_alerts"): f"detection_schema_version != '{SCHEMA_VERSION}'",
        ("D022", "peak_risk_score"): "NOT (peak_risk_score BETWEEN 0 AND 100 AND aggregate_risk_score BETWEEN 0 AND 100)",
        ("D023", "aggregate_risk_score"): "aggregate_risk_score > peak_risk_score",
        ("D024", "peak_risk_score"): f"peak_risk_score < {float(config.alerting.min_alert_risk_score)}D OR {least}",
        ("D025", "scope_value"): "(grouping_mode = 'entity_scoped') != (scope_kind != 'none' AND scope_value IS NOT NULL)",
        ("D026", "first_seen"): "first_seen > last_seen OR contributing_event_count <= 0",
    }))

    def one(df: DataFrame, code: str, field: str, level: str = "error") -> DataFrame:
        return df.agg(F.count("*").alias("v")).selectExpr(
            f"'{code}' AS code", f"'{field}' AS field", f"'{level}' AS level", "v AS violations")

    for code, df, key in (("D005", detections, "detection_id"), ("D014", assessments, "anchor_event_id"),
                          ("D021", alerts, "alert_id")):
        out = out.unionByName(one(df.groupBy(key).count().where("count > 1"), code, key))
    fired_rules = detections.select("rule_id").distinct()
    named_rules = alerts.select(F.explode("contributing_rule_ids").alias("rule_id")).distinct()
    out = out.unionByName(one(named_rules.join(fired_rules, "rule_id", "left_anti"), "D027", "contributing_rule_ids"))
    out = out.unionByName(one(detections.join(assessments, "anchor_event_id", "left_anti"), "D028", "anchor_event_id"))
    out = out.unionByName(one(rule_agreement(assessments, detections), "D029", "fired_rule_ids"))
    out = out.unionByName(one(mean_plausibility(alerts, assessments).where("NOT plausible"), "D031", "aggregate_risk_score"))
    if scope is not None:
        sides = scope.select("anchor_event_id", F.lit(1).alias("s")).join(
            assessments.select("anchor_event_id", F.lit(1).alias("a")), "anchor_event_id", "full_outer")
        out = out.unionByName(one(sides.where("s IS NULL OR a IS NULL"), "D030", "anchor_event_id"))
    spark = detections.sparkSession
    everything = spark.createDataFrame([(r,) for r in RULE_IDS], "rule_id string")
    out = out.unionByName(one(everything.join(fired_rules, "rule_id", "left_anti"), "D050", "rule_id", "warning"))
    out = out.unionByName(alerts.agg(F.count("*").alias("n")).selectExpr(
        "'D051' AS code", "'' AS field", "'warning' AS level", "cast(n = 0 as bigint) AS violations"))
    out = out.unionByName(assessments.agg(F.count("*").alias("n"), F.sum("insufficient_data_count").alias("i")).selectExpr(
        f"stack(2, 'D001', '', 'error', cast(n = 0 as bigint), 'D052', '', 'warning', "
        f"cast(coalesce(i > {insufficient_warning} * {len(RULE_IDS)} * n, false) as bigint)) "
        "AS (code, field, level, violations)"))
    if fixed:
        out = out.unionByName(spark.createDataFrame(fixed, FINDINGS))
    return out


def mean_plausibility(alerts: DataFrame, assessments: DataFrame) -> DataFrame:
    """D031: alerts with the ``least`` and ``greatest`` score of their category inside their time range, and ``plausible``.

    The mean of any members lies between the two. Without an assessment in the range nothing can be said, and the alert passes.
    """
    points = assessments.where("primary_attack_category IS NOT NULL").select(
        F.col("primary_attack_category").alias("attack_category"), micros_of(F.col("anchor_event_time")).alias("us"), "risk_score")
    spans = alerts.select(
        "attack_category", "alert_id", F.col("alert_id").alias("interval_id"), micros_of(F.col("first_seen")).alias("first_us"),
        micros_of(F.col("last_seen")).alias("last_us"), "aggregate_risk_score")
    found = interval_extremes(points, spans, ["attack_category"], "risk_score")
    mean, slack = F.col("aggregate_risk_score"), MEAN_TOLERANCE
    inside = (mean >= F.col("least") - slack) & (mean <= F.col("greatest") + slack)
    return found.select("alert_id", "attack_category", "aggregate_risk_score", "least", "greatest",
                        (F.col("least").isNull() | F.coalesce(inside, F.lit(False))).alias("plausible"))
