"""Table schemas, closed vocabularies and the generated feature catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .config import FeatureConfig

SCHEMA_VERSION = "1.0.0"

# Closed vocabularies of the event and label tables.
AUTH_METHODS = (
    "password", "mfa_totp", "mfa_sms", "mfa_email", "sso", "oauth2",
    "api_key", "certificate", "biometric", "passkey",
)
AUTH_OUTCOMES = ("success", "failure", "blocked", "challenged")
FAILURE_REASONS = (
    "invalid_credentials", "account_locked", "account_disabled", "account_not_found",
    "mfa_failed", "mfa_expired", "token_expired", "ip_blocked", "rate_limited",
    "suspicious_activity", "unknown",
)
BLOCKED_REASONS = (
    "ip_blocked", "rate_limited", "suspicious_activity", "account_locked",
    "account_disabled", "unknown",
)
MFA_OUTCOMES = ("passed", "failed", "bypassed", "not_required", "not_enrolled")
CLIENT_TYPES = (
    "web_browser", "mobile_app", "desktop_app", "api_client", "cli_tool", "bot", "unknown",
)
SCENARIOS = (
    "normal", "brute_force", "password_spraying", "credential_stuffing",
    "distributed_brute_force", "account_takeover_indicator", "impossible_travel",
    "bot_activity", "novel_anomaly_holdout",
)
CAMPAIGN_STAGES = ("setup", "active", "exfil", "cleanup")
SEVERITIES = ("low", "medium", "high", "critical")
SPLITS = ("train", "validation", "test", "novel_anomaly_holdout", "excluded")
SUPERVISED_SPLITS = ("train", "validation", "test")
CORRELATION_GROUPS = (
    "automation_timing", "credential_guessing_single_target", "location_movement",
    "session_anomaly", "source_fanout",
)
# Ground-truth columns that never may enter events or features.
GROUND_TRUTH_COLUMNS = (
    "label", "target", "attack_label", "scenario", "campaign_id", "malicious", "risk_score",
    "attack_probability", "is_attack", "supervised_training_eligible",
)
PROHIBITED_FEATURE_COLUMNS = GROUND_TRUTH_COLUMNS + (
    "split", "exclusion_reason", "campaign_stage", "scenario_variant", "attack_class",
    "model_probability",
)

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in columns])


AUTH_EVENTS = _struct(
    ("schema_version", _S, False),
    ("event_id", _S, False),
    ("event_time", _TS, False),
    ("user_id", _S, False),
    ("source_id", _S, False),
    ("device_id", _S, False),
    ("session_id", _S, False),
    ("application_id", _S, False),
    ("authentication_method", _S, False),
    ("authentication_outcome", _S, False),
    ("failure_reason", _S, True),
    ("mfa_outcome", _S, True),
    ("country_code", _S, True),
    ("region_code", _S, True),
    ("coarse_latitude", _D, True),
    ("coarse_longitude", _D, True),
    ("user_agent_family", _S, True),
    ("operating_system_family", _S, True),
    ("client_type", _S, True),
    ("response_time_ms", _L, True),
)
GROUND_TRUTH = _struct(
    ("event_id", _S, False),
    ("campaign_id", _S, False),
    ("scenario", _S, False),
    ("malicious", _B, False),
    ("supervised_training_eligible", _B, False),
    ("generator_version", _S, False),
    ("scenario_variant", _S, True),
    ("campaign_stage", _S, True),
)
FEATURE_LABELS = _struct(
    ("event_id", _S, False),
    ("attack_class", _S, False),
    ("malicious", _B, False),
    ("supervised_training_eligible", _B, False),
)
FEATURE_SPLITS = _struct(
    ("event_id", _S, False), ("split", _S, False), ("exclusion_reason", _S, True)
)
ENTITY_SCOPE = _struct(
    ("anchor_event_id", _S, False), ("user_scope", _S, True), ("source_scope", _S, True)
)
EVIDENCE = _struct(
    ("evidence_code", _S, False),
    ("feature_name", _S, False),
    ("comparator", _S, False),
    ("observed_value", _S, False),
    ("threshold_value", _S, True),
    ("unit", _S, True),
    ("message", _S, False),
)
RULE_DETECTIONS = _struct(
    ("detection_schema_version", _S, False),
    ("detection_id", _S, False),
    ("anchor_event_id", _S, False),
    ("anchor_event_time", _TS, False),
    ("rule_id", _S, False),
    ("rule_version", _S, False),
    ("rule_family", _S, False),
    ("attack_category", _S, False),
    ("severity", _S, False),
    ("signal_strength", _D, False),
    ("correlation_group", _S, False),
    ("evidence", T.ArrayType(EVIDENCE, False), False),
    ("reason_codes", T.ArrayType(_S, False), False),
)
RISK_ASSESSMENTS = _struct(
    ("detection_schema_version", _S, False),
    ("anchor_event_id", _S, False),
    ("anchor_event_time", _TS, False),
    ("risk_score", _D, False),
    ("severity", _S, False),
    ("primary_attack_category", _S, True),
    ("contributing_categories", T.ArrayType(_S, False), False),
    ("fired_rule_count", _L, False),
    ("fired_rule_ids", T.ArrayType(_S, False), False),
    ("top_evidence", T.ArrayType(EVIDENCE, False), False),
    ("insufficient_data_count", _L, False),
    ("scoring_version", _S, False),
    ("configuration_fingerprint", _S, False),
)
SECURITY_ALERTS = _struct(
    ("detection_schema_version", _S, False),
    ("alert_id", _S, False),
    ("attack_category", _S, False),
    ("correlation_group", _S, False),
    ("grouping_mode", _S, False),
    ("scope_kind", _S, False),
    ("scope_value", _S, True),
    ("first_seen", _TS, False),
    ("last_seen", _TS, False),
    ("contributing_event_count", _L, False),
    ("contributing_rule_ids", T.ArrayType(_S, False), False),
    ("aggregate_risk_score", _D, False),
    ("peak_risk_score", _D, False),
    ("initial_severity", _S, False),
    ("current_severity", _S, False),
    ("escalation_count", _L, False),
    ("suppressed_event_count", _L, False),
)


@dataclass(frozen=True)
class Feature:
    """One column of the snapshot table."""

    name: str
    group: str
    dtype: str  # string | int64 | float64 | bool | timestamp
    nullable: bool
    leakage: str = "prior_only"
    kind: str | None = None  # entity kind for windowed features
    measure: str | None = None
    aggregate: str | None = None  # count | unique | rate | mean | std | cov | delta
    window: str | None = None
    value_range: tuple[float, float] | None = None


INF = float("inf")
SPARK_TYPES = {"string": _S, "int64": _L, "float64": _D, "bool": _B, "timestamp": _TS}

_COUNT, _UNIQUE, _RATE, _MEAN, _STD, _COV = "count", "unique", "rate", "mean", "std", "cov"

# Windowed measures per entity kind, in output order.
MEASURES = {
    "user": (
        ("attempt_count", _COUNT), ("success_count", _COUNT), ("failure_count", _COUNT),
        ("challenge_count", _COUNT), ("blocked_count", _COUNT), ("mfa_failure_count", _COUNT),
        ("failure_rate", _RATE), ("success_rate", _RATE),
        ("unique_source_count", _UNIQUE), ("unique_device_count", _UNIQUE),
        ("unique_country_count", _UNIQUE), ("unique_application_count", _UNIQUE),
        ("unique_auth_method_count", _UNIQUE),
        ("mean_response_time_ms", _MEAN), ("response_time_std_ms", _STD),
        ("mean_interarrival_seconds", _MEAN), ("interarrival_std_seconds", _STD),
    ),
    "source": (
        ("attempt_count", _COUNT), ("success_count", _COUNT), ("failure_count", _COUNT),
        ("failure_rate", _RATE),
        ("unique_user_count", _UNIQUE), ("unique_device_count", _UNIQUE),
        ("unique_country_count", _UNIQUE), ("unique_application_count", _UNIQUE),
        ("unique_user_agent_count", _UNIQUE),
        ("mean_response_time_ms", _MEAN),
        ("mean_interarrival_seconds", _MEAN), ("interarrival_std_seconds", _STD),
        ("interarrival_coefficient_of_variation", _COV),
    ),
    "pair": (
        ("attempt_count", _COUNT), ("success_count", _COUNT), ("failure_count", _COUNT),
        ("failure_rate", _RATE), ("mean_interarrival_seconds", _MEAN),
    ),
    "user_device": (("attempt_count", _COUNT),),
    "session": (("event_count", _COUNT), ("failure_count", _COUNT), ("success_count", _COUNT)),
    "device": (("user_count", _UNIQUE),),
}
ENTITY_KEYS = {
    "user": ("user_id",),
    "source": ("source_id",),
    "pair": ("user_id", "source_id"),
    "user_device": ("user_id", "device_id"),
    "session": ("session_id",),
    "device": ("device_id",),
}
DIMENSION_COLUMNS = {
    "unique_source_count": "source_id",
    "unique_device_count": "device_id",
    "unique_country_count": "country_code",
    "unique_application_count": "application_id",
    "unique_auth_method_count": "authentication_method",
    "unique_user_count": "user_id",
    "unique_user_agent_count": "user_agent_family",
    "user_count": "user_id",
}
_GROUPS = {"user": "user_history", "source": "source_history", "pair": "pair_history"}


def feature_catalog(config: FeatureConfig) -> list[Feature]:
    """All snapshot columns in their fixed order, expanded from the window ladder."""
    context = "current_event_context"
    out = [
        Feature("feature_schema_version", "key", "string", False, "key"),
        Feature("anchor_event_id", "key", "string", False, "key"),
        Feature("anchor_event_time", "key", "timestamp", False, "key"),
    ]
    for name, dtype, nullable in (
        ("current_authentication_outcome", "string", False),
        ("current_authentication_method", "string", False),
        ("current_mfa_outcome", "string", True),
        ("current_client_type", "string", True),
        ("current_response_time_ms", "int64", True),
        ("current_country_code", "string", True),
        ("current_has_device", "bool", False),
        ("current_has_location", "bool", False),
    ):
        bounds = (0.0, 30000.0) if name == "current_response_time_ms" else None
        out.append(Feature(name, "current_context", dtype, nullable, context, value_range=bounds))
    for name, dtype, bounds in (
        ("hour_of_day", "int64", (0.0, 23.0)),
        ("day_of_week", "int64", (0.0, 6.0)),
        ("is_weekend", "bool", None),
        ("hour_sin", "float64", (-1.0, 1.0)),
        ("hour_cos", "float64", (-1.0, 1.0)),
        ("day_of_week_sin", "float64", (-1.0, 1.0)),
        ("day_of_week_cos", "float64", (-1.0, 1.0)),
    ):
        out.append(Feature(name, "calendar", dtype, False, context, value_range=bounds))
    for kind, measures in MEASURES.items():
        for measure, aggregate in measures:
            integral = aggregate in (_COUNT, _UNIQUE)
            for window in config.windows_for(kind, aggregate):
                out.append(Feature(
                    f"{kind}_{measure}__{window}", _GROUPS.get(kind, "device_session"),
                    "int64" if integral else "float64", not integral,
                    kind=kind, measure=measure, aggregate=aggregate, window=window,
                    value_range=(0.0, 1.0) if aggregate == _RATE else (0.0, INF),
                ))
    for name in SEQUENCE_COUNTERS:
        out.append(Feature(name, "sequence", "int64", False, aggregate="count", value_range=(0.0, INF)))
    for name in SEQUENCE_ELAPSED:
        out.append(Feature(name, "sequence", "float64", True, aggregate="delta", value_range=(0.0, INF)))
    for name in SEQUENCE_OUTCOMES:
        out.append(Feature(name, "sequence", "string", True))
    if config.geo.enabled:
        for name, dtype, nullable, aggregate, bounds in (
            ("distance_km_from_user_previous_success", "float64", True, "delta", (0.0, 20100.0)),
            ("seconds_since_user_previous_success_with_location", "float64", True, "delta", (0.0, INF)),
            ("implied_velocity_kmh_from_previous_success", "float64", True, "ratio", (0.0, INF)),
            ("country_changed_since_previous_success", "bool", True, "flag", None),
            ("region_changed_since_previous_success", "bool", True, "flag", None),
            ("user_previous_success_geo__status", "string", False, None, None),
            ("implied_velocity__status", "string", False, None, None),
        ):
            out.append(Feature(name, "geospatial", dtype, nullable, aggregate=aggregate, value_range=bounds))
    if config.baseline.enabled:
        for name, dtype, nullable, bounds in BASELINE_FEATURES:
            out.append(Feature(name, "baseline", dtype, nullable, "baseline_derived", value_range=bounds))
    return out


SEQUENCE_COUNTERS = (
    "prior_consecutive_user_failures",
    "prior_consecutive_source_failures",
    "prior_failures_since_user_success",
    "prior_failures_since_pair_success",
)
SEQUENCE_ELAPSED = (
    "seconds_since_user_previous_event",
    "seconds_since_source_previous_event",
    "seconds_since_user_previous_success",
    "seconds_since_user_previous_failure",
    "seconds_since_pair_previous_event",
)
SEQUENCE_OUTCOMES = ("previous_user_outcome", "previous_pair_outcome")
BASELINE_FEATURES = (
    ("is_new_device_for_user", "bool", True, None),
    ("is_new_source_for_user", "bool", True, None),
    ("is_new_country_for_user", "bool", True, None),
    ("is_new_application_for_user", "bool", True, None),
    ("is_new_auth_method_for_user", "bool", True, None),
    ("login_hour_deviation", "float64", True, (0.0, 1.0)),
    ("user_success_rate_deviation", "float64", True, (-1.0, 1.0)),
    ("user_event_rate_ratio", "float64", True, None),
    ("response_time_zscore", "float64", True, None),
    ("source_user_fanout_ratio", "float64", True, None),
    ("source_event_rate_ratio", "float64", True, None),
    ("distance_from_user_baseline_centroid_km", "float64", True, (0.0, 20100.0)),
    ("user_in_baseline", "bool", False, None),
    ("source_in_baseline", "bool", False, None),
)
NOVELTY_FEATURES = tuple(name for name, *_ in BASELINE_FEATURES[:5])


def feature_schema(config: FeatureConfig) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, SPARK_TYPES[f.dtype], f.nullable) for f in feature_catalog(config)]
    )
