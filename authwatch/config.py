"""Parameters of every stage, as plain frozen dataclasses.

Durations are labels such as ``"15m"``; event time is integer microseconds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, is_dataclass

UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_LABEL = re.compile(r"^(\d+)([smhd])$")


class AuthwatchError(ValueError):
    """Raised when input or configuration breaks a stage's contract."""


def seconds(label: str) -> int:
    match = _LABEL.match(label)
    if not match:
        raise AuthwatchError(f"malformed duration {label!r}; expected e.g. '15m' or '24h'")
    return int(match.group(1)) * UNIT_SECONDS[match.group(2)]


def micros(label: str) -> int:
    return seconds(label) * 1_000_000


@dataclass(frozen=True)
class GeoConfig:
    enabled: bool = True
    max_plausible_velocity_kmh: float = 1200.0
    min_distance_km_for_velocity: float = 0.0


@dataclass(frozen=True)
class BaselineConfig:
    enabled: bool = True
    min_events_per_user: int = 5
    min_events_per_source: int = 5
    known_set_max_size: int | None = None  # None keeps every value that a user was seen with
    known_set_min_occurrences: int = 1
    hour_histogram_alpha: float = 1.0
    response_time_min_events: int = 5
    max_response_time_zscore: float = 10.0
    rate_reference_window: str = "1h"


@dataclass(frozen=True)
class SplitConfig:
    mode: str = "fractions"  # or "boundaries"
    train_fraction: float = 0.70
    validation_fraction: float = 0.15
    test_fraction: float = 0.15
    train_end_us: int | None = None
    validation_end_us: int | None = None
    test_end_us: int | None = None
    purge: str = "24h"
    embargo: str = "0s"
    strict_isolation: bool = True
    boundary_campaign_policy: str = "exclude"  # or "assign_by_first_event"
    normal_grouping: str = "singleton"  # or "campaign_id"
    holdout_scenarios: tuple[str, ...] = ("novel_anomaly_holdout",)
    max_excluded_fraction: float = 0.10

    def __post_init__(self):
        if self.mode not in ("fractions", "boundaries"):
            raise AuthwatchError(f"unknown split mode {self.mode!r}")
        if self.mode == "fractions":
            total = self.train_fraction + self.validation_fraction + self.test_fraction
            if abs(total - 1.0) > 1e-9:
                raise AuthwatchError("split fractions must sum to 1")
        else:
            ends = (self.train_end_us, self.validation_end_us, self.test_end_us)
            if None in ends or not ends[0] < ends[1] < ends[2]:
                raise AuthwatchError("name three split boundaries, each later than the one before")
        seconds(self.purge), seconds(self.embargo)


@dataclass(frozen=True)
class SkewConfig:
    """How dense histories are detected and spread.

    An entity is *dense* when one ``max window`` long time bucket holds more
    than ``dense_rows`` of its events, or when it has more than ``total_rows``
    events altogether.  Dense entities leave the sliding-frame plan and are cut
    into ``chunk`` long pieces of time, so no task ever holds a whole entity of
    more than ``whole_rows`` events; one of fewer stays in one piece.
    """

    dense_rows: int = 300
    total_rows: int = 5_000_000
    chunk: str = "1h"
    whole_rows: int = 50_000


@dataclass(frozen=True)
class FeatureConfig:
    windows: tuple[str, ...] = ("1m", "5m", "15m", "1h", "24h")
    cardinality_windows: tuple[str, ...] = ("5m", "1h", "24h")
    dispersion_windows: tuple[str, ...] = ("5m", "15m", "1h", "24h")
    device_session_windows: tuple[str, ...] = ("5m", "1h")
    pair_windows: tuple[str, ...] = ("5m", "1h", "24h")
    min_count_for_rate: int = 1
    baseline: BaselineConfig = field(default_factory=BaselineConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    geo: GeoConfig = field(default_factory=GeoConfig)
    skew: SkewConfig = field(default_factory=SkewConfig)

    def __post_init__(self):
        ladder = [micros(w) for w in self.windows]
        if not ladder or ladder != sorted(set(ladder)) or ladder[0] <= 0:
            raise AuthwatchError("windows must be positive and strictly ascending")
        for name in ("cardinality_windows", "dispersion_windows", "device_session_windows", "pair_windows"):
            extra = sorted(set(getattr(self, name)) - set(self.windows))
            if extra or not getattr(self, name):
                raise AuthwatchError(f"{name} must be a non-empty subset of windows; extra {extra}")
        if self.baseline.enabled and self.baseline.rate_reference_window not in self.cardinality_windows:
            raise AuthwatchError("rate_reference_window must be one of cardinality_windows")
        if self.split.strict_isolation and micros(self.split.purge) < self.max_window_us:
            raise AuthwatchError("split.purge is shorter than the longest feature window")

    @property
    def max_window_us(self) -> int:
        return max(micros(w) for w in self.windows)

    def windows_for(self, kind: str, aggregate: str) -> tuple[str, ...]:
        """Rungs of the window ladder that the kind's and the aggregate's own ladders share."""
        ladders = [getattr(self, name) for name in (LADDER_OF_KIND.get(kind), LADDER_OF_AGGREGATE.get(aggregate)) if name]
        return tuple(w for w in self.windows if all(w in rungs for rungs in ladders))


# Which setting limits the windows of an entity kind, and of an aggregate; others use the whole ladder.
LADDER_OF_KIND = {
    "pair": "pair_windows",
    **dict.fromkeys(("user_device", "device", "session"), "device_session_windows"),
}
LADDER_OF_AGGREGATE = {
    "unique": "cardinality_windows",
    "std": "dispersion_windows",
    "cov": "dispersion_windows",
}

# Default family weights and the scope dimension of each correlation group.
FAMILY_WEIGHTS = {
    "brute_force": 0.90,
    "spraying": 0.85,
    "stuffing": 0.85,
    "account_compromise": 0.95,
    "location": 0.80,
    "automation": 0.70,
}
SCOPE_DIMENSION = {
    "credential_guessing_single_target": "user",
    "source_fanout": "source",
    "session_anomaly": "user",
    "location_movement": "user",
    "automation_timing": "source",
}


@dataclass(frozen=True)
class SignalConfig:
    saturation_multiple: float = 3.0
    min_signal_strength: float = 0.15


@dataclass(frozen=True)
class ScoringConfig:
    correlation_reducer: str = "max"  # or "bounded_sum"
    min_fired_risk_score: float = 1.0
    round_decimals: int = 4
    top_evidence_count: int = 3
    medium: float = 40.0
    high: float = 65.0
    critical: float = 85.0

    def __post_init__(self):
        if not self.medium < self.high < self.critical:
            raise AuthwatchError("medium, high and critical have to rise in this order")
        if self.correlation_reducer not in ("max", "bounded_sum"):
            raise AuthwatchError(f"unknown correlation reducer {self.correlation_reducer!r}")


@dataclass(frozen=True)
class AlertConfig:
    grouping_window: str = "15m"
    cooldown: str = "30m"
    alert_limit_window: str = "1h"
    max_alerts_per_group_per_window: int = 5
    min_alert_risk_score: float = 10.0
    min_alert_severity: str = "low"
    escalation_bypasses_cooldown: bool = True
    strict_scope: bool = False
    scope_dimension: dict = field(default_factory=lambda: dict(SCOPE_DIMENSION))


@dataclass(frozen=True)
class DetectionConfig:
    """Rule switches, thresholds and scoring policy.

    ``rules`` maps a rule id to the parameters that differ from its defaults
    (including ``severity``).  ``id_namespace`` seeds the deterministic ids.
    """

    enabled_rule_ids: tuple[str, ...] | None = None
    rules: dict = field(default_factory=dict)
    family_weights: dict = field(default_factory=lambda: dict(FAMILY_WEIGHTS))
    signal: SignalConfig = field(default_factory=SignalConfig)
    scoring: ScoringConfig = field(default_factory=ScoringConfig)
    alerting: AlertConfig = field(default_factory=AlertConfig)
    id_namespace: str = "authwatch/detection"


def config_fingerprint(config) -> str:
    """SHA-256 over the semantic content of a configuration object."""
    import hashlib
    import json

    def plain(value):
        if is_dataclass(value):
            return {f.name: plain(getattr(value, f.name)) for f in fields(value) if f.name != "skew"}
        if isinstance(value, dict):
            return {str(k): plain(v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [plain(v) for v in value]
        return value

    return hashlib.sha256(json.dumps(plain(config), sort_keys=True).encode()).hexdigest()
