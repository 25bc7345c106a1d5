"""Settings for the given tables: 30 days of sparse events need hour-to-week windows."""

from authwatch.config import (
    AlertConfig, BaselineConfig, DetectionConfig, FeatureConfig, SplitConfig,
)

REFERENCE_END_US = 1_705_363_200_000_000  # 2024-01-16T00:00:00Z, end of the baseline interval

FEATURES = FeatureConfig(
    windows=("6h", "1d", "3d", "7d"),
    cardinality_windows=("1d", "3d", "7d"),
    dispersion_windows=("1d", "3d", "7d"),
    device_session_windows=("6h", "1d"),
    pair_windows=("1d", "3d", "7d"),
    baseline=BaselineConfig(rate_reference_window="1d"),
    split=SplitConfig(train_fraction=0.5, validation_fraction=0.25, test_fraction=0.25, purge="1d",
                      embargo="6h", strict_isolation=False, max_excluded_fraction=1.0),
)
RULES = {
    "PAD-BF-001": dict(window="7d", cardinality_window="7d", min_pair_failures=6, min_user_failures=8,
                       min_pair_failure_rate=0.4, min_consecutive_failures=2, max_source_unique_users=400,
                       max_mean_interarrival_seconds=172800.0, blocked_support_threshold=2),
    "PAD-BF-002": dict(min_pair_failures_since_success=2, min_user_failures_since_success=2,
                       max_seconds_since_previous_failure=172800.0),
    "PAD-PS-001": dict(window="7d", cardinality_window="7d", min_unique_users=15, min_source_failures=15,
                       min_source_failure_rate=0.4, max_attempts_per_user=3.5),
    "PAD-CS-001": dict(window="7d", cardinality_window="7d"),
    "PAD-DBF-001": dict(window="7d", cardinality_window="7d", min_unique_sources=3, min_user_failures=5,
                        min_user_failure_rate=0.4, max_pair_attempts=5, max_source_unique_users=400),
    "PAD-ATO-001": dict(min_novel_context_count=1, min_prior_failures=2, min_login_hour_deviation=0.95,
                        min_abs_response_time_zscore=1.5, min_event_rate_ratio=1.5),
    "PAD-GEO-001": dict(min_velocity_kmh=100.0),
    "PAD-BOT-001": dict(dispersion_window="7d", cardinality_window="7d", max_interarrival_cov=1.2,
                        max_mean_interarrival_seconds=20000.0, max_unique_user_agents=3, min_unique_users=5),
    "PAD-MFA-001": dict(window="7d", min_mfa_failures=3, min_challenges=2),
}
DETECTION = DetectionConfig(rules=RULES, alerting=AlertConfig())
SHORT_ID = "^(u|s|d|sess):[0-9:]+$"
