"""Detection rules as columns: one struct per rule, evaluated row by row on the snapshot.

A rule is data: gates, early verdicts, unmet conditions, evidence and weighted
strength components, all written as SQL text over snapshot columns.  No rule
needs a shuffle or a Python function.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuthwatchError, DetectionConfig, SignalConfig
from ..functions.scalar import uuid5
from ..runtime import compile_wide_rows
from ..schema import EVIDENCE, NOVELTY_FEATURES, PROHIBITED_FEATURE_COLUMNS, RULE_DETECTIONS, SCHEMA_VERSION, SEVERITIES

RULE_VERSION = "1.0.0"
EVIDENCE_ARRAY = f"array<{EVIDENCE.simpleString()}>"
_SUCCESS = "current_authentication_outcome = 'success'"
_EPSILON = 1e-9  # fixed value: floor of an observation in the inverse saturation


@dataclass(frozen=True)
class Evidence:
    code: str
    feature: str
    comparator: str
    observed: str
    threshold: object = None
    unit: str | None = None
    when: str | None = None


@dataclass(frozen=True)
class Component:
    weight: float
    value: str
    when: str | None = None


@dataclass(frozen=True)
class Rule:
    """``steps`` are (condition, status, reason) in order; ``unmet`` are (condition, reason)."""

    rule_id: str
    family: str
    category: str
    group: str
    severity: str
    gates: tuple[str, ...] = ()
    steps: tuple[tuple[str, str, str], ...] = ()
    unmet: tuple[tuple[str, str], ...] = ()
    evidence: tuple[Evidence, ...] = ()
    components: tuple[Component, ...] = ()
    columns: tuple[str, ...] = field(default=())


def lit(value) -> str:
    if value is None:
        return "cast(null as string)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("'", "''") + "'"


def saturate(observed: str, threshold: float, signal: SignalConfig) -> str:
    """0 at the threshold, 1 at ``saturation_multiple`` times it."""
    if threshold <= 0:
        return f"CASE WHEN {observed} > 0 THEN 1D ELSE 0D END"
    return _curve(f"({observed}) / {lit(float(threshold))}", signal)


def saturate_inverse(observed: str, threshold: float, signal: SignalConfig) -> str:
    if threshold <= 0:
        return "0D"
    return _curve(f"{lit(float(threshold))} / greatest(cast({observed} as double), {lit(_EPSILON)})", signal)


def _upper(status: str) -> str:
    """``upper`` of a status; those that the features write are not spelled anew for each row."""
    known = ("no_prior_success", "missing_current_location", "missing_prior_location", "unavailable")
    return f"CASE {status} {' '.join(f"WHEN '{s}' THEN '{s.upper()}'" for s in known)} ELSE upper({status}) END"


def _curve(ratio: str, signal: SignalConfig) -> str:
    m = signal.saturation_multiple
    if m <= 1.0:
        return f"CASE WHEN {ratio} > 1D THEN 1D ELSE 0D END"
    return f"least(1D, greatest(0D, ({ratio} - 1D) / {lit(float(m) - 1.0)}))"


def strength(components: tuple[Component, ...], signal: SignalConfig) -> str:
    """Weighted mean of the present components, rescaled onto [floor, 1]."""
    floor = signal.min_signal_strength
    if not components:
        return lit(float(floor))

    def term(c: Component, value: str) -> str:
        return f"CASE WHEN {c.when} THEN {value} ELSE 0D END" if c.when else value

    top = " + ".join(f"({term(c, f'{lit(float(c.weight))} * ({c.value})')})" for c in components)
    total = " + ".join(f"({term(c, lit(float(c.weight)))})" for c in components)
    raw = f"least(1D, greatest(0D, ({top}) / nullif({total}, 0D)))"
    return f"least(1D, {lit(float(floor))} + {lit(1.0 - floor)} * coalesce({raw}, 0D))"


# Rule parameters and their defaults.
DEFAULTS: dict[str, dict] = {
    "PAD-BF-001": dict(
        window="5m", cardinality_window="5m", min_pair_failures=8, min_user_failures=8,
        min_pair_failure_rate=0.80, min_consecutive_failures=5, max_source_unique_users=3,
        max_mean_interarrival_seconds=60.0, blocked_support_threshold=2),
    "PAD-BF-002": dict(
        min_pair_failures_since_success=6, min_user_failures_since_success=8,
        max_seconds_since_previous_failure=300.0),
    "PAD-PS-001": dict(
        window="1h", cardinality_window="1h", min_unique_users=15, min_source_failures=15,
        min_source_failure_rate=0.70, max_attempts_per_user=3.0, min_mean_interarrival_seconds=0.0),
    "PAD-CS-001": dict(
        window="1h", cardinality_window="1h", min_unique_users=10, min_successes=1, min_failures=10,
        min_unique_devices=3, min_unique_user_agents=3, max_attempts_per_user=4.0),
    "PAD-DBF-001": dict(
        window="1h", cardinality_window="1h", min_unique_sources=8, min_user_failures=20,
        min_user_failure_rate=0.80, max_pair_attempts=5, max_source_unique_users=3),
    "PAD-ATO-001": dict(
        min_novel_context_count=2, min_supporting_signals=1, min_prior_failures=3,
        min_login_hour_deviation=0.90, min_abs_response_time_zscore=3.0, min_event_rate_ratio=3.0,
        min_baseline_distance_km=1000.0),
    "PAD-GEO-001": dict(
        min_distance_km=500.0, min_velocity_kmh=900.0, distance_rounding_km=10.0,
        require_country_change=False, zero_elapsed_policy="fire"),
    "PAD-BOT-001": dict(
        dispersion_window="15m", cardinality_window="1h", min_attempts=20, max_interarrival_cov=0.15,
        max_mean_interarrival_seconds=120.0, max_unique_user_agents=2, min_unique_users=0),
    "PAD-MFA-001": dict(
        window="15m", min_mfa_history_events=6, min_mfa_observations=3, min_mfa_failures=4,
        min_challenges=4),
}
RULE_IDS = tuple(DEFAULTS)
# Family, attack category, correlation group, default severity.
META = {
    "PAD-BF-001": ("brute_force", "brute_force", "credential_guessing_single_target", "high"),
    "PAD-BF-002": ("brute_force", "brute_force", "credential_guessing_single_target", "high"),
    "PAD-PS-001": ("spraying", "password_spraying", "source_fanout", "high"),
    "PAD-CS-001": ("stuffing", "credential_stuffing", "source_fanout", "high"),
    "PAD-DBF-001": ("brute_force", "distributed_brute_force", "credential_guessing_single_target", "critical"),
    "PAD-ATO-001": ("account_compromise", "account_takeover_indicator", "session_anomaly", "critical"),
    "PAD-GEO-001": ("location", "impossible_travel_indicator", "location_movement", "high"),
    "PAD-BOT-001": ("automation", "bot_activity", "automation_timing", "medium"),
    "PAD-MFA-001": ("account_compromise", "mfa_sequence_anomaly", "session_anomaly", "medium"),
}
CATEGORY_GROUP = {category: group for _, category, group, _ in META.values()}


def _bf1(p, s):
    w, c = p["window"], p["cardinality_window"]
    pair, user, rate = f"pair_failure_count__{w}", f"user_failure_count__{w}", f"pair_failure_rate__{w}"
    users, gap, blocked = f"source_unique_user_count__{c}", f"pair_mean_interarrival_seconds__{w}", f"user_blocked_count__{w}"
    run = "prior_consecutive_user_failures"
    fast = f"{gap} <= {lit(p['max_mean_interarrival_seconds'])}"
    locked = f"{blocked} >= {lit(p['blocked_support_threshold'])}"
    return dict(
        gates=(rate,),
        unmet=(
            (f"{pair} < {lit(p['min_pair_failures'])}", "BELOW_PAIR_FAILURE_COUNT"),
            (f"{user} < {lit(p['min_user_failures'])}", "BELOW_USER_FAILURE_COUNT"),
            (f"{rate} < {lit(p['min_pair_failure_rate'])}", "BELOW_PAIR_FAILURE_RATE"),
            (f"{run} < {lit(p['min_consecutive_failures'])}", "BELOW_CONSECUTIVE_FAILURES"),
            (f"{users} > {lit(p['max_source_unique_users'])}", "SOURCE_TARGETS_TOO_MANY_ACCOUNTS"),
        ),
        evidence=(
            Evidence("BF_PAIR_FAILURE_COUNT", pair, "gte", pair, p["min_pair_failures"], "count"),
            Evidence("BF_USER_FAILURE_COUNT", user, "gte", user, p["min_user_failures"], "count"),
            Evidence("BF_PAIR_FAILURE_RATE", rate, "gte", rate, p["min_pair_failure_rate"], "ratio"),
            Evidence("BF_CONSECUTIVE_USER_FAILURES", run, "gte", run, p["min_consecutive_failures"], "count"),
            Evidence("BF_SOURCE_TARGET_CONCENTRATION", users, "lte", users, p["max_source_unique_users"], "count"),
            Evidence("BF_PAIR_INTERARRIVAL", gap, "lte", gap, p["max_mean_interarrival_seconds"], "seconds", fast),
            Evidence("BF_BLOCKED_ACTIVITY", blocked, "gte", blocked, p["blocked_support_threshold"], "count", locked),
        ),
        components=(
            Component(1.0, saturate(pair, p["min_pair_failures"], s)),
            Component(0.8, saturate(user, p["min_user_failures"], s)),
            Component(0.6, rate),
            Component(0.8, saturate(run, p["min_consecutive_failures"], s)),
            Component(0.4, saturate_inverse(gap, p["max_mean_interarrival_seconds"], s), fast),
            Component(0.3, saturate(blocked, p["blocked_support_threshold"], s), locked),
        ),
        columns=(pair, user, rate, users, run, gap, blocked),
    )


def _bf2(p, s):
    pair, user = "prior_failures_since_pair_success", "prior_failures_since_user_success"
    prev, since = "previous_user_outcome", "seconds_since_user_previous_failure"
    pair_met = f"{pair} >= {lit(p['min_pair_failures_since_success'])}"
    user_met = f"{user} >= {lit(p['min_user_failures_since_success'])}"
    limit = p["max_seconds_since_previous_failure"]
    return dict(
        gates=(prev, since),
        steps=((f"NOT ({_SUCCESS})", "not_fired", "ANCHOR_DID_NOT_SUCCEED"),),
        unmet=(
            (f"NOT ({pair_met} OR {user_met})", "BELOW_FAILURE_BURST_THRESHOLD"),
            (f"{prev} NOT IN ('failure', 'blocked')", "PRECEDING_EVENT_WAS_NOT_A_FAILURE"),
            (f"{since} > {lit(limit)}", "PRECEDING_FAILURE_TOO_DISTANT"),
        ),
        evidence=(
            Evidence("BF2_CURRENT_SUCCESS", "current_authentication_outcome", "eq", "'success'"),
            Evidence("BF2_PAIR_FAILURE_BURST", pair, "gte", pair, p["min_pair_failures_since_success"], "count", pair_met),
            Evidence("BF2_USER_FAILURE_BURST", user, "gte", user, p["min_user_failures_since_success"], "count", user_met),
            Evidence("BF2_PREVIOUS_OUTCOME", prev, "in", prev),
            Evidence("BF2_FAILURE_RECENCY", since, "lte", since, limit, "seconds"),
        ),
        components=(
            Component(1.0, saturate(pair, p["min_pair_failures_since_success"], s), pair_met),
            Component(1.0, saturate(user, p["min_user_failures_since_success"], s), user_met),
            Component(0.5, saturate_inverse(since, limit, s)),
        ),
        columns=("current_authentication_outcome", pair, user, prev, since),
    )


def _ps(p, s):
    w, c = p["window"], p["cardinality_window"]
    users, fails = f"source_unique_user_count__{c}", f"source_failure_count__{w}"
    attempts, rate = f"source_attempt_count__{w}", f"source_failure_rate__{w}"
    gap, floor = f"source_mean_interarrival_seconds__{w}", p["min_mean_interarrival_seconds"]
    per_user = f"({attempts} / nullif({users}, 0L))"
    cadence = f"{gap} >= {lit(floor)}" if floor > 0 else None
    evidence = [
        Evidence("PS_SOURCE_USER_FANOUT", users, "gte", users, p["min_unique_users"], "count"),
        Evidence("PS_SOURCE_FAILURE_COUNT", fails, "gte", fails, p["min_source_failures"], "count"),
        Evidence("PS_SOURCE_FAILURE_RATE", rate, "gte", rate, p["min_source_failure_rate"], "ratio"),
        Evidence("PS_ATTEMPTS_PER_USER", attempts, "lte", per_user, p["max_attempts_per_user"], "ratio"),
    ]
    components = [
        Component(1.0, saturate(users, p["min_unique_users"], s)),
        Component(0.8, saturate(fails, p["min_source_failures"], s)),
        Component(0.6, rate),
        Component(0.6, saturate_inverse(per_user, p["max_attempts_per_user"], s)),
    ]
    if cadence:
        evidence.append(Evidence("PS_SOURCE_CADENCE", gap, "gte", gap, floor, "seconds", cadence))
        components.append(Component(0.4, saturate(gap, floor, s), cadence))
    return dict(
        gates=(rate,),
        steps=((f"{users} = 0", "insufficient_data", "NO_TARGETED_ACCOUNTS_OBSERVED"),),
        unmet=(
            (f"{users} < {lit(p['min_unique_users'])}", "BELOW_ACCOUNT_FANOUT_THRESHOLD"),
            (f"{fails} < {lit(p['min_source_failures'])}", "BELOW_SOURCE_FAILURE_COUNT"),
            (f"{rate} < {lit(p['min_source_failure_rate'])}", "BELOW_SOURCE_FAILURE_RATE"),
            (f"{per_user} > {lit(p['max_attempts_per_user'])}", "ATTEMPTS_PER_ACCOUNT_TOO_HIGH"),
        ),
        evidence=tuple(evidence), components=tuple(components),
        columns=(users, fails, attempts, rate, *((gap,) if cadence else ())),
    )


def _cs(p, s):
    # The published contract names the conditions; the component weights are this library's choice.
    w, c = p["window"], p["cardinality_window"]
    users, wins = f"source_unique_user_count__{c}", f"source_success_count__{w}"
    fails, attempts = f"source_failure_count__{w}", f"source_attempt_count__{w}"
    devices, agents = f"source_unique_device_count__{c}", f"source_unique_user_agent_count__{c}"
    per_user = f"({attempts} / nullif({users}, 0L))"
    fresh = "(coalesce(is_new_device_for_user, false) OR coalesce(is_new_country_for_user, false))"
    return dict(
        gates=("user_in_baseline",),
        steps=(
            ("NOT user_in_baseline", "insufficient_data", "ACCOUNT_ABSENT_FROM_BASELINE"),
            (f"{users} = 0", "insufficient_data", "NO_TARGETED_ACCOUNTS_OBSERVED"),
        ),
        unmet=(
            (f"{users} < {lit(p['min_unique_users'])}", "BELOW_ACCOUNT_FANOUT_THRESHOLD"),
            (f"{wins} < {lit(p['min_successes'])}", "BELOW_SUCCESS_COUNT"),
            (f"{fails} < {lit(p['min_failures'])}", "BELOW_SOURCE_FAILURE_COUNT"),
            (f"{devices} < {lit(p['min_unique_devices'])}", "BELOW_DEVICE_DIVERSITY"),
            (f"{agents} < {lit(p['min_unique_user_agents'])}", "BELOW_USER_AGENT_DIVERSITY"),
            (f"{per_user} > {lit(p['max_attempts_per_user'])}", "ATTEMPTS_PER_ACCOUNT_TOO_HIGH"),
            (f"NOT {fresh}", "CONTEXT_IS_FAMILIAR"),
        ),
        evidence=(
            Evidence("CS_SOURCE_USER_FANOUT", users, "gte", users, p["min_unique_users"], "count"),
            Evidence("CS_MIXED_OUTCOMES", wins, "gte", wins, p["min_successes"], "count"),
            Evidence("CS_CLIENT_DIVERSITY", devices, "gte", devices, p["min_unique_devices"], "count"),
            Evidence("CS_ATTEMPTS_PER_USER", attempts, "lte", per_user, p["max_attempts_per_user"], "ratio"),
            Evidence("CS_UNFAMILIAR_CONTEXT", "is_new_device_for_user", "is_true", "true",
                     when="coalesce(is_new_device_for_user, false)"),
            Evidence("CS_UNFAMILIAR_CONTEXT", "is_new_country_for_user", "is_true", "true",
                     when="NOT coalesce(is_new_device_for_user, false)"),
        ),
        components=(
            Component(1.0, saturate(users, p["min_unique_users"], s)),
            Component(0.6, saturate(devices, p["min_unique_devices"], s)),
            Component(0.6, saturate(agents, p["min_unique_user_agents"], s)),
            Component(0.6, saturate_inverse(per_user, p["max_attempts_per_user"], s)),
        ),
        columns=(users, wins, fails, attempts, devices, agents, "user_in_baseline",
                 "is_new_device_for_user", "is_new_country_for_user"),
    )


def _dbf(p, s):
    w, c = p["window"], p["cardinality_window"]
    sources, fails, rate = f"user_unique_source_count__{c}", f"user_failure_count__{w}", f"user_failure_rate__{w}"
    pair, users = f"pair_attempt_count__{w}", f"source_unique_user_count__{c}"
    return dict(
        gates=(rate,),
        unmet=(
            (f"{sources} < {lit(p['min_unique_sources'])}", "BELOW_SOURCE_FANOUT_THRESHOLD"),
            (f"{fails} < {lit(p['min_user_failures'])}", "BELOW_USER_FAILURE_COUNT"),
            (f"{rate} < {lit(p['min_user_failure_rate'])}", "BELOW_USER_FAILURE_RATE"),
            (f"{pair} > {lit(p['max_pair_attempts'])}", "PER_SOURCE_VOLUME_TOO_HIGH"),
            (f"{users} > {lit(p['max_source_unique_users'])}", "SOURCE_TARGETS_TOO_MANY_ACCOUNTS"),
        ),
        evidence=(
            Evidence("DBF_USER_SOURCE_FANOUT", sources, "gte", sources, p["min_unique_sources"], "count"),
            Evidence("DBF_USER_FAILURE_COUNT", fails, "gte", fails, p["min_user_failures"], "count"),
            Evidence("DBF_USER_FAILURE_RATE", rate, "gte", rate, p["min_user_failure_rate"], "ratio"),
            Evidence("DBF_LOW_PER_SOURCE_VOLUME", pair, "lte", pair, p["max_pair_attempts"], "count"),
            Evidence("DBF_SOURCE_NOT_FANNED_OUT", users, "lte", users, p["max_source_unique_users"], "count"),
        ),
        components=(
            Component(1.0, saturate(sources, p["min_unique_sources"], s)),
            Component(0.9, saturate(fails, p["min_user_failures"], s)),
            Component(0.6, rate),
            Component(0.6, saturate_inverse(pair, p["max_pair_attempts"], s)),
        ),
        columns=(sources, fails, rate, pair, users),
    )


def _ato(p, s):
    novel = "(" + " + ".join(f"CASE WHEN {n} THEN 1L ELSE 0L END" for n in NOVELTY_FEATURES) + ")"
    z = "abs(response_time_zscore)"
    support = (
        ("ATO_PRIOR_FAILURES", "prior_failures_since_user_success", "prior_failures_since_user_success",
         "gte", p["min_prior_failures"], "count"),
        ("ATO_LOGIN_HOUR_DEVIATION", "login_hour_deviation", "login_hour_deviation", "gte",
         p["min_login_hour_deviation"], "ratio"),
        ("ATO_RESPONSE_TIME_DEVIATION", "response_time_zscore", z, "gte", p["min_abs_response_time_zscore"], "zscore"),
        ("ATO_EVENT_RATE_DEVIATION", "user_event_rate_ratio", "user_event_rate_ratio", "gte",
         p["min_event_rate_ratio"], "ratio"),
        ("ATO_MFA_DEVIATION", "current_mfa_outcome", "current_mfa_outcome", "in", None, None),
        ("ATO_BASELINE_DISTANCE", "distance_from_user_baseline_centroid_km",
         "distance_from_user_baseline_centroid_km", "gte", p["min_baseline_distance_km"], "km"),
    )

    def holds(observed, threshold):
        if threshold is None:
            return f"coalesce({observed} IN ('failed', 'bypassed'), false)"
        return f"coalesce({observed} >= {lit(threshold)}, false)"

    present = "(" + " + ".join(
        f"CASE WHEN {holds(obs, thr)} THEN 1L ELSE 0L END" for _, _, obs, _, thr, _ in support) + ")"
    return dict(
        gates=("user_in_baseline",),
        steps=(
            (f"NOT ({_SUCCESS})", "not_fired", "ANCHOR_DID_NOT_SUCCEED"),
            ("NOT user_in_baseline", "insufficient_data", "ACCOUNT_ABSENT_FROM_BASELINE"),
        ),
        unmet=(
            (f"{novel} < {lit(p['min_novel_context_count'])}", "BELOW_NOVEL_CONTEXT_THRESHOLD"),
            (f"{present} < {lit(p['min_supporting_signals'])}", "NO_SUPPORTING_BEHAVIOURAL_DEVIATION"),
        ),
        evidence=(
            Evidence("ATO_CURRENT_SUCCESS", "current_authentication_outcome", "eq", "'success'"),
            Evidence("ATO_NOVEL_CONTEXT_COUNT", "derived", "gte", novel, p["min_novel_context_count"], "count"),
            *[Evidence(code, feature, cmp, obs, thr, unit, holds(obs, thr))
              for code, feature, obs, cmp, thr, unit in support],
        ),
        components=(
            Component(1.0, saturate(novel, p["min_novel_context_count"], s)),
            Component(0.8, f"{present} / {lit(float(len(support)))}"),
        ),
        columns=("current_authentication_outcome", "user_in_baseline", *NOVELTY_FEATURES,
                 *[feature for _, feature, *_ in support]),
    )


def _geo(p, s):
    status, distance = "user_previous_success_geo__status", "distance_km_from_user_previous_success"
    changed = "coalesce(country_changed_since_previous_success, false)"
    velocity, vstatus = "implied_velocity_kmh_from_previous_success", "implied_velocity__status"
    far, fast, step = p["min_distance_km"], p["min_velocity_kmh"], p["distance_rounding_km"]
    zero = f"{vstatus} = 'zero_elapsed'"
    # rint rounds half to even.
    shown = f"rint({distance} / {lit(step)}) * {lit(step)}" if step > 0 else distance
    steps = [
        (f"NOT ({_SUCCESS})", "not_fired", "ANCHOR_DID_NOT_SUCCEED"),
        (f"{status} != 'ok'", "insufficient_data", f"concat('GEO_STATUS_', {_upper(status)})"),
        (f"{distance} IS NULL", "insufficient_data", "GEO_DISTANCE_UNAVAILABLE"),
        (f"{distance} < {lit(far)}", "not_fired", "BELOW_MINIMUM_DISTANCE"),
    ]
    if p["require_country_change"]:
        steps.append((f"NOT {changed}", "not_fired", "NO_COUNTRY_CHANGE"))
    if p["zero_elapsed_policy"] != "fire":
        steps.append((zero, "insufficient_data", "GEO_VELOCITY_ZERO_ELAPSED"))
    steps += [
        (f"{vstatus} NOT IN ('ok', 'capped', 'zero_elapsed')", "insufficient_data",
         f"concat('GEO_VELOCITY_', {_upper(vstatus)})"),
        (f"NOT ({zero}) AND {velocity} IS NULL", "insufficient_data", "GEO_VELOCITY_UNAVAILABLE"),
        (f"NOT ({zero}) AND {velocity} < {lit(fast)}", "not_fired", "BELOW_MINIMUM_VELOCITY"),
    ]
    return dict(
        gates=(status,),
        steps=tuple(steps),
        evidence=(
            Evidence("GEO_CURRENT_SUCCESS", "current_authentication_outcome", "eq", "'success'"),
            Evidence("GEO_DISTANCE", distance, "gte", shown, far, "km"),
            Evidence("GEO_COUNTRY_CHANGE", "country_changed_since_previous_success", "is_true", "true", None, None, changed),
            Evidence("GEO_IMPLIED_VELOCITY", velocity, "gte", velocity, fast, "kmh", f"NOT ({zero})"),
            Evidence("GEO_ZERO_ELAPSED_INTERVAL", vstatus, "eq", "'zero_elapsed'", None, None, zero),
        ),
        components=(
            Component(1.0, saturate(velocity, fast, s), f"NOT ({zero})"),
            Component(0.5, saturate(distance, far, s), f"NOT ({zero})"),
            Component(1.0, "1D", zero),
        ),
        columns=("current_authentication_outcome", status, distance, velocity, vstatus,
                 "country_changed_since_previous_success"),
    )


def _bot(p, s):
    d, c = p["dispersion_window"], p["cardinality_window"]
    attempts, cov = f"source_attempt_count__{d}", f"source_interarrival_coefficient_of_variation__{d}"
    mean, agents = f"source_mean_interarrival_seconds__{d}", f"source_unique_user_agent_count__{c}"
    users, floor = f"source_unique_user_count__{c}", p["min_unique_users"]
    evidence = [
        Evidence("BOT_ATTEMPT_VOLUME", attempts, "gte", attempts, p["min_attempts"], "count"),
        Evidence("BOT_TIMING_REGULARITY", cov, "lte", cov, p["max_interarrival_cov"], "ratio"),
        Evidence("BOT_MEAN_INTERARRIVAL", mean, "lte", mean, p["max_mean_interarrival_seconds"], "seconds"),
        Evidence("BOT_CLIENT_UNIFORMITY", agents, "lte", agents, p["max_unique_user_agents"], "count"),
    ]
    components = [
        Component(0.8, saturate(attempts, p["min_attempts"], s)),
        Component(1.0, saturate_inverse(cov, p["max_interarrival_cov"], s)),
        Component(0.5, saturate_inverse(mean, p["max_mean_interarrival_seconds"], s)),
        Component(0.5, saturate_inverse(agents, p["max_unique_user_agents"], s)),
    ]
    if floor > 0:
        wide = f"{users} >= {lit(floor)}"
        evidence.append(Evidence("BOT_SOURCE_FANOUT", users, "gte", users, floor, "count", wide))
        components.append(Component(0.4, saturate(users, floor, s), wide))
    return dict(
        gates=(cov,),
        steps=((f"{mean} IS NULL", "insufficient_data", f"INSUFFICIENT_HISTORY_{mean.upper()}"),),
        unmet=(
            (f"{attempts} < {lit(p['min_attempts'])}", "BELOW_ATTEMPT_VOLUME_FLOOR"),
            (f"{cov} > {lit(p['max_interarrival_cov'])}", "TIMING_TOO_IRREGULAR"),
            (f"{mean} > {lit(p['max_mean_interarrival_seconds'])}", "MEAN_INTERVAL_TOO_LONG"),
            (f"{agents} > {lit(p['max_unique_user_agents'])}", "CLIENT_CHARACTERISTICS_TOO_VARIED"),
        ),
        evidence=tuple(evidence), components=tuple(components),
        columns=(attempts, cov, mean, agents, *((users,) if floor > 0 else ())),
    )


def _mfa(p, s):
    w = p["window"]
    attempts, fails, asks = f"user_attempt_count__{w}", f"user_mfa_failure_count__{w}", f"user_challenge_count__{w}"
    now = "current_mfa_outcome"
    fails_met = f"{fails} >= {lit(p['min_mfa_failures'])}"
    asks_met = f"{asks} >= {lit(p['min_challenges'])}"
    return dict(
        steps=(
            (f"{attempts} < {lit(p['min_mfa_history_events'])}", "insufficient_data", "MFA_INSUFFICIENT_ATTEMPT_HISTORY"),
            (f"{asks} + {fails} < {lit(p['min_mfa_observations'])}", "insufficient_data", "MFA_INSUFFICIENT_OBSERVATIONS"),
            (f"{now} IS NULL", "insufficient_data", "MFA_OUTCOME_NOT_RECORDED"),
        ),
        unmet=(
            (f"NOT ({fails_met} OR {asks_met})", "PRIOR_MFA_ACTIVITY_NOT_ELEVATED"),
            (f"{now} NOT IN ('failed', 'bypassed')", "ANCHOR_MFA_OUTCOME_NOT_ABNORMAL"),
        ),
        evidence=(
            Evidence("MFA_HISTORY_SUFFICIENT", attempts, "gte", attempts, p["min_mfa_history_events"], "count"),
            Evidence("MFA_PRIOR_FAILURES", fails, "gte", fails, p["min_mfa_failures"], "count", fails_met),
            Evidence("MFA_PRIOR_CHALLENGES", asks, "gte", asks, p["min_challenges"], "count", asks_met),
            Evidence("MFA_CURRENT_OUTCOME", now, "in", now),
        ),
        components=(
            Component(1.0, saturate(fails, p["min_mfa_failures"], s), fails_met),
            Component(0.8, saturate(asks, p["min_challenges"], s), asks_met),
        ),
        columns=(attempts, fails, asks, now),
    )


_BUILDERS = {
    "PAD-BF-001": _bf1, "PAD-BF-002": _bf2, "PAD-PS-001": _ps, "PAD-CS-001": _cs, "PAD-DBF-001": _dbf,
    "PAD-ATO-001": _ato, "PAD-GEO-001": _geo, "PAD-BOT-001": _bot, "PAD-MFA-001": _mfa,
}


def build_rules(config: DetectionConfig) -> list[Rule]:
    """Resolve parameters and windows of every enabled rule."""
    enabled = config.enabled_rule_ids if config.enabled_rule_ids is not None else RULE_IDS
    unknown = sorted((set(enabled) | set(config.rules)) - set(RULE_IDS))
    if unknown:
        raise AuthwatchError(f"unknown rules: {unknown}")
    out = []
    for rule_id in RULE_IDS:
        if rule_id not in enabled:
            continue
        family, category, group, severity = META[rule_id]
        given = dict(config.rules.get(rule_id, {}))
        severity = given.pop("severity", severity)
        extra = sorted(set(given) - set(DEFAULTS[rule_id]))
        if extra or severity not in SEVERITIES:
            raise AuthwatchError(f"{rule_id}: bad parameters {extra or severity}")
        if family not in config.family_weights:
            raise AuthwatchError(f"family {family!r} carries no weight")
        body = _BUILDERS[rule_id]({**DEFAULTS[rule_id], **given}, config.signal)
        out.append(Rule(rule_id, family, category, group, severity, **body))
    return out


def required_columns(config: DetectionConfig) -> list[str]:
    return sorted({c for rule in build_rules(config) for c in rule.columns})


def show(value: str) -> str:
    return f"cast({value} as string)"


def _present(items: list[tuple[str | None, str]], kind: str) -> str:
    """Array of the values whose condition holds. (``array_compact`` would be interpreted together with the values.)"""
    nothing = f"cast(array() as {kind})"
    return "concat({})".format(", ".join([nothing, *[
        f"CASE WHEN {when} THEN array({value}) ELSE {nothing} END" if when else f"array({value})" for when, value in items]]))


def _evidence_sql(item: Evidence) -> str:
    threshold = lit(None) if item.threshold is None else show(lit(item.threshold))
    limit = "''" if item.threshold is None else f"concat(' ', {threshold})"
    unit = "" if item.unit is None else f" {item.unit}"
    message = f"concat('{item.feature} = ', {show(item.observed)}, ' (condition {item.comparator}', {limit}, '{unit})')"
    return (
        f"named_struct('evidence_code', '{item.code}', 'feature_name', '{item.feature}', "
        f"'comparator', '{item.comparator}', 'observed_value', {show(item.observed)}, "
        f"'threshold_value', {threshold}, 'unit', {lit(item.unit)}, 'message', {message})"
    )


def _is_expression(reason: str) -> bool:
    return "(" in reason


def _gate_sql(rule: Rule) -> str:
    return " OR ".join(f"{g} IS NULL" for g in rule.gates) or "false"


def _unmet_sql(rule: Rule) -> str:
    return " OR ".join(f"({c})" for c, _ in rule.unmet) or "false"


def status_sql(rule: Rule) -> str:
    """The status of the rule's verdict alone."""
    cases = [(_gate_sql(rule), "insufficient_data"), *[(c, status) for c, status, _ in rule.steps], (_unmet_sql(rule), "not_fired")]
    return "CASE {} ELSE 'fired' END".format(" ".join(f"WHEN {c} THEN '{status}'" for c, status in cases))


def rule_sql(rule: Rule, config: DetectionConfig, explain: bool = True) -> str:
    """The rule's result struct as one SQL expression; without ``explain`` its evidence and reasons are empty."""
    gate, unmet = _gate_sql(rule), _unmet_sql(rule)
    gate_reasons = _present([(f"{g} IS NULL", f"'INSUFFICIENT_HISTORY_{g.upper()}'") for g in rule.gates], "array<string>")
    unmet_reasons = _present([(c, f"'{r}'") for c, r in rule.unmet], "array<string>")
    evidence = _present([(e.when, _evidence_sql(e)) for e in rule.evidence], EVIDENCE_ARRAY)
    codes = _present([(e.when, f"'{e.code}'") for e in rule.evidence], "array<string>")

    def verdict(status: str, score: str, items: str, reasons: str) -> str:
        if not explain:
            items, reasons = nothing, "cast(array() as array<string>)"
        return (
            f"named_struct('rule_id', '{rule.rule_id}', 'rule_family', '{rule.family}', "
            f"'attack_category', '{rule.category}', 'correlation_group', '{rule.group}', "
            f"'severity', '{rule.severity}', 'severity_rank', {SEVERITIES.index(rule.severity)}, "
            f"'weight', {lit(float(config.family_weights[rule.family]))}, 'status', '{status}', "
            f"'signal_strength', {score}, 'evidence', {items}, 'reason_codes', {reasons})"
        )

    nothing = f"cast(array() as {EVIDENCE_ARRAY})"
    steps = [f"WHEN {gate} THEN {verdict('insufficient_data', '0D', nothing, gate_reasons)}"]
    for condition, status, reason in rule.steps:
        text = reason if _is_expression(reason) else f"'{reason}'"
        steps.append(f"WHEN {condition} THEN {verdict(status, '0D', nothing, f'array({text})')}")
    steps.append(f"WHEN {unmet} THEN {verdict('not_fired', '0D', nothing, unmet_reasons)}")
    fired = verdict("fired", strength(rule.components, config.signal), evidence, codes)
    return f"CASE {' '.join(steps)} ELSE {fired} END"


# Further columns that no detection input may carry.
FOREIGN_COLUMNS = ("campaign", "ground_truth", "model_prediction", "model_score", "prediction", "predicted_label",
                   "scenario_type", "y_pred", "y_true")
_FINDING = "problem string, subject string, violations bigint"


def snapshot_findings(snapshot: DataFrame, config: DetectionConfig | None = None,
                      version: str = SCHEMA_VERSION) -> DataFrame:
    """What makes a snapshot unfit as rule input: (problem, subject, violations), only rows above zero.

    Names and types are read off the schema. The values take one aggregate over the table, for the columns that the
    enabled rules read, and one count by anchor.
    """
    spark, types = snapshot.sparkSession, dict(snapshot.dtypes)
    banned = {*FOREIGN_COLUMNS, *PROHIBITED_FEATURE_COLUMNS} & set(types)
    keys = ("feature_schema_version", "anchor_event_id", "anchor_event_time")
    needed = [*keys, *required_columns(config or DetectionConfig())]
    fixed = [("prohibited_column", c, 1) for c in sorted(banned)]
    fixed += [("missing_column", c, 1) for c in sorted(set(needed) - set(types))]
    if types.get("anchor_event_time", "timestamp") != "timestamp":
        fixed.append(("time_without_zone", "anchor_event_time", 1))
    rules = {("wrong_version", keys[0]): f"NOT ({keys[0]} <=> '{version}')",
             ("empty_anchor", keys[1]): f"coalesce(trim({keys[1]}), '') = ''", ("empty_time", keys[2]): f"{keys[2]} IS NULL"}
    rules |= {("not_finite", c): f"isnan({c}) OR abs({c}) = double('inf')" for c in sorted(set(needed))
              if types.get(c) in ("double", "float")}
    rules = {k: e for k, e in rules.items() if k[1] in types}
    found = spark.createDataFrame(fixed, _FINDING)
    if rules:
        totals = snapshot.agg(*[F.count_if(F.expr(e)).alias(f"n{i}") for i, e in enumerate(rules.values())])
        pairs = ", ".join(f"'{a}', '{b}', n{i}" for i, (a, b) in enumerate(rules))
        found = found.unionByName(totals.selectExpr(f"stack({len(rules)}, {pairs}) AS (problem, subject, violations)"))
    if keys[1] in types:
        again = snapshot.groupBy(keys[1]).agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("violations"))
        found = found.unionByName(again.selectExpr("'repeated_anchor' AS problem", f"'{keys[1]}' AS subject", "violations"))
    return found.where("violations > 0")


def require_valid_snapshot(snapshot: DataFrame, config: DetectionConfig | None = None) -> DataFrame:
    """The snapshot itself, or an error that names problems and counts, never values."""
    found = snapshot_findings(snapshot, config).orderBy("problem", "subject").collect()
    if found:
        raise AuthwatchError("unfit snapshot: " + "; ".join(f"{r.problem} {r.subject} ({r.violations})" for r in found))
    return snapshot


#: The verdict array as input of a function over its elements. Such functions are interpreted together with their whole
#: argument, so the rules must not be folded into it; Spark leaves alone what is computed and read more than once.
STORED = "slice(results, 1, size(results))"


def rules_for(snapshot: DataFrame, config: DetectionConfig) -> list[Rule]:
    """The enabled rules, whose columns the snapshot must have."""
    compile_wide_rows(snapshot.sparkSession)
    rules = build_rules(config)
    missing = sorted({c for r in rules for c in r.columns} - set(snapshot.columns))
    if missing:
        raise AuthwatchError(f"the snapshot lacks columns the rules need: {missing}")
    return rules


def evaluate_rules(snapshot: DataFrame, config: DetectionConfig | None = None, explain: bool = True) -> DataFrame:
    """(anchor_event_id, anchor_event_time, results array) with every enabled rule's verdict.

    Evidence and reasons are texts put together for each verdict; readers of statuses and strengths alone go without (``explain``).
    """
    config = config or DetectionConfig()
    rules = rules_for(snapshot, config)
    # One column per rule first: smaller expressions, then the array over them.
    rows = snapshot.selectExpr(
        "anchor_event_id", "anchor_event_time",
        *[f"{rule_sql(r, config, explain)} AS `{r.rule_id}`" for r in rules])
    results = ", ".join(f"`{r.rule_id}`" for r in rules)
    return rows.selectExpr("anchor_event_id", "anchor_event_time", f"slice(array({results}), 1, {len(rules)}) AS results")


def diagnostics(results: DataFrame, config: DetectionConfig | None = None) -> DataFrame:
    """One row per anchor and rule with its status, disabled rules included."""
    config = config or DetectionConfig()
    enabled = {r.rule_id for r in build_rules(config)}
    no_codes = "cast(array() as array<string>)"
    entry = ("named_struct('rule_id', {}, 'status', {}, 'signal_strength', {}, 'reason_codes', {})")
    verdicts = f"transform({STORED}, r -> {{}})".format(
        entry.format("r.rule_id", "r.status", "r.signal_strength", "r.reason_codes"))
    off = [entry.format(f"'{r}'", "'disabled'", "0D", no_codes) for r in RULE_IDS if r not in enabled]
    # Disabled rules join the same array, so the snapshot is still read once.
    both = f"concat({verdicts}, array({', '.join(off)}))" if off else verdicts
    return results.selectExpr("anchor_event_id", "anchor_event_time", f"explode({both}) AS r").select(
        "anchor_event_id", "anchor_event_time", "r.*")


def status_counts(results: DataFrame) -> DataFrame:
    return (
        results.selectExpr(f"explode(transform({STORED}, r -> struct(r.rule_id, r.status))) AS r")
        .groupBy("r.rule_id", "r.status").agg(F.count("*").alias("anchors"))
    )


def detections(results: DataFrame, config: DetectionConfig | None = None) -> DataFrame:
    """The published detection table: fired verdicts with deterministic ids."""
    config = config or DetectionConfig()
    fired = results.selectExpr(
        "anchor_event_id", "anchor_event_time", f"explode(filter({STORED}, r -> r.status = 'fired')) AS r")
    name = F.concat_ws("|", F.col("anchor_event_id"), F.col("r.rule_id"), F.lit(RULE_VERSION))
    return fired.select(
        F.lit(SCHEMA_VERSION).alias("detection_schema_version"),
        uuid5(config.id_namespace, name).alias("detection_id"),
        "anchor_event_id", "anchor_event_time", "r.rule_id",
        F.lit(RULE_VERSION).alias("rule_version"),
        "r.rule_family", "r.attack_category", "r.severity", "r.signal_strength",
        "r.correlation_group", "r.evidence", "r.reason_codes",
    ).select(*RULE_DETECTIONS.names)
