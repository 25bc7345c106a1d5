"""Independent DuckDB SQL for the registered queries, over the same Parquet tables."""

from __future__ import annotations

import uuid

from authwatch.schema import feature_catalog
from driver_config import FEATURES, REFERENCE_END_US

# Fixed values, written here once more so that an error in the package cannot pass on both sides.
ENTITY_KEYS = {"user": ("user_id",), "source": ("source_id",), "pair": ("user_id", "source_id"), "user_device": ("user_id", "device_id"),
               "session": ("session_id",), "device": ("device_id",)}
DIMENSION_COLUMNS = {
    "unique_source_count": "source_id", "unique_device_count": "device_id", "unique_country_count": "country_code",
    "unique_application_count": "application_id", "unique_auth_method_count": "authentication_method", "unique_user_count": "user_id",
    "unique_user_agent_count": "user_agent_family", "user_count": "user_id",
}
SCENARIOS = ("normal", "brute_force", "password_spraying", "credential_stuffing", "distributed_brute_force", "account_takeover_indicator",
             "impossible_travel", "bot_activity", "novel_anomaly_holdout")


def micros(label: str) -> int:
    return int(label[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86_400}[label[-1]] * 1_000_000


EV = """raw AS (
  SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k, epoch_us(ts::TIMESTAMP) AS us FROM events
), ev AS (
  SELECT event_id::VARCHAR AS event_id, us, ts, user_id AS u,
    'u:' || user_id AS user_id,
    CASE WHEN k < 70 THEN 's:' || (user_id % 25) ELSE 's:' || (100 + k % 6) END AS source_id,
    'd:' || ((user_id * 7 + k % 4) % 97) AS device_id,
    'sess:' || user_id || ':' || strftime(ts, '%Y%m%d') AS session_id,
    'app-' || (k % 5) AS application_id,
    CASE WHEN k % 4 = 3 THEN 'mfa_totp' ELSE 'password' END AS authentication_method,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'success'
         WHEN event_type = 'signup' AND k % 2 = 0 THEN 'challenged'
         WHEN event_type = 'signup' THEN 'blocked' ELSE 'failure' END AS authentication_outcome,
    CASE k % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'passed' WHEN 2 THEN 'not_required' WHEN 3 THEN 'bypassed' END AS mfa_outcome,
    CASE k % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'JP' END AS country_code,
    CASE k % 4 WHEN 0 THEN 40.0 WHEN 1 THEN 51.5 WHEN 2 THEN 35.7 END::DOUBLE AS lat,
    CASE k % 4 WHEN 0 THEN -74.0 WHEN 1 THEN -0.1 WHEN 2 THEN 139.7 END::DOUBLE AS lon,
    CASE WHEN k % 7 != 0 THEN 'ua-' || (k % 3) END AS user_agent_family,
    CASE WHEN k % 11 = 0 THEN 'bot' WHEN k % 3 = 0 THEN 'mobile_app' ELSE 'web_browser' END AS client_type,
    CASE WHEN k % 20 != 0 THEN floor(value * 10)::BIGINT END AS response_time_ms
  FROM raw
)"""
TRUTH = "gt AS (SELECT event_id::VARCHAR AS event_id, 'camp-' || (user_id % 30) || '-' || substr(strftime(ts, '%Y%m%d'), 1, 7) AS campaign_id, CASE user_id % 9 {} END AS scenario FROM events)".format(
    " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SCENARIOS)))
_FINAL = {"attempt_count": "count(*)", "event_count": "count(*)"}
_OUT = {"success_count": "success", "failure_count": "failure", "challenge_count": "challenged", "blocked_count": "blocked"}


def _keys(kind):
    return ", ".join(ENTITY_KEYS[kind])


def feature_sql(f) -> str:
    """One windowed feature; ``g_<kind>`` columns hold the gap to the previous event of the kind."""
    over = f"OVER (PARTITION BY {_keys(f.kind)} ORDER BY us RANGE BETWEEN {micros(f.window)} PRECEDING AND 1 PRECEDING)"
    m = f.measure
    if m in _FINAL:
        return f"count(*) {over}"
    if m in _OUT:
        return f"count(*) FILTER (WHERE authentication_outcome = '{_OUT[m]}') {over}"
    if m == "mfa_failure_count":
        return f"count(*) FILTER (WHERE mfa_outcome = 'failed') {over}"
    if m in DIMENSION_COLUMNS:
        return f"count(DISTINCT {DIMENSION_COLUMNS[m]}) {over}"
    n = f"count(*) {over}"
    if m in ("failure_rate", "success_rate"):
        return f"count(*) FILTER (WHERE authentication_outcome = '{m[:7]}') {over}::DOUBLE / nullif({n}, 0)"
    rt = "response_time_ms"
    if m == "mean_response_time_ms":
        return f"(sum({rt}) {over})::DOUBLE / nullif(count({rt}) {over}, 0)"

    def std(n, s, q):
        return f"CASE WHEN {n} >= 2 THEN sqrt(({n} * {q} - {s} * {s})::DOUBLE / ({n} * ({n} - 1))) END"

    if m == "response_time_std_ms":
        return std(f"count({rt}) {over}", f"(sum({rt}) {over})", f"(sum({rt} * {rt}) {over})")
    gap = f"g_{f.kind}::HUGEINT"
    total = f"(max(us) {over} - min(us) {over})::HUGEINT"
    mean = f"CASE WHEN {n} >= 2 THEN {total}::DOUBLE / ({n} - 1) / 1e6 END"
    if m == "mean_interarrival_seconds":
        return mean
    squares = f"(sum({gap} * {gap}) {over} - coalesce(first_value({gap} * {gap}) {over}, 0))"
    sd = f"({std(f'({n} - 1)', total, squares)}) / 1e6"
    return sd if m == "interarrival_std_seconds" else f"({sd}) / nullif(({mean}), 0)"


CAT = {f.name: f for f in feature_catalog(FEATURES)}
GAPS = "evg AS (SELECT *, {} FROM ev)".format(", ".join(
    f"us - lag(us) OVER (PARTITION BY {_keys(k)} ORDER BY us) AS g_{k}" for k in ("user", "source", "pair")))


def shown(name: str, expr: str | None = None, digits: int = 6) -> str:
    f = CAT.get(name)
    expr = expr or name
    if f is not None and f.dtype == "float64":
        return f"round({expr}, {digits}) AS {name}"
    return f"{expr} AS {name}"


def windowed(names) -> str:
    cols = ", ".join(shown(n, feature_sql(CAT[n])) for n in names)
    return f"WITH {EV}, {GAPS} SELECT event_id AS anchor_event_id, {cols} FROM evg"


_P = "OVER (PARTITION BY {} ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
PU, PS_, PP = _P.format("user_id"), _P.format("source_id"), _P.format("user_id, source_id")


def _cf(kind):
    return (f"sum((authentication_outcome = 'failure')::INT) OVER (PARTITION BY {_keys(kind)} ORDER BY us ROWS UNBOUNDED PRECEDING) AS cf_{kind}")


SEQ = f"""sq AS (SELECT *, {_cf('user')}, {_cf('source')}, {_cf('pair')} FROM evg), sf AS (SELECT *,
  (coalesce(sum((authentication_outcome = 'failure')::INT) {PU}, 0) - coalesce(max(cf_user) FILTER (WHERE authentication_outcome != 'failure') {PU}, 0))::BIGINT AS prior_consecutive_user_failures,
  (coalesce(sum((authentication_outcome = 'failure')::INT) {PS_}, 0) - coalesce(max(cf_source) FILTER (WHERE authentication_outcome != 'failure') {PS_}, 0))::BIGINT AS prior_consecutive_source_failures,
  (coalesce(sum((authentication_outcome = 'failure')::INT) {PU}, 0) - coalesce(max(cf_user) FILTER (WHERE authentication_outcome = 'success') {PU}, 0))::BIGINT AS prior_failures_since_user_success,
  (coalesce(sum((authentication_outcome = 'failure')::INT) {PP}, 0) - coalesce(max(cf_pair) FILTER (WHERE authentication_outcome = 'success') {PP}, 0))::BIGINT AS prior_failures_since_pair_success,
  (us - max(us) {PU}) / 1e6 AS seconds_since_user_previous_event,
  (us - max(us) {PS_}) / 1e6 AS seconds_since_source_previous_event,
  (us - max(us) FILTER (WHERE authentication_outcome = 'success') {PU}) / 1e6 AS seconds_since_user_previous_success,
  (us - max(us) FILTER (WHERE authentication_outcome = 'failure') {PU}) / 1e6 AS seconds_since_user_previous_failure,
  (us - max(us) {PP}) / 1e6 AS seconds_since_pair_previous_event,
  lag(authentication_outcome) OVER (PARTITION BY user_id ORDER BY us) AS previous_user_outcome,
  lag(authentication_outcome) OVER (PARTITION BY user_id, source_id ORDER BY us) AS previous_pair_outcome,
  max(us) FILTER (WHERE authentication_outcome = 'success') {PU} AS win_us,
  max(us) FILTER (WHERE authentication_outcome = 'success' AND lat IS NOT NULL) {PU} AS loc_us
  FROM sq)"""


def hav(a, b, c, d):
    return (f"2 * 6371.0088 * asin(sqrt(least(1, greatest(0, sin((radians({c}) - radians({a})) / 2) ** 2 + "
            f"cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2))))")


GEO = f"""ga AS (SELECT sf.*, w.country_code AS win_country, l.lat AS plat, l.lon AS plon,
  CASE WHEN win_us IS NULL THEN 'no_prior_success' WHEN sf.lat IS NULL THEN 'missing_current_location'
       WHEN loc_us IS NULL THEN 'missing_prior_location' ELSE 'ok' END AS gstat
  FROM sf LEFT JOIN ev w ON w.user_id = sf.user_id AND w.us = win_us LEFT JOIN ev l ON l.user_id = sf.user_id AND l.us = loc_us),
gb AS (SELECT *, CASE WHEN gstat = 'ok' THEN {hav('plat', 'plon', 'lat', 'lon')} END AS distance_km_from_user_previous_success,
  (us - loc_us) / 1e6 AS seconds_since_user_previous_success_with_location,
  win_country != country_code AS country_changed_since_previous_success, NULL::BOOLEAN AS region_changed_since_previous_success,
  gstat AS user_previous_success_geo__status FROM ga),
gc AS (SELECT *, distance_km_from_user_previous_success / (seconds_since_user_previous_success_with_location / 3600) AS v FROM gb),
gf AS (SELECT *, CASE WHEN v IS NOT NULL THEN least(v, 1200.0) END AS implied_velocity_kmh_from_previous_success,
  CASE WHEN gstat != 'ok' THEN 'unavailable' WHEN v > 1200 THEN 'capped' ELSE 'ok' END AS implied_velocity__status FROM gc)"""
STAGES = f"WITH {EV}, {GAPS}, {SEQ}, {GEO}"

REF = f"ref AS (SELECT * FROM ev WHERE us < {REFERENCE_END_US}), iv AS (SELECT (max(us) - min(us)) / 3.6e9 AS h FROM ref)"


def _std(n, s, q):
    return f"CASE WHEN {n} >= 5 THEN sqrt(({n} * {q} - {s} * {s})::DOUBLE / ({n} * ({n} - 1))) END"


_RT = "count(response_time_ms)", "sum(response_time_ms)::HUGEINT", "sum(response_time_ms::HUGEINT * response_time_ms)"
UB = f"""ub AS (SELECT user_id, count(*) AS event_count,
  CASE WHEN count(*) >= 5 THEN count(*) FILTER (WHERE authentication_outcome = 'success')::DOUBLE / count(*) END AS success_rate,
  CASE WHEN count(*) >= 5 THEN count(*) / (SELECT h FROM iv) END AS event_rate_per_hour,
  CASE WHEN {_RT[0]} >= 5 THEN {_RT[1]}::DOUBLE / {_RT[0]} END AS response_time_mean_ms, {_std(*_RT)} AS response_time_std_ms,
  count(lat) AS located_event_count, avg(lat) AS centroid_latitude, avg(lon) AS centroid_longitude
  FROM ref GROUP BY user_id)"""


def _entropy(col):
    return (f"(SELECT source_id, count(*) AS kinds, -sum(c::DOUBLE / t * log2(c::DOUBLE / t)) AS e FROM (SELECT source_id, {col}, count(*) AS c, "
            f"sum(count(*)) OVER (PARTITION BY source_id) AS t FROM ref WHERE {col} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)")


SB = f"""sb AS (SELECT a.*, c.kinds AS distinct_client_type_count, g.kinds AS distinct_user_agent_count, c.e AS client_type_entropy, g.e AS user_agent_entropy FROM
  (SELECT source_id, count(*) AS event_count, count(DISTINCT user_id) AS targeted_user_count,
  CASE WHEN count(*) >= 5 THEN count(*) FILTER (WHERE authentication_outcome = 'success')::DOUBLE / count(*) END AS success_rate,
  CASE WHEN count(*) >= 5 THEN count(*) / (SELECT h FROM iv) END AS event_rate_per_hour,
  CASE WHEN {_RT[0]} >= 5 THEN {_RT[1]}::DOUBLE / {_RT[0]} END AS response_time_mean_ms, {_std(*_RT)} AS response_time_std_ms
  FROM ref GROUP BY source_id) a LEFT JOIN {_entropy('client_type')} c USING (source_id) LEFT JOIN {_entropy('user_agent_family')} g USING (source_id))"""
_SETS = {"known_device_ids": "device_id", "known_source_ids": "source_id", "known_country_codes": "country_code",
         "known_application_ids": "application_id", "known_auth_methods": "authentication_method"}
KNOWN = "kn AS (" + " UNION ALL ".join(
    f"SELECT user_id, '{n}' AS set_name, {c} AS value, count(*) AS occurrences FROM ref WHERE {c} IS NOT NULL GROUP BY user_id, {c}"
    for n, c in _SETS.items()) + ")"
HIST = "hi AS (SELECT user_id, (us // 3600000000) % 24 AS hr, count(*) AS hn FROM ref GROUP BY 1, 2)"
_NEW = {"is_new_device_for_user": ("known_device_ids", "device_id"), "is_new_source_for_user": ("known_source_ids", "source_id"),
        "is_new_country_for_user": ("known_country_codes", "country_code"),
        "is_new_application_for_user": ("known_application_ids", "application_id"),
        "is_new_auth_method_for_user": ("known_auth_methods", "authentication_method")}
_R1 = {n: feature_sql(CAT[n]) for n in ("user_attempt_count__1d", "source_attempt_count__1d", "source_unique_user_count__1d")}
BASE = f"""{REF}, {UB}, {SB}, {KNOWN}, {HIST}, r1 AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in _R1.items())} FROM evg),
bf AS (SELECT e.*, ub.user_id IS NOT NULL AS user_in_baseline, sb.source_id IS NOT NULL AS source_in_baseline,
  {', '.join(f"CASE WHEN ub.user_id IS NOT NULL AND e.{c} IS NOT NULL THEN n{i}.value IS NULL END AS {n}" for i, (n, (_, c)) in enumerate(_NEW.items()))},
  CASE WHEN ub.user_id IS NOT NULL THEN 1 - (coalesce(hi.hn, 0) + 1.0) / (ub.event_count + 24.0) END AS login_hour_deviation,
  (e.authentication_outcome = 'success')::INT - ub.success_rate AS user_success_rate_deviation,
  CASE WHEN ub.event_rate_per_hour > 0 THEN r1.user_attempt_count__1d / 24.0 / ub.event_rate_per_hour END AS user_event_rate_ratio,
  greatest(-10.0, least(10.0, CASE WHEN ub.response_time_std_ms != 0 THEN (e.response_time_ms - ub.response_time_mean_ms) / ub.response_time_std_ms END)) AS zz,
  r1.source_unique_user_count__1d::DOUBLE / sb.targeted_user_count AS source_user_fanout_ratio,
  CASE WHEN sb.event_rate_per_hour > 0 THEN r1.source_attempt_count__1d / 24.0 / sb.event_rate_per_hour END AS source_event_rate_ratio,
  CASE WHEN e.lat IS NOT NULL THEN {hav('ub.centroid_latitude', 'ub.centroid_longitude', 'e.lat', 'e.lon')} END AS distance_from_user_baseline_centroid_km,
  ub.response_time_std_ms AS ustd
  FROM gf e JOIN r1 USING (event_id) LEFT JOIN ub ON ub.user_id = e.user_id LEFT JOIN sb ON sb.source_id = e.source_id
  {' '.join(f"LEFT JOIN kn n{i} ON n{i}.user_id = e.user_id AND n{i}.set_name = '{k}' AND n{i}.value = e.{c}" for i, (k, c) in enumerate(_NEW.values()))}
  LEFT JOIN hi ON hi.user_id = e.user_id AND hi.hr = (e.us // 3600000000) % 24),
bx AS (SELECT *, CASE WHEN ustd != 0 AND response_time_ms IS NOT NULL THEN zz END AS response_time_zscore FROM bf)"""
ALL = f"{STAGES}, {BASE}"


def sat(x, t):
    return f"least(1, greatest(0, ({x}::DOUBLE / {t} - 1) / 2))"


def inv(x, t):
    return f"least(1, greatest(0, ({float(t)} / greatest({x}::DOUBLE, 1e-9) - 1) / 2))"


def stren(*parts):
    """parts: (weight, value[, condition])."""
    top = " + ".join(f"CASE WHEN {p[2] if len(p) > 2 else 'true'} THEN {p[0]} * ({p[1]}) ELSE 0 END" for p in parts)
    bot = " + ".join(f"CASE WHEN {p[2] if len(p) > 2 else 'true'} THEN {p[0]} ELSE 0 END" for p in parts)
    return f"0.15 + 0.85 * (({top})::DOUBLE / ({bot}))"


S = "authentication_outcome = 'success'"
_NOV = "(" + " + ".join(f"coalesce({n}, false)::INT" for n in _NEW) + ")"
_SUP = ("(" + " + ".join(f"coalesce({c}, false)::INT" for c in (
    "prior_failures_since_user_success >= 2", "login_hour_deviation >= 0.95", "abs(response_time_zscore) >= 1.5",
    "user_event_rate_ratio >= 1.5", "mfa_outcome IN ('failed', 'bypassed')",
    "distance_from_user_baseline_centroid_km >= 1000")) + ")")
# rule -> (windowed features, insufficient, fired, strength); 'insufficient' wins after 'early not fired'.
RULE = {
    "PAD-BF-001": (["pair_failure_count__7d", "user_failure_count__7d", "pair_failure_rate__7d", "source_unique_user_count__7d",
                    "pair_mean_interarrival_seconds__7d", "user_blocked_count__7d"], "false", "pair_failure_rate__7d IS NULL",
                   "pair_failure_count__7d >= 6 AND user_failure_count__7d >= 8 AND pair_failure_rate__7d >= 0.4 AND prior_consecutive_user_failures >= 2 AND source_unique_user_count__7d <= 400",
                   stren((1.0, sat("pair_failure_count__7d", 6)), (0.8, sat("user_failure_count__7d", 8)), (0.6, "pair_failure_rate__7d"),
                         (0.8, sat("prior_consecutive_user_failures", 2)),
                         (0.4, inv("pair_mean_interarrival_seconds__7d", 172800), "pair_mean_interarrival_seconds__7d <= 172800"),
                         (0.3, sat("user_blocked_count__7d", 2), "user_blocked_count__7d >= 2"))),
    "PAD-BF-002": ([], "false", "previous_user_outcome IS NULL OR seconds_since_user_previous_failure IS NULL",
                   f"{S} AND (prior_failures_since_pair_success >= 2 OR prior_failures_since_user_success >= 2) AND previous_user_outcome IN ('failure', 'blocked') AND seconds_since_user_previous_failure <= 172800",
                   stren((1.0, sat("prior_failures_since_pair_success", 2), "prior_failures_since_pair_success >= 2"),
                         (1.0, sat("prior_failures_since_user_success", 2), "prior_failures_since_user_success >= 2"),
                         (0.5, inv("seconds_since_user_previous_failure", 172800)))),
    "PAD-PS-001": (["source_unique_user_count__7d", "source_failure_count__7d", "source_attempt_count__7d", "source_failure_rate__7d"],
                   "false", "source_failure_rate__7d IS NULL OR source_unique_user_count__7d = 0",
                   "source_unique_user_count__7d >= 15 AND source_failure_count__7d >= 15 AND source_failure_rate__7d >= 0.4 AND source_attempt_count__7d::DOUBLE / nullif(source_unique_user_count__7d, 0) <= 3.5",
                   stren((1.0, sat("source_unique_user_count__7d", 15)), (0.8, sat("source_failure_count__7d", 15)), (0.6, "source_failure_rate__7d"),
                         (0.6, inv("source_attempt_count__7d::DOUBLE / nullif(source_unique_user_count__7d, 0)", 3.5)))),
    "PAD-CS-001": (["source_unique_user_count__7d", "source_success_count__7d", "source_failure_count__7d", "source_attempt_count__7d",
                    "source_unique_device_count__7d", "source_unique_user_agent_count__7d"], "false",
                   "NOT user_in_baseline OR source_unique_user_count__7d = 0",
                   "source_unique_user_count__7d >= 10 AND source_success_count__7d >= 1 AND source_failure_count__7d >= 10 AND source_unique_device_count__7d >= 3 AND source_unique_user_agent_count__7d >= 3 AND source_attempt_count__7d::DOUBLE / nullif(source_unique_user_count__7d, 0) <= 4 AND (coalesce(is_new_device_for_user, false) OR coalesce(is_new_country_for_user, false))",
                   stren((1.0, sat("source_unique_user_count__7d", 10)), (0.6, sat("source_unique_device_count__7d", 3)),
                         (0.6, sat("source_unique_user_agent_count__7d", 3)),
                         (0.6, inv("source_attempt_count__7d::DOUBLE / nullif(source_unique_user_count__7d, 0)", 4)))),
    "PAD-DBF-001": (["user_unique_source_count__7d", "user_failure_count__7d", "user_failure_rate__7d", "pair_attempt_count__7d",
                     "source_unique_user_count__7d"], "false", "user_failure_rate__7d IS NULL",
                    "user_unique_source_count__7d >= 3 AND user_failure_count__7d >= 5 AND user_failure_rate__7d >= 0.4 AND pair_attempt_count__7d <= 5 AND source_unique_user_count__7d <= 400",
                    stren((1.0, sat("user_unique_source_count__7d", 3)), (0.9, sat("user_failure_count__7d", 5)), (0.6, "user_failure_rate__7d"),
                          (0.6, inv("pair_attempt_count__7d", 5)))),
    "PAD-ATO-001": ([], f"NOT ({S})", "NOT user_in_baseline", f"{_NOV} >= 1 AND {_SUP} >= 1",
                    stren((1.0, sat(_NOV, 1)), (0.8, f"{_SUP} / 6.0"))),
    "PAD-GEO-001": ([], f"NOT ({S})", "gstat != 'ok'",
                    "distance_km_from_user_previous_success >= 500 AND implied_velocity_kmh_from_previous_success >= 100",
                    stren((1.0, sat("implied_velocity_kmh_from_previous_success", 100)), (0.5, sat("distance_km_from_user_previous_success", 500)))),
    "PAD-BOT-001": (["source_attempt_count__7d", "source_interarrival_coefficient_of_variation__7d", "source_mean_interarrival_seconds__7d",
                     "source_unique_user_agent_count__7d", "source_unique_user_count__7d"], "false",
                    "source_interarrival_coefficient_of_variation__7d IS NULL OR source_mean_interarrival_seconds__7d IS NULL",
                    "source_attempt_count__7d >= 20 AND source_interarrival_coefficient_of_variation__7d <= 1.2 AND source_mean_interarrival_seconds__7d <= 20000 AND source_unique_user_agent_count__7d <= 3",
                    stren((0.8, sat("source_attempt_count__7d", 20)), (1.0, inv("source_interarrival_coefficient_of_variation__7d", 1.2)),
                          (0.5, inv("source_mean_interarrival_seconds__7d", 20000)), (0.5, inv("source_unique_user_agent_count__7d", 3)),
                          (0.4, sat("source_unique_user_count__7d", 5), "source_unique_user_count__7d >= 5"))),
    "PAD-MFA-001": (["user_attempt_count__7d", "user_mfa_failure_count__7d", "user_challenge_count__7d"], "false",
                    "user_attempt_count__7d < 6 OR user_challenge_count__7d + user_mfa_failure_count__7d < 3 OR mfa_outcome IS NULL",
                    "(user_mfa_failure_count__7d >= 3 OR user_challenge_count__7d >= 2) AND mfa_outcome IN ('failed', 'bypassed')",
                    stren((1.0, sat("user_mfa_failure_count__7d", 3), "user_mfa_failure_count__7d >= 3"),
                          (0.8, sat("user_challenge_count__7d", 2), "user_challenge_count__7d >= 2"))),
}
_ALLF = sorted({n for r in RULE.values() for n in r[0]})
SNAP = f"{ALL}, wf AS (SELECT event_id, {', '.join(f'{feature_sql(CAT[n])} AS {n}' for n in _ALLF)} FROM evg), sn AS (SELECT * FROM bx JOIN wf USING (event_id))"


def rule_case(rule_id):
    _, early, missing, fired, score = RULE[rule_id]
    status = f"CASE WHEN {early} THEN 'not_fired' WHEN {missing} THEN 'insufficient_data' WHEN {fired} THEN 'fired' ELSE 'not_fired' END"
    return status, f"CASE WHEN ({status}) = 'fired' THEN {score} ELSE 0 END"


def rule_query(rule_id):
    status, score = rule_case(rule_id)
    return f"{SNAP} SELECT event_id AS anchor_event_id, {status} AS status, round({score}, 6) AS signal_strength FROM sn"


_META = {"PAD-BF-001": ("brute_force", 0.9, 1, 2), "PAD-BF-002": ("brute_force", 0.9, 1, 2), "PAD-PS-001": ("password_spraying", 0.85, 4, 2),
         "PAD-CS-001": ("credential_stuffing", 0.85, 4, 2), "PAD-DBF-001": ("distributed_brute_force", 0.9, 1, 3),
         "PAD-ATO-001": ("account_takeover_indicator", 0.95, 3, 3), "PAD-GEO-001": ("impossible_travel_indicator", 0.8, 2, 2),
         "PAD-BOT-001": ("bot_activity", 0.7, 0, 1), "PAD-MFA-001": ("mfa_sequence_anomaly", 0.95, 3, 1)}
RES = "re AS (" + " UNION ALL ".join(
    f"SELECT event_id, us, '{r}' AS rule_id, '{_META[r][0]}' AS category, {_META[r][2]} AS grp, {_META[r][3]} AS sev, "
    f"{rule_case(r)[0]} AS status, {_META[r][1]}::DOUBLE * ({rule_case(r)[1]}) AS contribution, {rule_case(r)[1]} AS s FROM sn" for r in RULE) + ")"
RISK = f"""{SNAP}, {RES}, gm AS (SELECT event_id, grp, max(contribution) AS m FROM re WHERE status = 'fired' GROUP BY 1, 2),
cb AS (SELECT event_id, least(100, greatest(1.0, round(100 * (1 - product(1 - m)), 4))) AS score FROM gm GROUP BY 1),
pr AS (SELECT event_id, category FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY contribution DESC, sev DESC, s DESC, rule_id) AS rn FROM re WHERE status = 'fired') WHERE rn = 1),
cn AS (SELECT event_id, any_value(us) AS us, count(*) FILTER (WHERE status = 'fired') AS fired_rule_count, count(*) FILTER (WHERE status = 'insufficient_data') AS insufficient_data_count FROM re GROUP BY 1),
rk AS (SELECT cn.*, coalesce(score, 0.0) AS risk_score, category AS primary_attack_category,
  CASE WHEN coalesce(score, 0) >= 85 THEN 'critical' WHEN coalesce(score, 0) >= 65 THEN 'high' WHEN coalesce(score, 0) >= 40 THEN 'medium' ELSE 'low' END AS severity
  FROM cn LEFT JOIN cb USING (event_id) LEFT JOIN pr USING (event_id))"""
_CLS = sorted(["brute_force", "password_spraying", "credential_stuffing", "distributed_brute_force", "account_takeover_indicator", "impossible_travel", "bot_activity"])
_CL = ", ".join(f"'{c}'" for c in _CLS)
EVAL = f"""{RISK}, {TRUTH}, lb AS (SELECT rk.*, gt.campaign_id, scenario, scenario != 'normal' AS malicious,
  CASE WHEN scenario IN ({_CL}) THEN scenario ELSE 'none' END AS actual,
  coalesce(CASE primary_attack_category WHEN 'impossible_travel_indicator' THEN 'impossible_travel' WHEN 'mfa_sequence_anomaly' THEN NULL ELSE primary_attack_category END, 'none') AS predicted
  FROM rk JOIN gt USING (event_id))"""
SPLIT = f"""WITH {EV}, {TRUTH}, o AS (SELECT us, row_number() OVER (ORDER BY us) - 1 AS i, count(*) OVER () AS n FROM ev),
bd AS (SELECT max(us) FILTER (WHERE i = floor(n * 0.5)) AS b1, max(us) FILTER (WHERE i = floor(n * 0.75)) AS b2, max(us) + 1 AS b3 FROM o),
s1 AS (SELECT ev.event_id, us, scenario, campaign_id, b1, b2, CASE WHEN scenario = 'novel_anomaly_holdout' THEN 'novel_anomaly_holdout'
  WHEN us < b1 THEN 'train' WHEN us < b2 THEN 'validation' ELSE 'test' END AS split FROM ev JOIN gt USING (event_id), bd),
cr AS (SELECT campaign_id FROM s1 WHERE scenario != 'normal' AND split IN ('train', 'validation', 'test') GROUP BY 1 HAVING count(DISTINCT split) > 1),
s2 AS (SELECT s1.event_id, us, b1, b2, scenario, s1.campaign_id, CASE WHEN cr.campaign_id IS NOT NULL AND split != 'novel_anomaly_holdout' AND scenario != 'normal' THEN 'excluded' ELSE split END AS split,
  CASE WHEN cr.campaign_id IS NOT NULL AND split != 'novel_anomaly_holdout' AND scenario != 'normal' THEN 'campaign_crosses_split_boundary' END AS r FROM s1 LEFT JOIN cr USING (campaign_id)),
s3 AS (SELECT *, CASE WHEN split NOT IN ('train', 'validation', 'test') THEN NULL
  WHEN us >= b1 AND us < b1 + 86400000000 THEN 'purged_after_boundary' WHEN us >= b1 - 21600000000 AND us < b1 THEN 'embargoed_before_boundary'
  WHEN us >= b2 AND us < b2 + 86400000000 THEN 'purged_after_boundary' WHEN us >= b2 - 21600000000 AND us < b2 THEN 'embargoed_before_boundary' END AS cut FROM s2),
sa AS (SELECT event_id, us, scenario, campaign_id, CASE WHEN cut IS NOT NULL THEN 'excluded' ELSE split END AS split, coalesce(cut, r) AS exclusion_reason FROM s3)"""


def _names(kind, *aggs):
    return [f.name for f in CAT.values() if f.kind == kind and f.aggregate in aggs]


GROUPS = {
    "win_user_counts": _names("user", "count"),
    "win_source_counts": _names("source", "count"),
    "win_pair_counts": _names("pair", "count"),
    "win_device_session": [f.name for f in CAT.values() if f.kind in ("user_device", "session", "device")],
    "win_rates": _names("user", "rate") + _names("source", "rate") + _names("pair", "rate"),
    "win_distinct_user": _names("user", "unique"),
    "win_distinct_source": _names("source", "unique"),
    "win_response_stats": [n for n in CAT if "response_time_ms__" in n or "response_time_std_ms__" in n],
    "win_interarrival_stats": [n for n in CAT if "interarrival_seconds__" in n or "interarrival_std" in n],
    "win_cov": _names("source", "cov"),
}
SEQ_GROUPS = {
    "seq_failures": ["prior_consecutive_user_failures", "prior_consecutive_source_failures", "prior_failures_since_user_success", "prior_failures_since_pair_success"],
    "seq_elapsed": ["seconds_since_user_previous_event", "seconds_since_source_previous_event", "seconds_since_user_previous_success", "seconds_since_user_previous_failure", "seconds_since_pair_previous_event"],
    "seq_previous_outcome": ["previous_user_outcome", "previous_pair_outcome"],
    "geo_previous_success": [f.name for f in CAT.values() if f.group == "geospatial"],
    "baseline_transform": [f.name for f in CAT.values() if f.group == "baseline"],
}


#: Columns of an event in the order of their names, as the digest takes them.
_EVENT_COLUMNS = {
    "application_id": "application_id", "authentication_method": "authentication_method", "authentication_outcome": "authentication_outcome",
    "client_type": "client_type", "coarse_latitude": "coalesce(printf('%.9f', lat), 'null')", "coarse_longitude": "coalesce(printf('%.9f', lon), 'null')", "country_code": "country_code",
    "device_id": "device_id", "event_id": "event_id", "event_time": "us",
    "failure_reason": "CASE authentication_outcome WHEN 'failure' THEN 'invalid_credentials' WHEN 'blocked' THEN 'rate_limited' END",
    "mfa_outcome": "mfa_outcome", "operating_system_family": "NULL::VARCHAR", "region_code": "NULL::VARCHAR", "response_time_ms": "response_time_ms",
    "schema_version": "'1.0.0'", "session_id": "session_id", "source_id": "source_id", "user_agent_family": "user_agent_family", "user_id": "user_id",
}
_SLICES = [f"sum(('0x' || substr(h, {at}, 15))::UBIGINT::HUGEINT)::VARCHAR" for at in (1, 16, 31)]
FINGERPRINT = f"""WITH {EV}, h AS (SELECT sha256(to_json(struct_pack({', '.join(f'{n} := {e}' for n, e in _EVENT_COLUMNS.items())}))::VARCHAR) AS h FROM ev)
SELECT count(*) AS row_count, sha256(concat_ws('|', count(*)::VARCHAR, {', '.join(_SLICES)})) AS digest FROM h"""
DENSE_GROUPS = [*GROUPS, *[n for n in SEQ_GROUPS if n != "baseline_transform"]]


# Alerts: group number of _META -> (correlation group, scope dimension); windows in microseconds.
_CORRELATION = {0: ("automation_timing", "source"), 1: ("credential_guessing_single_target", "user"), 2: ("location_movement", "user"),
                3: ("session_anomaly", "user"), 4: ("source_fanout", "source")}
_CATEGORY = {c: _CORRELATION[g] for c, _, g, _ in _META.values()}
_GROUPING, _COOLDOWN, _LIMIT_WINDOW, _LIMIT = 900_000_000, 1_800_000_000, 3_600_000_000, 5
_ALERT_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "authwatch/detection/alert").hex


def alert_steps(scoped: bool) -> str:
    """``st``: each qualifying row in its turn, with what the state machine did (act), for which alert (owner: its first row)."""
    kind = "CASE primary_attack_category {} END".format(" ".join(f"WHEN '{c}' THEN '{d}'" for c, (_, d) in _CATEGORY.items()))
    kind, value = (kind, f"CASE {kind} WHEN 'user' THEN user_id ELSE source_id END") if scoped else ("'none'", "''")
    risk = RISK.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{risk}, rl AS (SELECT event_id, list_sort(list(rule_id)) AS rules FROM re WHERE status = 'fired' GROUP BY 1),
qn AS (SELECT rk.event_id, rk.us, primary_attack_category AS cat, {kind} AS kind, {value} AS val, risk_score, rules,
  CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS rank,
  row_number() OVER (PARTITION BY primary_attack_category, {kind}, {value} ORDER BY rk.us, rk.event_id) AS rn
  FROM rk JOIN rl USING (event_id) JOIN ev USING (event_id) WHERE fired_rule_count > 0 AND risk_score >= 10),
st AS (
  SELECT DISTINCT cat, kind, val, 0::BIGINT AS rn, NULL::BIGINT AS a, NULL::BIGINT AS a_last, NULL::INT AS a_cur, NULL::DOUBLE AS a_peak,
    NULL::BIGINT AS c, NULL::BIGINT AS c_last, NULL::INT AS c_cur, NULL::DOUBLE AS c_peak, NULL::BIGINT AS s_us, 0::INT AS s_n,
    NULL::VARCHAR AS act, NULL::BIGINT AS owner, 0::INT AS steps FROM qn
  UNION ALL
  SELECT cat, kind, val, n, CASE WHEN act IN ('open', 'join') THEN coalesce(b, n) END, CASE WHEN act IN ('open', 'join') THEN us END,
    CASE act WHEN 'open' THEN rank WHEN 'join' THEN greatest(a_cur, rank) END, CASE act WHEN 'open' THEN risk WHEN 'join' THEN greatest(a_peak, risk) END,
    d, d_last, d_cur, d_peak, CASE WHEN act = 'open' AND fresh THEN us ELSE s_us END,
    CASE WHEN act <> 'open' THEN s_n WHEN fresh THEN 1 ELSE s_n + 1 END, act,
    CASE WHEN act IN ('open', 'join') THEN coalesce(b, n) ELSE d END,
    CASE WHEN act = 'join' AND rank > a_cur OR act = 'open' AND rising THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN b IS NOT NULL THEN 'join' WHEN cooling AND NOT rising THEN 'cooldown' WHEN NOT fresh AND s_n >= {_LIMIT} THEN 'rate_limit' ELSE 'open' END AS act
    FROM (SELECT *, s_us IS NULL OR us - s_us > {_LIMIT_WINDOW} AS fresh, coalesce(b IS NULL AND us - d_last <= {_COOLDOWN}, false) AS cooling,
        coalesce(b IS NULL AND us - d_last <= {_COOLDOWN} AND (rank > d_cur OR risk > d_peak), false) AS rising
      FROM (SELECT st.cat, st.kind, st.val, q.rn AS n, q.us, q.rank, q.risk_score AS risk, a_cur, a_peak, s_us, s_n,
          CASE WHEN q.us - a_last <= {_GROUPING} THEN a END AS b, CASE WHEN q.us - a_last > {_GROUPING} THEN a ELSE c END AS d,
          CASE WHEN q.us - a_last > {_GROUPING} THEN a_last ELSE c_last END AS d_last, CASE WHEN q.us - a_last > {_GROUPING} THEN a_cur ELSE c_cur END AS d_cur,
          CASE WHEN q.us - a_last > {_GROUPING} THEN a_peak ELSE c_peak END AS d_peak
        FROM st JOIN qn q ON q.cat = st.cat AND q.kind = st.kind AND q.val = st.val AND q.rn = st.rn + 1)))
)"""


def alert_query(scoped: bool) -> str:
    group = "CASE cat {} END".format(" ".join(f"WHEN '{c}' THEN '{g}'" for c, (g, _) in _CATEGORY.items()))
    names = "CASE {} WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END"
    return f"""{alert_steps(scoped)}, al AS (
  SELECT cat, kind, val, owner, {group} AS grp, min(us) FILTER (WHERE act IN ('open', 'join')) AS first_us, max(us) FILTER (WHERE act IN ('open', 'join')) AS last_us,
    count(*) FILTER (WHERE act IN ('open', 'join')) AS n, sum(round(risk_score * 10000)::BIGINT) FILTER (WHERE act IN ('open', 'join'))::BIGINT AS units,
    max(risk_score) FILTER (WHERE act IN ('open', 'join')) AS peak, max(rank) FILTER (WHERE act = 'open') AS initial, max(rank) FILTER (WHERE act IN ('open', 'join')) AS cur,
    sum(CASE WHEN act = 'join' THEN steps ELSE 0 END)::BIGINT AS esc, count(*) FILTER (WHERE act NOT IN ('open', 'join')) AS sup,
    list_sort(list_distinct(flatten(list(rules) FILTER (WHERE act IN ('open', 'join'))))) AS rules
  FROM st JOIN qn USING (cat, kind, val, rn) WHERE owner IS NOT NULL GROUP BY ALL),
ids AS (SELECT *, sha1(unhex('{_ALERT_SPACE}') || encode(concat_ws('|', '1.0.0', cat, grp, kind, val, first_us::VARCHAR))) AS h FROM al)
SELECT '1.0.0' AS detection_schema_version, cat AS attack_category, grp AS correlation_group, CASE kind WHEN 'none' THEN 'category_scoped' ELSE 'entity_scoped' END AS grouping_mode,
  kind AS scope_kind, CASE WHEN kind <> 'none' THEN val END AS scope_value, first_us, last_us, n AS contributing_event_count, array_to_string(rules, ',') AS contributing_rule_ids,
  least((units // n + CASE WHEN 2 * (units % n) > n OR 2 * (units % n) = n AND (units // n) % 2 = 1 THEN 1 ELSE 0 END)::DOUBLE / 10000, peak) AS aggregate_risk_score, peak AS peak_risk_score, {names.format('initial')} AS initial_severity,
  {names.format('cur')} AS current_severity, esc AS escalation_count, sup AS suppressed_event_count,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4 + 1), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS alert_id
FROM ids"""


def alert_metrics_query() -> str:
    return f"""{alert_steps(False)}{EVAL[len(RISK):]}, al AS (SELECT cat, owner, min(us) AS a, max(us) AS b FROM st JOIN qn USING (cat, kind, val, rn) WHERE act IN ('open', 'join') GROUP BY ALL),
jd AS (SELECT al.cat, owner, count(*) AS n, count(*) FILTER (WHERE malicious) AS bad FROM al JOIN lb ON lb.primary_attack_category = al.cat AND lb.us BETWEEN a AND b GROUP BY ALL),
cv AS (SELECT count(*) AS covered FROM lb WHERE malicious AND EXISTS (SELECT 1 FROM al WHERE al.cat = lb.primary_attack_category AND lb.us BETWEEN a AND b)),
tt AS (SELECT count(*) AS events, count(*) FILTER (WHERE malicious AND fired_rule_count > 0) AS detectable, sum(fired_rule_count) AS fired FROM lb),
ac AS (SELECT count(*) AS alerts, count(*) FILTER (WHERE 2 * bad > n) AS correct FROM jd)
SELECT 'overall' AS part, events, alerts, detectable, round(correct::DOUBLE / alerts, 6) AS alert_precision, round(covered::DOUBLE / detectable, 6) AS alert_recall,
  round(1000.0 * alerts / events, 6) AS alerts_per_thousand_events, round(fired::DOUBLE / alerts, 6) AS duplicate_reduction_ratio FROM tt, cv, ac"""


_FAMILY = {"PAD-BF-001": "brute_force", "PAD-BF-002": "brute_force", "PAD-DBF-001": "brute_force", "PAD-PS-001": "spraying", "PAD-CS-001": "stuffing",
           "PAD-ATO-001": "account_compromise", "PAD-MFA-001": "account_compromise", "PAD-GEO-001": "location", "PAD-BOT-001": "automation"}


def detection_report_query() -> str:
    family = "CASE rule_id {} END".format(" ".join(f"WHEN '{r}' THEN '{f}'" for r, f in _FAMILY.items()))
    severity = "CASE sev WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END"
    dims = {"rule_id": "rule_id", "rule_family": family, "attack_category": "category", "severity": severity}
    parts = [f"SELECT 'detections_by_{d}' AS section, {e} AS name, count(*)::DOUBLE AS value FROM fd GROUP BY 2" for d, e in dims.items()]
    parts.append("SELECT 'assessments_by_severity', severity, count(*)::DOUBLE FROM rk GROUP BY 2")
    for section, table, column in (("risk_score", "(SELECT * FROM rk WHERE fired_rule_count > 0)", "risk_score"), ("signal_strength", "fd", "s"),
                                   ("alert_peak_risk", "al", "peak"), ("alert_size", "al", "n")):
        for name, e in (("count", "count({})"), ("min", "min({})"), ("median", "quantile_disc({}, 0.5)"), ("mean", "avg({})"),
                        ("p90", "quantile_disc({}, 0.9)"), ("max", "max({})")):
            parts.append(f"SELECT '{section}', '{name}', round(({e.format(column)})::DOUBLE, 6) FROM {table}")
    parts.append("SELECT 'suppressed', act, count(*)::DOUBLE FROM st WHERE act IN ('cooldown', 'rate_limit') GROUP BY 2")
    parts.append("SELECT 'suppressed', 'below_score_floor', count(*)::DOUBLE FROM rk WHERE fired_rule_count > 0 AND risk_score < 10 HAVING count(*) > 0")
    return f"""{alert_steps(False)}, fd AS (SELECT * FROM re WHERE status = 'fired'),
al AS (SELECT max(risk_score) AS peak, count(*) AS n FROM st JOIN qn USING (cat, kind, val, rn) WHERE act IN ('open', 'join') GROUP BY cat, kind, val, owner)
""" + " UNION ALL ".join(parts)


def accounting_query() -> str:
    return f"""{alert_steps(False)} SELECT (SELECT count(*) FROM qn) AS qualifying,
  (SELECT count(*) FROM rk WHERE fired_rule_count > 0 AND risk_score < 10) AS below_score_floor, 0::BIGINT AS below_severity_floor,
  count(*) FILTER (WHERE act = 'open') AS alert_count, count(*) FILTER (WHERE act IN ('open', 'join')) AS grouped, count(*) FILTER (WHERE act = 'cooldown') AS cooldown,
  count(*) FILTER (WHERE act = 'rate_limit') AS rate_limit, sum(steps)::BIGINT AS escalated, 0::BIGINT AS entity_scoped FROM st WHERE act IS NOT NULL"""


def mean_bounds_query() -> str:
    """Alerts with a planted mean, against every score of their category in their time range."""
    return f"""{alert_query(False).rsplit("SELECT '1.0.0' AS detection_schema_version", 1)[0]}, fin AS (SELECT '1.0.0' AS detection_schema_version{alert_query(False).rsplit("SELECT '1.0.0' AS detection_schema_version", 1)[1]}),
pl AS (SELECT alert_id, attack_category, first_us, last_us, CASE contributing_event_count % 3 WHEN 0 THEN aggregate_risk_score + 60 WHEN 1 THEN aggregate_risk_score - 0.0005::DOUBLE ELSE aggregate_risk_score END AS m FROM fin)
SELECT alert_id, attack_category, round(m, 4) AS aggregate_risk_score, round(min(risk_score), 4) AS least, round(max(risk_score), 4) AS greatest,
  coalesce(m >= min(risk_score) - 1e-3::DOUBLE AND m <= max(risk_score) + 1e-3::DOUBLE, true) AS plausible
FROM pl LEFT JOIN rk ON primary_attack_category = attack_category AND us BETWEEN first_us AND last_us GROUP BY alert_id, attack_category, m"""


def audit_query() -> str:
    """Violations of each check, counted from the planted faults."""
    counts = {
        "NO_GROUND_TRUTH_COLUMNS": "2", "NO_CAMPAIGN_COLUMNS": "1", "NO_SPLIT_COLUMNS": "1",
        "NO_FUTURE_CONTRIBUTION": "(SELECT count(*) FROM p WHERE user_id = (SELECT user_id FROM p ORDER BY us DESC, event_id DESC LIMIT 1))",
        "NO_SAME_TIMESTAMP_CONTRIBUTION": "(SELECT count(*) FROM p, mid WHERE p.user_id = mid.user_id AND p.us <= mid.us)",
        "BASELINE_SOURCE_FINGERPRINT_MATCHES_TRAIN": "1", "BASELINE_NOT_FIT_ON_EVALUATION_DATA": "(SELECT count(*) FROM p WHERE split = 'test')",
        "PURGE_INTERVAL_RESPECTED": f"(SELECT count(*) FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.split <> a.split AND b.us >= a.us - {micros('7d')} AND b.us < a.us))",
        "CAMPAIGN_GROUPS_ISOLATED": "(SELECT count(*) FROM (SELECT campaign_id FROM p WHERE scenario <> 'normal' GROUP BY 1 HAVING count(DISTINCT split) > 1))",
        "HOLDOUT_EXCLUDED_FROM_SUPERVISED": "(SELECT count(*) FROM p WHERE scenario = 'novel_anomaly_holdout')",
        "CURRENT_VS_PRIOR_FIELDS_DISTINGUISHED": "0", "JOIN_KEY_INTEGRITY": "(SELECT count(*) FROM p WHERE scenario = 'normal')"}
    rows = " UNION ALL ".join(f"SELECT '{name}' AS name, {expr}::BIGINT AS n" for name, expr in counts.items())
    return f"""WITH {EV}, {TRUTH}, p AS (SELECT ev.event_id, us, user_id, scenario, campaign_id,
  CASE WHEN us // 864000000000 <= 1972 THEN 'train' WHEN us // 864000000000 = 1973 THEN 'validation' ELSE 'test' END AS split FROM ev JOIN gt USING (event_id)),
ctr AS (SELECT us FROM p ORDER BY us, event_id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM p)), mid AS (SELECT user_id, us FROM p WHERE us = (SELECT us FROM ctr) ORDER BY event_id LIMIT 1),
c AS ({rows}) SELECT name AS "check", CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END AS status, n AS violations FROM c"""


# Labelled rows once for 'overall' and once for their split.
PARTS = f"""{SPLIT[len(f'WITH {EV}, {TRUTH}'):]}, ls AS (SELECT lb.*, sa.split FROM lb JOIN sa USING (event_id)),
lp AS (SELECT 'overall' AS part, * FROM ls UNION ALL SELECT split, * FROM ls)"""
_CLASS_ROWS = f"""cs AS (SELECT unnest([{_CL}]) AS class), mm AS (SELECT part, class, count(*) FILTER (WHERE actual = class) AS support,
  count(*) FILTER (WHERE predicted = class) AS predicted_n, count(*) FILTER (WHERE actual = class AND predicted = class) AS tp FROM cs, lp GROUP BY 1, 2),
pf AS (SELECT part, class, support, predicted_n AS predicted, tp AS true_positives, tp::DOUBLE / nullif(predicted_n, 0) AS precision, tp::DOUBLE / nullif(support, 0) AS recall,
  CASE WHEN tp > 0 THEN 2.0 * tp / (predicted_n + support) END AS f1 FROM mm)"""


def split_metric_queries() -> dict[str, str]:
    rows = f"{EVAL}{PARTS}"
    shares = {"false_positive_rate": ("NOT malicious AND fired_rule_count > 0", "NOT malicious"), "detection_rate": ("malicious AND fired_rule_count > 0", "malicious")}
    rates = ", ".join(f"round(count(*) FILTER (WHERE {a})::DOUBLE / nullif(count(*) FILTER (WHERE {b}), 0), 6) AS {n}" for n, (a, b) in shares.items())
    means = ", ".join(f"round(avg({m}), 6) AS macro_{m}, round(sum({m} * support) / nullif(sum(support) FILTER (WHERE {m} IS NOT NULL), 0), 6) AS weighted_{m}"
                      for m in ("precision", "recall", "f1"))
    predicted = ", ".join(f"count(*) FILTER (WHERE predicted = '{c}') AS predicted_{c}" for c in [*_CLS, "none"])
    return {
        "eval_rates_by_split": f"{rows} SELECT part, count(*) AS events, count(*) FILTER (WHERE malicious) AS malicious, count(*) FILTER (WHERE NOT malicious) AS benign, {rates}, round(sum(insufficient_data_count)::DOUBLE / count(*), 6) AS insufficient_data_rate FROM lp GROUP BY 1",
        "eval_scenario_rates_by_split": f"{rows} SELECT part, scenario AS attack_class, count(*) AS events, round(avg((fired_rule_count > 0)::INT), 6) AS detection_rate FROM lp WHERE malicious GROUP BY 1, 2",
        "eval_confusion_by_split": f"{rows} SELECT part, actual, {predicted} FROM lp GROUP BY 1, 2",
        "eval_class_metrics_by_split": f"{rows}, {_CLASS_ROWS} SELECT part, class, support, predicted, true_positives, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pf",
        "eval_class_summary_by_split": f"{rows}, {_CLASS_ROWS} SELECT part, {means} FROM pf GROUP BY 1",
        "eval_alert_metrics_by_split": f"""{alert_steps(False)}{EVAL[len(RISK):]}{PARTS}, al AS (SELECT cat, owner, min(us) AS a, max(us) AS b FROM st JOIN qn USING (cat, kind, val, rn) WHERE act IN ('open', 'join') GROUP BY cat, owner),
pn AS (SELECT DISTINCT part FROM lp), jd AS (SELECT pn.part, cat, owner, count(lp.event_id) AS n, count(lp.event_id) FILTER (WHERE malicious) AS bad
  FROM pn CROSS JOIN al LEFT JOIN lp ON lp.part = pn.part AND primary_attack_category = cat AND us BETWEEN a AND b GROUP BY 1, 2, 3),
ac AS (SELECT part, count(*) AS alerts, count(*) FILTER (WHERE 2 * bad > n) AS correct FROM jd GROUP BY 1),
cv AS (SELECT part, count(*) AS covered FROM lp WHERE malicious AND EXISTS (SELECT 1 FROM al WHERE cat = primary_attack_category AND us BETWEEN a AND b) GROUP BY 1),
tt AS (SELECT part, count(*) AS events, count(*) FILTER (WHERE malicious AND fired_rule_count > 0) AS detectable, sum(fired_rule_count)::BIGINT AS fired FROM lp GROUP BY 1)
SELECT part, events, alerts, detectable, round(correct::DOUBLE / alerts, 6) AS alert_precision, round(coalesce(covered, 0)::DOUBLE / nullif(detectable, 0), 6) AS alert_recall,
  round(1000.0 * alerts / events, 6) AS alerts_per_thousand_events, round(fired::DOUBLE / alerts, 6) AS duplicate_reduction_ratio FROM tt JOIN ac USING (part) LEFT JOIN cv USING (part)"""}


def scoring_queries() -> dict[str, str]:
    """Detections of even anchors stand there twice; an anchor in a hundred is known by its detections only."""
    assessed = "event_id::BIGINT % 100 <> 1 OR event_id IN (SELECT event_id FROM gm)"
    return {
        "scoring_counters": f"""{RISK} SELECT (SELECT count(*) FROM ev WHERE {assessed}) AS assessment_count, count(*) AS scored_detection_count,
  count(*) FILTER (WHERE event_id::BIGINT % 2 = 0) AS duplicate_detection_count, (SELECT count(*) FROM gm) AS group_reductions FROM re WHERE status = 'fired'""",
        "risk_from_detections": f"""{RISK} SELECT event_id AS anchor_event_id, us AS anchor_us, round(risk_score, 4) AS risk_score, severity,
  primary_attack_category, fired_rule_count FROM rk WHERE {assessed}"""}


def relations_query() -> str:
    """Counts of the planted misfits."""
    def share(modulus: int, rest: int) -> str:
        return f"(SELECT count(*) FROM ev WHERE event_id::BIGINT % {modulus} = {rest})"

    counts = {
        "ORPHANED_DETECTION_ANCHORS": "(SELECT count(DISTINCT event_id) FROM re WHERE status = 'fired' AND rule_id <> 'PAD-BF-002' AND event_id::BIGINT % 10 = 3)",
        "REPEATED_ASSESSMENTS": share(10, 5), "ASSESSMENTS_OUTSIDE_ANCHORS": share(100, 1), "ANCHORS_WITHOUT_ASSESSMENT": share(10, 3), "REPEATED_ANCHORS": "0",
        "ASSESSMENTS_OUTSIDE_SCOPE": share(100, 7), "SCOPE_WITHOUT_ASSESSMENT": share(10, 3), "REPEATED_SCOPE": "0",
        "DANGLING_ALERT_RULES": "(SELECT count(*) FROM al WHERE list_contains(rules, 'PAD-BF-002'))",
        "UNEXPECTED_ALERT_SCOPE": "(SELECT count(*) FROM al WHERE kind <> 'none')", "MANIFEST_DIFFERS": "0"}
    head = alert_query(True).rsplit("ids AS (SELECT", 1)[0].rstrip().rstrip(",")
    return head + " " + " UNION ALL ".join(f"SELECT '{name}' AS \"check\", {expr}::BIGINT AS violations" for name, expr in counts.items())


def ingest_counts(broken: str) -> str:
    """Rows that pass, and rows refused by code and field; ``broken``: the condition of lines that are no records."""
    return f"""WITH {EV}, x AS (SELECT *, CASE WHEN {broken} THEN 'I005' WHEN event_id::BIGINT % 50 = 1 THEN 'I003'
  WHEN event_id::BIGINT % 50 = 0 OR mfa_outcome = 'bypassed' AND authentication_outcome NOT IN ('success', 'failure') THEN 'I002' ELSE 'accepted' END AS outcome FROM ev)
SELECT outcome, CASE outcome WHEN 'I003' THEN 'user_id' WHEN 'I002' THEN CASE WHEN event_id::BIGINT % 50 = 0 THEN 'response_time_ms' ELSE 'mfa_outcome' END END AS field, count(*) AS n_rows,
       CASE outcome WHEN 'accepted' THEN sum(response_time_ms)::BIGINT END AS total_ms, CASE outcome WHEN 'accepted' THEN count(DISTINCT user_id) END AS users
FROM x GROUP BY outcome, field"""


def oracles() -> dict[str, str]:
    out = {name: windowed(cols) for name, cols in GROUPS.items()}
    for name, cols in SEQ_GROUPS.items():
        head, table = (ALL, "bx") if name == "baseline_transform" else (STAGES, "gf")
        out[name] = f"{head} SELECT event_id AS anchor_event_id, {', '.join(shown(c) for c in cols)} FROM {table}"
    hour, day = "hour(ts)", "(isodow(ts) - 1)"
    out["calendar"] = f"WITH {EV} SELECT event_id AS anchor_event_id, {hour}::BIGINT AS hour_of_day, {day}::BIGINT AS day_of_week, {day} >= 5 AS is_weekend, " + ", ".join(
        f"round({fn}({v} * 2 * pi() / {p}), 6) AS {n}_{fn}" for n, v, p in (("hour", hour, 24.0), ("day_of_week", day, 7.0)) for fn in ("sin", "cos")) + " FROM ev"
    out["current_context"] = f"WITH {EV} SELECT event_id AS anchor_event_id, authentication_outcome AS current_authentication_outcome, authentication_method AS current_authentication_method, mfa_outcome AS current_mfa_outcome, client_type AS current_client_type, response_time_ms AS current_response_time_ms, country_code AS current_country_code, true AS current_has_device, lat IS NOT NULL AS current_has_location FROM ev"
    r = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    ref = f"WITH {EV}, {REF}"
    out["baseline_user"] = f"{ref}, {UB}, {HIST} SELECT user_id, event_count, {r('success_rate', 'event_rate_per_hour', 'response_time_mean_ms', 'response_time_std_ms', 'centroid_latitude', 'centroid_longitude')}, located_event_count, round((coalesce((SELECT hn FROM hi WHERE hi.user_id = ub.user_id AND hr = 12), 0) + 1.0) / (event_count + 24.0), 6) AS noon_share FROM ub"
    out["baseline_source"] = f"{ref}, {SB} SELECT source_id, event_count, targeted_user_count, distinct_client_type_count, distinct_user_agent_count, {r('success_rate', 'event_rate_per_hour', 'response_time_mean_ms', 'response_time_std_ms', 'client_type_entropy', 'user_agent_entropy')} FROM sb"
    out["baseline_known_sets"] = f"{ref}, {KNOWN} SELECT user_id, set_name, value, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY user_id, set_name ORDER BY occurrences DESC, value) AS rn FROM kn) WHERE rn <= 3"
    out["baseline_interarrival"] = f"{ref}, gp AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS g FROM ref) SELECT user_id, quantile_disc(g, 0.5)::BIGINT AS median_us, quantile_disc(g, 0.9)::BIGINT AS p90_us FROM gp WHERE g IS NOT NULL GROUP BY 1"
    out["split_assign"] = f"{SPLIT} SELECT event_id, split, exclusion_reason FROM sa"
    reasons = ", ".join(f"count(*) FILTER (WHERE exclusion_reason = '{x}') AS {x}" for x in ("after_test_end", "campaign_crosses_split_boundary", "purged_after_boundary", "embargoed_before_boundary"))
    out["split_manifest"] = f"{SPLIT} SELECT split, count(*) AS events, count(*) FILTER (WHERE scenario != 'normal') AS malicious, count(*) FILTER (WHERE scenario = 'normal') AS benign, 0::BIGINT AS unlabelled, {reasons}, count(DISTINCT campaign_id) FILTER (WHERE scenario != 'normal') AS campaigns FROM sa GROUP BY 1"
    out["split_scenarios"] = f"{SPLIT} SELECT split, scenario, count(*) AS events FROM sa GROUP BY 1, 2"
    out["purge_check"] = f"{SPLIT}, sv AS (SELECT us, split FROM sa WHERE split IN ('train', 'validation', 'test')), pv AS (SELECT a.split, EXISTS (SELECT 1 FROM sv b WHERE b.split != a.split AND b.us >= a.us - {micros('7d')} AND b.us < a.us) AS bad FROM sv a) SELECT split, count(*) AS events, count(*) FILTER (WHERE bad) AS violations FROM pv GROUP BY 1"
    out["campaign_isolation"] = f"WITH {EV}, {TRUTH}, t AS (SELECT gt.campaign_id, count(DISTINCT CASE WHEN us // 864000000000 <= 1972 THEN 1 WHEN us // 864000000000 = 1973 THEN 2 ELSE 3 END) AS splits FROM ev JOIN gt USING (event_id) WHERE scenario != 'normal' GROUP BY 1) SELECT campaign_id, splits FROM t WHERE splits > 1"
    for rule_id in RULE:
        out["rule_" + rule_id[4:-4].lower() + ("2" if rule_id.endswith("002") else "")] = rule_query(rule_id)
    out["rule_status_counts"] = f"{SNAP}, {RES} SELECT rule_id, status, count(*) AS anchors FROM re GROUP BY 1, 2"
    out["detections"] = f"{SNAP}, {RES} SELECT event_id AS anchor_event_id, rule_id, category AS attack_category, round(s, 6) AS signal_strength FROM re WHERE status = 'fired'"
    out["risk_scores"] = f"{RISK} SELECT event_id AS anchor_event_id, round(risk_score, 4) AS risk_score, severity, primary_attack_category, fired_rule_count, insufficient_data_count FROM rk"
    out["severity_distribution"] = f"{RISK} SELECT severity, count(*) AS anchors, count(*) FILTER (WHERE fired_rule_count = 0) AS zero_scores, sum(fired_rule_count)::BIGINT AS scored_detections FROM rk GROUP BY 1"
    out["alert_gates"] = f"{RISK} SELECT CASE WHEN risk_score < 10 THEN 'below_score_floor' ELSE 'qualifying' END AS gate, primary_attack_category, count(*) AS assessments FROM rk WHERE fired_rule_count > 0 GROUP BY 1, 2"
    out["alert_totals"] = f"{RISK} SELECT primary_attack_category AS attack_category, count(*) AS qualifying FROM rk WHERE fired_rule_count > 0 AND risk_score >= 10 GROUP BY 1"
    out["eval_confusion"] = f"{EVAL} SELECT actual, {', '.join(f'''count(*) FILTER (WHERE predicted = '{c}') AS predicted_{c}''' for c in [*_CLS, 'none'])} FROM lb GROUP BY 1"
    out["eval_rates"] = f"{EVAL} SELECT count(*) AS events, count(*) FILTER (WHERE malicious) AS malicious, count(*) FILTER (WHERE NOT malicious) AS benign, round(count(*) FILTER (WHERE NOT malicious AND fired_rule_count > 0)::DOUBLE / count(*) FILTER (WHERE NOT malicious), 6) AS false_positive_rate, round(count(*) FILTER (WHERE malicious AND fired_rule_count > 0)::DOUBLE / count(*) FILTER (WHERE malicious), 6) AS detection_rate, round(sum(insufficient_data_count)::DOUBLE / count(*), 6) AS insufficient_data_rate FROM lb"
    out["eval_scenario_rates"] = f"{EVAL} SELECT scenario AS attack_class, count(*) AS events, round(avg((fired_rule_count > 0)::INT), 6) AS detection_rate FROM lb WHERE malicious GROUP BY 1"
    out["eval_class_metrics"] = f"{EVAL}, cs AS (SELECT unnest([{_CL}]) AS class), mm AS (SELECT class, count(*) FILTER (WHERE actual = class) AS support, count(*) FILTER (WHERE predicted = class) AS predicted_n, count(*) FILTER (WHERE actual = class AND predicted = class) AS tp FROM cs, lb GROUP BY 1) SELECT class, support, predicted_n AS predicted, tp AS true_positives, round(tp::DOUBLE / nullif(predicted_n, 0), 6) AS precision, round(tp::DOUBLE / nullif(support, 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (predicted_n + support) END, 6) AS f1 FROM mm"
    out["eval_campaign_latency"] = f"{EVAL} SELECT campaign_id, count(*) AS events, round((min(us) FILTER (WHERE fired_rule_count > 0) - min(us)) / 1e6, 6) AS latency_seconds FROM lb WHERE malicious GROUP BY 1"
    ev = f"WITH {EV}"
    out["quality_events"] = f"{ev} SELECT count(*) AS row_count, (count(*) - count(DISTINCT event_id))::BIGINT AS duplicate_event_ids, min(us) AS first_us, max(us) AS last_us, round(count(*) / ((max(us) - min(us)) / 3.6e9), 6) AS event_rate_per_hour, count(DISTINCT user_id) AS unique_users, count(DISTINCT source_id) AS unique_sources, count(DISTINCT device_id) AS unique_devices, count(DISTINCT application_id) AS unique_applications, round(avg((mfa_outcome IS NULL)::INT), 6) AS null_rate_mfa_outcome, round(avg((country_code IS NULL)::INT), 6) AS null_rate_country_code FROM ev"
    out["quality_distributions"] = ev + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS events FROM ev WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("authentication_method", "authentication_outcome", "mfa_outcome", "country_code", "client_type")) + " UNION ALL SELECT 'failure_reason', CASE authentication_outcome WHEN 'failure' THEN 'invalid_credentials' ELSE 'rate_limited' END, count(*) FROM ev WHERE authentication_outcome IN ('failure', 'blocked') GROUP BY 2"
    out["quality_response_time"] = f"{ev} SELECT min(response_time_ms)::DOUBLE AS rt_min, max(response_time_ms)::DOUBLE AS rt_max, round(avg(response_time_ms), 6) AS rt_mean, round(quantile_cont(response_time_ms, 0.5), 6) AS rt_p50, round(quantile_cont(response_time_ms, 0.95), 6) AS rt_p95 FROM ev"
    out["quality_features"] = f"WITH {EV}, {GAPS}, q AS (SELECT {', '.join(f'{feature_sql(CAT[n])} AS {n}' for n in ('user_attempt_count__7d', 'user_failure_rate__1d', 'source_unique_user_count__7d'))} FROM evg) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg(({n} IS NULL)::INT), 6) AS null_rate, min({n})::DOUBLE AS min_value, max({n})::DOUBLE AS max_value, round(avg({n}), 6) AS mean_value, min({n}) = max({n}) AS zero_variance FROM q" for n in ('user_attempt_count__7d', 'user_failure_rate__1d', 'source_unique_user_count__7d'))
    out["quality_ground_truth"] = f"WITH {TRUTH} SELECT scenario, count(*) AS events, count(*) FILTER (WHERE scenario != 'normal') AS malicious, count(*) FILTER (WHERE scenario != 'novel_anomaly_holdout') AS eligible FROM gt GROUP BY 1"
    out["top_countries"] = f"{ev} SELECT country_code AS value, count(*) AS events FROM ev WHERE country_code IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
    out["validate_events"] = f"{ev}, v AS (SELECT count(*) FILTER (WHERE mfa_outcome = 'bypassed' AND authentication_outcome NOT IN ('success', 'failure')) AS v18, count(*) FILTER (WHERE NOT regexp_matches(session_id, '^sess:[0-9:]+$')) AS v19, count(*) FILTER (WHERE NOT (response_time_ms BETWEEN 0 AND 30000)) AS v16, (count(*) - count(DISTINCT event_id)) AS v6 FROM ev) SELECT 'V018' AS code, v18::BIGINT AS violations FROM v UNION ALL SELECT 'V019', v19::BIGINT FROM v UNION ALL SELECT 'V016', v16::BIGINT FROM v UNION ALL SELECT 'V006', v6::BIGINT FROM v"
    out["ingest_csv_files"] = ingest_counts("false")
    out["ingest_jsonl_files"] = ingest_counts("event_id::BIGINT % 50 = 2")
    out["snapshot_input"] = f"""WITH {EV}, n AS (SELECT event_id::BIGINT % 100 AS n FROM ev)
SELECT 'prohibited_column' AS problem, 1::BIGINT AS violations UNION ALL SELECT 'repeated_anchor', count(*) FROM n WHERE n = 0
UNION ALL SELECT 'wrong_version', count(*) FROM n WHERE n = 1 UNION ALL SELECT 'not_finite', count(*) FROM n WHERE n = 2"""
    out["join_integrity"] = f"{SPLIT} SELECT 0::BIGINT AS missing_from_features, count(*) FILTER (WHERE scenario = 'normal') AS missing_from_labels, count(*) FILTER (WHERE split = 'excluded') AS missing_from_splits, 0::BIGINT AS duplicated_in_features, 0::BIGINT AS duplicated_in_labels, 0::BIGINT AS duplicated_in_splits FROM sa"
    out["unreadable_files"] = f"{ev} SELECT authentication_outcome, count(*) AS events, count(DISTINCT event_id) AS ids, sum(response_time_ms)::BIGINT AS response_ms, 'V001' AS code, 1::BIGINT AS violations FROM ev GROUP BY 1"
    out["published_runs"] = " UNION ALL ".join([
        f"SELECT * FROM ({ev} SELECT 'all' AS run, 'auth_events' AS \"table\", count(*) AS row_count, sum(response_time_ms)::BIGINT AS total, 0::BIGINT AS differences FROM ev)",
        f"SELECT * FROM ({ev} SELECT 'failures', 'auth_events', count(*), sum(response_time_ms)::BIGINT, 0 FROM ev WHERE authentication_outcome = 'failure')",
        f"SELECT 'all', 'feature_snapshot', count(*), sum(user_attempt_count__7d)::BIGINT, 0 FROM ({out['win_user_counts']})",
        f"SELECT 'all', 'user_baselines', count(*), sum(event_count)::BIGINT, 0 FROM ({out['baseline_user']})",
        "SELECT 'all', 'late_commit', 0, 0, 0"])
    # events with the planted faults of event_findings: by remainder m, those of 15 twice; "bad" where any check of rows fails
    reason = ("CASE m WHEN 4 THEN 'weird' WHEN 16 THEN NULL ELSE CASE authentication_outcome WHEN 'failure' THEN 'invalid_credentials' "
              "WHEN 'blocked' THEN 'rate_limited' END END")
    faulty = f"""{ev}, twice AS (SELECT *, event_id::BIGINT % 40 AS m FROM ev UNION ALL SELECT *, 15 FROM ev WHERE event_id::BIGINT % 40 = 15),
fe AS (SELECT event_id, m, {reason} AS failure_reason, CASE m WHEN 3 THEN 'maybe' ELSE authentication_outcome END AS o,
 CASE m WHEN 5 THEN 'odd' ELSE mfa_outcome END AS mfa FROM twice),
fc AS (SELECT *, coalesce(mfa = 'bypassed' AND o NOT IN ('success', 'failure'), false) AS v18, coalesce(
 (o = 'success' AND failure_reason IS NOT NULL) OR (o = 'failure' AND failure_reason IS NULL) OR (o = 'blocked' AND (failure_reason IS NULL OR failure_reason = 'weird'))
 OR (o = 'challenged' AND failure_reason IS NOT NULL), false) AS v17 FROM fe)"""
    single = {1: ("V004", "schema_version"), 2: ("V008", "authentication_method"), 3: ("V009", "authentication_outcome"), 4: ("V010", "failure_reason"),
              5: ("V011", "mfa_outcome"), 6: ("V012", "client_type"), 7: ("V013", "country_code"), 8: ("V014", "coarse_latitude"),
              9: ("V015", "coarse_longitude"), 10: ("V016", "response_time_ms"), 11: ("V019", "user_id"), 12: ("V019", "source_id"),
              13: ("V019", "device_id"), 14: ("V019", "session_id"), 15: ("V006", "event_id")}
    found = [f"SELECT '{code}' AS code, '{field}' AS field, 'error' AS level, count(*) FILTER (WHERE m = {m}){' // 2' if m == 15 else ''} AS violations FROM fc"
             for m, (code, field) in single.items()]
    found += [f"SELECT '{code}', '{field}', 'error', count(*) FILTER (WHERE {c}) FROM fc" for code, field, c in (
        ("V017", "failure_reason", "v17"), ("V018", "mfa_outcome", "v18"), ("V002", "", "false"))]
    found += ["SELECT 'V005', 'scenario', 'error', 1", "SELECT 'V020', 'failure_reason', 'warning', (avg((failure_reason IS NULL)::INT) > 0.5)::BIGINT FROM fc"]
    found += [f"SELECT 'V020', '{c}', 'warning', {int(c in ('region_code', 'operating_system_family'))}" for c in (
        "schema_version", "event_id", "event_time", "user_id", "source_id", "device_id", "session_id", "application_id", "authentication_method",
        "authentication_outcome", "mfa_outcome", "country_code", "region_code", "coarse_latitude", "coarse_longitude", "user_agent_family",
        "operating_system_family", "client_type", "response_time_ms", "scenario")]
    out["event_findings"] = f"{faulty} " + " UNION ALL ".join(found)
    out["event_acceptance"] = f"""{faulty}, ids AS (SELECT event_id, count(*) AS n, bool_or(v17 OR v18 OR m BETWEEN 1 AND 14) AS bad FROM fc GROUP BY 1)
SELECT sum(1 - bad::INT)::BIGINT AS accepted, sum(n - 1 + bad::INT)::BIGINT AS rejected FROM ids"""
    # HMAC-SHA-256 with the key 00 01 .. 1f, by its two padded blocks
    inner, outer = (bytes(b ^ x for b in bytes(range(32)) + bytes(32)).hex() for x in (0x36, 0x5C))
    keyed = "'{0}:' || substr(sha256(unhex('{2}') || unhex(sha256(unhex('{3}') || encode('{1}:' || {4})))), 1, 32) AS {4}"
    out["pseudonyms"] = f"{ev} SELECT event_id::VARCHAR AS event_id, " + ", ".join(
        keyed.format(prefix, domain, outer, inner, column) for prefix, domain, column in (
            ("u", "user", "user_id"), ("s", "source", "source_id"), ("d", "device", "device_id"), ("sess", "session", "session_id"))) + " FROM ev"
    out["pseudonym_shape"] = f"{ev} SELECT count(DISTINCT user_id) AS users, count(DISTINCT source_id) AS sources, count(DISTINCT device_id) AS devices, count(DISTINCT session_id) AS sessions, 0::BIGINT AS malformed FROM ev"
    out |= {f"{n}_dense": out[n] for n in DENSE_GROUPS}
    parts = ["current_context", "calendar", *GROUPS, *SEQ_GROUPS]
    out["feature_snapshot"] = f"WITH {EV} SELECT * FROM (SELECT '1.0.0' AS feature_schema_version, event_id AS anchor_event_id, us AS anchor_event_us FROM ev) " + " ".join(
        f"JOIN ({out[n]}) q{i} USING (anchor_event_id)" for i, n in enumerate(parts))
    out["eval_campaigns"] = f"WITH c AS ({out['eval_campaign_latency']}) SELECT count(*) AS campaigns, count(latency_seconds) AS detected, count(*) - count(latency_seconds) AS missed, round(count(latency_seconds)::DOUBLE / count(*), 6) AS coverage, round(min(latency_seconds), 6) AS latency_min, round(quantile_disc(latency_seconds, 0.5), 6) AS latency_median, round(avg(latency_seconds), 6) AS latency_mean, round(quantile_disc(latency_seconds, 0.9), 6) AS latency_p90, round(max(latency_seconds), 6) AS latency_max FROM c"
    out["event_fingerprint"] = FINGERPRINT
    out |= split_metric_queries() | scoring_queries() | {"run_relations": relations_query()}
    out |= {"alerts": alert_query(False), "alerts_by_entity": alert_query(True), "alert_accounting": accounting_query(), "eval_alert_metrics": alert_metrics_query(), "leakage_audit_planted": audit_query(), "alert_mean_bounds": mean_bounds_query(),
            "detection_quality": detection_report_query()}
    return out
