"""Synthetic authentication traffic: one hash-seeded DataFrame per scenario.

Every value is a function of (seed, scenario, campaign, step), so any executor
can rebuild any row; nothing is drawn on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AUTH_EVENTS, GROUND_TRUTH

GENERATOR_VERSION = "1.0.0"


@dataclass(frozen=True)
class SynthConfig:
    seed: int = 1337
    start: str = "2024-01-01T00:00:00Z"
    hours: int = 168
    users: int = 200
    sources: int = 50
    devices: int = 400
    applications: int = 5
    events_per_hour: int = 500
    campaigns: dict = field(default_factory=lambda: {s: 2 for s in SHAPES})


# scenario -> (steps, seconds between steps, variant); the shapes of section 2.17.
SHAPES = {
    "brute_force": (100, 2.0),
    "password_spraying": (120, 20.0),
    "credential_stuffing": (150, 0.5),
    "credential_stuffing_shared_source": (120, 0.5),
    "distributed_brute_force": (90, 5.0),
    "account_takeover_indicator": (4, 60.0),
    "impossible_travel": (2, 900.0),
    "bot_activity": (100, 0.1),
    "novel_anomaly_holdout": (3, 3600.0),
}
# Columns of a scenario as SQL over (c = campaign number, i = step, n = steps, h(..) = hash).
_OUTCOME = {
    "brute_force": "CASE WHEN i = n - 1 THEN 'success' WHEN i >= n / 2 THEN 'blocked' ELSE 'failure' END",
    "password_spraying": "'failure'",
    "credential_stuffing": "CASE WHEN r % 20 = 0 THEN 'success' ELSE 'failure' END",
    "credential_stuffing_shared_source": "CASE WHEN i % 10 = 9 THEN 'success' ELSE 'failure' END",
    "distributed_brute_force": "CASE WHEN i = n - 1 THEN 'success' ELSE 'failure' END",
    "account_takeover_indicator": "CASE WHEN i = n - 1 THEN 'success' ELSE 'failure' END",
    "impossible_travel": "'success'",
    "bot_activity": "CASE WHEN r % 4 = 0 THEN 'success' ELSE 'failure' END",
    "novel_anomaly_holdout": "CASE WHEN i % 2 = 0 THEN 'success' ELSE 'challenged' END",
}
_USER = {"password_spraying": "i % 40", "credential_stuffing": "i", "credential_stuffing_shared_source": "i % 60",
         "bot_activity": "i % 5"}
_SOURCE = {"credential_stuffing": "i", "distributed_brute_force": "i % 30"}


def _id(prefix: str, *parts: str) -> str:
    return f"concat('{prefix}:', substring(sha2(concat_ws('|', {', '.join(parts)}), 256), 1, 32))"


def _event_id(scenario: str) -> str:
    h = f"sha2(concat_ws('|', seed, '{scenario}', c, i), 256)"
    cut = lambda a, b: f"substring({h}, {a}, {b})"
    return f"concat_ws('-', {cut(1, 8)}, {cut(9, 4)}, {cut(13, 4)}, {cut(17, 4)}, {cut(21, 12)})"


def _finish(rows: DataFrame, scenario: str, label: str) -> DataFrame:
    return rows.selectExpr(
        "'1.0.0' AS schema_version", f"{_event_id(scenario)} AS event_id", "event_time",
        "user_id", "source_id", "device_id", f"{_id('sess', 'user_id', 'source_id', 'floor(i / 50)')} AS session_id",
        "concat('app-', lpad(cast(app as string), 2, '0')) AS application_id", "authentication_method",
        "authentication_outcome",
        "CASE authentication_outcome WHEN 'failure' THEN 'invalid_credentials' WHEN 'blocked' THEN 'account_locked' END "
        "AS failure_reason",
        "CASE WHEN authentication_outcome = 'challenged' THEN 'failed' ELSE 'not_required' END AS mfa_outcome",
        "country AS country_code", "cast(null as string) AS region_code", "lat AS coarse_latitude",
        "lon AS coarse_longitude", "agent AS user_agent_family", "'linux' AS operating_system_family",
        "client AS client_type", "rt AS response_time_ms",
        f"concat('{scenario}-', c) AS campaign_id", f"'{label}' AS scenario",
        f"{str(label != 'normal').lower()} AS malicious",
        f"{str(label != 'novel_anomaly_holdout').lower()} AS supervised_training_eligible",
        f"'{GENERATOR_VERSION}' AS generator_version",
        f"{'null' if scenario == label else repr(scenario)} AS scenario_variant",
        f"{'null' if label == 'normal' else repr('active')} AS campaign_stage",
    )


def _normal(spark: SparkSession, config: SynthConfig) -> DataFrame:
    n = config.events_per_hour * config.hours
    rows = spark.range(n).selectExpr(
        f"'{config.seed}' AS seed", "0L AS c", "id AS i", f"pmod(xxhash64({config.seed}, id), 1000000007) AS r",
        f"pmod(xxhash64({config.seed}, id, 't'), {config.hours * 3_600_000_000}L) AS offset",
        f"pmod(xxhash64({config.seed}, id, 'u'), {config.users}) AS u")
    rows = rows.selectExpr(
        "*", f"timestamp_micros(unix_micros(timestamp'{config.start}') + offset) AS event_time",
        f"{_id('u', 'seed', 'u')} AS user_id", f"{_id('s', 'seed', f'u % {config.sources}')} AS source_id",
        f"{_id('d', 'seed', f'u % {config.devices}')} AS device_id", f"r % {config.applications} AS app",
        "CASE WHEN u % 5 = 0 THEN 'sso' ELSE 'password' END AS authentication_method",
        "CASE WHEN r % 100 < 90 + u % 8 THEN 'success' WHEN r % 100 < 99 THEN 'failure' ELSE 'challenged' END "
        "AS authentication_outcome",
        "element_at(array('US', 'GB', 'JP', 'DE'), cast(u % 4 as int) + 1) AS country",
        "element_at(array(40.0D, 51.5D, 35.7D, 52.5D), cast(u % 4 as int) + 1) AS lat",
        "element_at(array(-74.0D, -0.1D, 139.7D, 13.4D), cast(u % 4 as int) + 1) AS lon",
        "concat('browser-', u % 3) AS agent", "'web_browser' AS client", "50 + r % 1951 AS rt")
    return _finish(rows, "normal", "normal")


def _attack(spark: SparkSession, config: SynthConfig, scenario: str) -> DataFrame:
    steps, gap = SHAPES[scenario]
    label = "credential_stuffing" if scenario.startswith("credential_stuffing") else scenario
    count = config.campaigns.get(scenario, 0)
    span = max(1, config.hours * 3600 - int(steps * gap) - 1)
    seed = config.seed
    rows = spark.range(count * steps).selectExpr(
        f"'{seed}' AS seed", f"id div {steps} AS c", f"id % {steps} AS i", f"{steps} AS n",
        f"pmod(xxhash64({seed}, '{scenario}', id), 1000000007) AS r",
        f"pmod(xxhash64({seed}, '{scenario}', id div {steps}, 'x'), 1000000007) AS k")
    rows = rows.selectExpr("*", f"(k + ({_USER.get(scenario, '0')})) % {config.users} AS u",
                           f"{_SOURCE.get(scenario, '0')} AS sx")
    far = "i % 2 = 1" if scenario == "impossible_travel" else "true"
    known = scenario in ("impossible_travel", "bot_activity")
    device = f"{_id('d', 'seed', f'u % {config.devices}')}" if known else (
        _id("d", "seed", f"'{scenario}'", "c", "i % 12" if scenario == "credential_stuffing_shared_source" else "sx"))
    diverse = "concat('browser-', i % 7)" if scenario == "credential_stuffing_shared_source" else "'script'"
    rows = rows.selectExpr(
        "*",
        f"timestamp_micros(unix_micros(timestamp'{config.start}') + (k % {span}) * 1000000L + cast(i * {gap * 1e6!r}D as bigint)) AS event_time",
        f"{_id('u', 'seed', 'u')} AS user_id", f"{_id('s', 'seed', f"'{scenario}'", 'c', 'sx')} AS source_id",
        f"{device} AS device_id", f"k % {config.applications} AS app", "'password' AS authentication_method",
        f"{_OUTCOME[scenario]} AS authentication_outcome",
        f"CASE WHEN {far} THEN 'BR' ELSE 'US' END AS country", f"CASE WHEN {far} THEN -23.5D ELSE 40.0D END AS lat",
        f"CASE WHEN {far} THEN -46.6D ELSE -74.0D END AS lon", f"{diverse} AS agent",
        f"'{'bot' if scenario == 'bot_activity' else 'api_client'}' AS client", "20 + r % 200 AS rt")
    return _finish(rows, scenario, label)


def generate(spark: SparkSession, config: SynthConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(auth_events, ground_truth)."""
    config = config or SynthConfig()
    rows = _normal(spark, config)
    for scenario in SHAPES:
        if config.campaigns.get(scenario, 0) > 0:
            rows = rows.unionByName(_attack(spark, config, scenario))
    return rows.select(*AUTH_EVENTS.names), rows.select(*GROUND_TRUTH.names)
