import random

import pytest
from pyspark.sql import functions as F

from authwatch.config import AlertConfig, AuthwatchError, DetectionConfig, FeatureConfig
from authwatch.plans import rules
from authwatch.plans.alerts import AlertRun
from authwatch.plans.features import build_features
from authwatch.plans.rules import detections, evaluate_rules
from authwatch.plans.scoring import results_from_detections, score_results
from authwatch.schema import RISK_ASSESSMENTS, SEVERITIES, feature_catalog, feature_schema
from tests.streams import START, frame, parse

# Snapshot values that make exactly the named rule reach its verdict at default thresholds.
FIRING = {
    "PAD-BF-001": dict(pair_failure_count__5m=12, pair_failure_rate__5m=.95, user_failure_count__5m=14,
                       prior_consecutive_user_failures=9, source_unique_user_count__5m=1,
                       pair_mean_interarrival_seconds__5m=4.0, user_blocked_count__5m=3),
    "PAD-BF-002": dict(current_authentication_outcome="success", prior_failures_since_pair_success=9,
                       prior_failures_since_user_success=11, previous_user_outcome="failure",
                       seconds_since_user_previous_failure=20.0),
    "PAD-PS-001": dict(source_unique_user_count__1h=40, source_failure_count__1h=76, source_failure_rate__1h=.95,
                       source_attempt_count__1h=80),
    "PAD-CS-001": dict(source_unique_user_count__1h=30, source_success_count__1h=4, source_failure_count__1h=56,
                       source_attempt_count__1h=60, source_unique_device_count__1h=9,
                       source_unique_user_agent_count__1h=7, user_in_baseline=True, is_new_device_for_user=True,
                       is_new_country_for_user=True),
    "PAD-DBF-001": dict(user_unique_source_count__1h=24, user_failure_count__1h=60, user_failure_rate__1h=.96,
                        pair_attempt_count__1h=2, source_unique_user_count__1h=1),
    "PAD-ATO-001": dict(current_authentication_outcome="success", user_in_baseline=True, is_new_device_for_user=True,
                        is_new_country_for_user=True, is_new_source_for_user=False,
                        is_new_application_for_user=False, is_new_auth_method_for_user=False,
                        prior_failures_since_user_success=7),
    "PAD-GEO-001": dict(current_authentication_outcome="success", user_previous_success_geo__status="ok",
                        implied_velocity__status="ok", distance_km_from_user_previous_success=4204.0,
                        implied_velocity_kmh_from_previous_success=3600.0,
                        country_changed_since_previous_success=True),
    "PAD-BOT-001": dict(source_attempt_count__15m=90, source_interarrival_coefficient_of_variation__15m=0.0,
                        source_mean_interarrival_seconds__15m=10.0, source_unique_user_agent_count__1h=1,
                        source_unique_user_count__1h=5),
    "PAD-MFA-001": dict(user_attempt_count__15m=20, user_mfa_failure_count__15m=9, user_challenge_count__15m=10,
                        current_mfa_outcome="failed"),
}


def quiet(n, **values):
    row = {}
    for f in feature_catalog(FeatureConfig()):
        row[f.name] = None if f.nullable else {"int64": 0, "bool": False, "string": "x", "float64": 0.0}.get(f.dtype)
    row.update(anchor_event_id=f"a{n}", anchor_event_time=START, current_authentication_outcome="failure",
               user_previous_success_geo__status="no_prior_success", implied_velocity__status="unavailable")
    row.update(values)
    return row


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [quiet(i, **v) for i, v in enumerate(FIRING.values())]
    rows.append(quiet(99))
    schema = feature_schema(FeatureConfig())
    df = spark.createDataFrame([[r[f.name] for f in schema.fields] for r in rows], schema)
    return evaluate_rules(df).cache()


def test_every_rule_fires_on_its_row_only(verdicts):
    got = {r.anchor_event_id: {x.rule_id for x in r.results if x.status == "fired"} for r in verdicts.collect()}
    for i, rule_id in enumerate(FIRING):
        assert got[f"a{i}"] == {rule_id}
    assert got["a99"] == set()


def test_missing_history_is_reported_not_negative(verdicts):
    row = next(r for r in verdicts.collect() if r.anchor_event_id == "a99")
    status = {x.rule_id: (x.status, x.reason_codes) for x in row.results}
    assert status["PAD-PS-001"] == ("insufficient_data", ["INSUFFICIENT_HISTORY_SOURCE_FAILURE_RATE__1H"])
    assert status["PAD-MFA-001"][0] == "insufficient_data"
    assert status["PAD-GEO-001"] == ("not_fired", ["ANCHOR_DID_NOT_SUCCEED"])


def test_strength_and_evidence(verdicts):
    found = {r.rule_id: r for r in detections(verdicts).collect()}
    # users 40/15, failures 76/15 saturated, rate .95, attempts per user 2 against 3
    parts = (1.0 * ((40 / 15 - 1) / 2) + 0.8 * 1.0 + 0.6 * .95 + 0.6 * ((3 / 2 - 1) / 2)) / 3.0
    assert found["PAD-PS-001"].signal_strength == pytest.approx(0.15 + 0.85 * parts)
    geo = {e.evidence_code: e.observed_value for e in found["PAD-GEO-001"].evidence}
    assert geo["GEO_DISTANCE"] == "4200.0" and "GEO_COUNTRY_CHANGE" in geo
    assert len({r.detection_id for r in found.values()}) == 9


def test_scores_and_rebuild_from_table(verdicts):
    direct = {r.anchor_event_id: r for r in score_results(verdicts).collect()}
    strength = {r.anchor_event_id: r.signal_strength for r in detections(verdicts).collect()}
    assert direct["a99"].risk_score == 0.0 and direct["a99"].primary_attack_category is None
    assert direct["a2"].risk_score == pytest.approx(85 * strength["a2"], abs=1e-4)
    twice = detections(verdicts).unionByName(detections(verdicts))
    again = score_results(results_from_detections(twice, verdicts))
    assert {r.anchor_event_id: r.risk_score for r in again.collect()} == {k: r.risk_score for k, r in direct.items()}


def test_diagnostics_list_every_rule(verdicts):
    from authwatch.plans.rules import RULE_IDS, diagnostics

    some = DetectionConfig(enabled_rule_ids=("PAD-BF-001",))
    one = verdicts.selectExpr("anchor_event_id", "anchor_event_time",
                              "filter(results, r -> r.rule_id = 'PAD-BF-001') AS results")
    rows = diagnostics(one, some).where("anchor_event_id = 'a0'").collect()
    assert sorted(r.rule_id for r in rows) == sorted(RULE_IDS)
    assert {r.status for r in rows if r.rule_id != "PAD-BF-001"} == {"disabled"}
    assert diagnostics(verdicts).where("status = 'disabled'").isEmpty()


def test_rule_configuration_is_checked():
    from authwatch.plans.rules import build_rules

    with pytest.raises(AuthwatchError):
        build_rules(DetectionConfig(rules={"PAD-XX-001": {}}))
    with pytest.raises(AuthwatchError):
        build_rules(DetectionConfig(rules={"PAD-BF-001": {"nope": 1}}))


def assessment(n, us, score, category="brute_force"):
    import datetime as dt

    rank = 3 if score >= 85 else 2 if score >= 65 else 1 if score >= 40 else 0
    row = dict(detection_schema_version="1.0.0", anchor_event_id=f"a{n:06d}",
               anchor_event_time=START + dt.timedelta(microseconds=us), risk_score=score, severity=SEVERITIES[rank],
               primary_attack_category=category, contributing_categories=[category], fired_rule_count=1,
               fired_rule_ids=["PAD-BF-001" if n % 2 else "PAD-BF-002"], top_evidence=[],
               insufficient_data_count=0, scoring_version="1.0.0", configuration_fingerprint="x")
    return [row[f.name] for f in RISK_ASSESSMENTS.fields]


def plain_fold(rows, a):
    """The alert state machine event by event, for one key."""
    minute = 60 * 10**6
    group, cool, horizon = 15 * minute, 30 * minute, 60 * minute
    done, alert, closed, slot, refused = [], None, None, None, {"cooldown": 0, "rate_limit": 0}
    for us, _, score in sorted(rows):
        rank = 3 if score >= 85 else 2 if score >= 65 else 1 if score >= 40 else 0
        if alert and us - alert["last"] <= group:
            alert["n"] += 1
            alert["last"], alert["peak"] = us, max(alert["peak"], score)
            alert["sum"] += round(score * 10000)
            if rank > alert["rank"]:
                alert["rank"], alert["esc"] = rank, alert["esc"] + 1
            continue
        if alert:
            if closed:
                done.append(closed)
            closed, alert = alert, None
        if closed and us - closed["last"] <= cool and not (rank > closed["rank"] or score > closed["peak"]):
            closed["sup"] += 1
            refused["cooldown"] += 1
            continue
        if slot is None or us - slot[0] > horizon:
            slot = [us, 1]
        elif slot[1] >= a.max_alerts_per_group_per_window:
            if closed:
                closed["sup"] += 1
            refused["rate_limit"] += 1
            continue
        else:
            slot[1] += 1
        alert = dict(first=us, last=us, n=1, sum=round(score * 10000), peak=score, rank=rank, esc=0, sup=0)
    done += [x for x in (closed, alert) if x]
    return sorted((x["first"], x["last"], x["n"], x["peak"], SEVERITIES[x["rank"]], x["esc"], x["sup"],
                   x["sum"]) for x in done), refused


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_equal_the_event_by_event_fold(spark, seed):
    rng = random.Random(seed)
    minute = 60 * 10**6
    config = DetectionConfig(alerting=AlertConfig(max_alerts_per_group_per_window=2))
    rows, us = [], 0
    for n in range(400):
        # Dense stretches (long sessions with a tail), exact boundaries and long silences.
        us += rng.choice([0, minute // 2, minute, 5 * minute, 15 * minute, 15 * minute + 1, 20 * minute,
                          30 * minute, 61 * minute if n % 9 == 0 else minute])
        rows.append((us, f"a{n:06d}", round(rng.uniform(11, 99), 4)))
    df = spark.createDataFrame([assessment(n, r[0], r[2]) for n, r in enumerate(rows)], RISK_ASSESSMENTS)
    run = AlertRun(df.repartition(5), None, config)
    want, refused = plain_fold(rows, config.alerting)
    base = int(START.timestamp() * 10**6)
    got = sorted(
        (r.first_us - base, r.last_us - base, r.events, r.peak, SEVERITIES[r.current], r.escalations, r.suppressed,
         r.risk_units) for r in run.folded.where("row = 'alert'").collect())
    assert got == want
    totals = run.accounting.first()
    assert (totals.cooldown, totals.rate_limit) == (refused["cooldown"], refused["rate_limit"])
    assert totals.qualifying == totals.grouped + totals.cooldown + totals.rate_limit == 400
    assert run.alerts.count() == len(want)


def test_unfit_snapshots_are_refused(spark):
    config = DetectionConfig(enabled_rule_ids=("PAD-GEO-001",))
    columns = ["feature_schema_version", "anchor_event_id", "anchor_event_time", *rules.required_columns(config)]
    whole = build_features(frame(spark, parse("0 u1 s1 failure\n5 u1 s1 success")), FeatureConfig()).select(columns)
    assert rules.require_valid_snapshot(whole, config).count() == 2
    found = {(r.problem, r.subject): r.violations for r in rules.snapshot_findings(
        whole.unionByName(whole).withColumn("anchor_event_id", F.lit(" ")).withColumn("split", F.lit("train")).drop(columns[-1]), config).collect()}
    assert found == {("prohibited_column", "split"): 1, ("missing_column", columns[-1]): 1, ("empty_anchor", "anchor_event_id"): 4, ("repeated_anchor", "anchor_event_id"): 3}
    with pytest.raises(AuthwatchError, match="time_without_zone"):
        rules.require_valid_snapshot(whole.withColumn("anchor_event_time", F.col("anchor_event_time").cast("timestamp_ntz")), config)
