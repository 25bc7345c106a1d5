from dataclasses import replace

from authwatch.config import FeatureConfig, SkewConfig, SplitConfig
from authwatch.plans import audit, evaluate, quality, split, validate
from authwatch.plans.baseline import fit_baseline, load_baseline, save_baseline
from authwatch.plans.features import build_features
from authwatch.runtime import cut_lineage
from authwatch.schema import RISK_ASSESSMENTS, SECURITY_ALERTS
from tests.streams import START, frame, parse, random_rows
from tests.test_detection import assessment

CONFIG = FeatureConfig(
    windows=("5m", "1h"), cardinality_windows=("1h",), dispersion_windows=("1h",), device_session_windows=("5m",),
    pair_windows=("1h",), skew=SkewConfig(dense_rows=10**6),
    split=SplitConfig(train_fraction=.5, validation_fraction=.25, test_fraction=.25, purge="1h"))


def test_audit_passes_and_catches_a_leak(spark, tmp_path):
    rows = random_rows(11, n=60, span=3600 * 20)
    events = frame(spark, rows)
    labels = spark.createDataFrame(
        [(r["event_id"], f"n{r['event_id']}", "normal", False, True) for r in rows],
        "event_id string, campaign_id string, scenario string, malicious boolean, supervised_training_eligible boolean")
    assigned = cut_lineage(split.assign(events, labels, CONFIG.split))
    train = events.join(assigned.where("split = 'train'").select("event_id"), "event_id", "left_semi").select(*events.columns)
    fitted = fit_baseline(train, CONFIG.baseline, permitted=train)
    save_baseline(fitted, str(tmp_path / "baseline"), CONFIG.baseline)
    baseline = load_baseline(spark, str(tmp_path / "baseline"), CONFIG.baseline)
    snapshot = cut_lineage(build_features(events, CONFIG, baseline))
    report = {r.check: r.status for r in audit.audit(
        events, snapshot, CONFIG, labels, assigned, baseline, train).collect()}
    assert len(report) == 12 and set(report.values()) == {"passed"}, report
    # Without a purge the same split looks across its boundaries.
    loose = split.assign(events, labels, replace(CONFIG.split, purge="0s", strict_isolation=False))
    found = audit.purge_violations(events, loose, CONFIG.max_window_us).agg({"violations": "sum"}).first()[0]
    where = {r.event_id: r.split for r in loose.collect()}
    us = {r["event_id"]: (r["event_time"] - START).total_seconds() for r in rows}
    assert found == sum(any(where[a] != where[b] and 0 < us[a] - us[b] <= 3600 for b in us) for a in us)
    bad = snapshot.selectExpr(*[
        "CASE WHEN anchor_event_id = 'e000001' THEN -1 ELSE user_attempt_count__1h END AS user_attempt_count__1h"
        if c == "user_attempt_count__1h" else c for c in snapshot.columns])
    codes = {r.code for r in validate.validate_features(bad, CONFIG, labels).where("level = 'error' AND violations > 0").collect()}
    assert codes == {"F013", "F017"}
    assert audit.moved_rows(snapshot, bad, ["user_attempt_count__1h"]).count() == 1


def test_purge_ignores_simultaneous_events(spark):
    hour = 3600 * 10**6
    rows = [("a", 0, "train"), ("b", 0, "validation"), ("c", hour, "test"), ("d", 2 * hour + 1, "train"), ("e", -1, "test")]
    events = spark.createDataFrame([r[:2] for r in rows], "event_id string, us bigint").selectExpr("event_id", "timestamp_micros(us) AS event_time")
    assigned = spark.createDataFrame([(r[0], r[2]) for r in rows], "event_id string, split string")
    got = {r.split: r.violations for r in audit.purge_violations(events, assigned, hour).collect()}
    # a and b see e, which is earlier; c reaches a and b at the window's closed edge; d just misses c
    assert got == {"train": 1, "validation": 1, "test": 1}
    none = audit.purge_violations(events, assigned, 0).agg({"violations": "sum"}).first()[0]
    assert none == 0


def test_alert_quality_counts_inclusive_ranges(spark):
    minute = 60 * 10**6
    risk = spark.createDataFrame([assessment(n, n * minute, 50.0) for n in range(6)], RISK_ASSESSMENTS)
    labels = spark.createDataFrame(
        [(f"a{n:06d}", "brute_force" if n in (1, 2, 5) else "normal", n in (1, 2, 5), True) for n in range(6)],
        "event_id string, attack_class string, malicious boolean, supervised_training_eligible boolean")
    import datetime as dt
    at = lambda m: START + dt.timedelta(minutes=m)
    alert = lambda i, a, b: ["1.0.0", i, "brute_force", "credential_guessing_single_target", "category_scoped", "none", None,
                             at(a), at(b), 1, ["PAD-BF-001"], 50.0, 50.0, "medium", "medium", 0, 0]
    alerts = spark.createDataFrame([alert("x", 1, 3), alert("y", 3, 4)], SECURITY_ALERTS)
    row = evaluate.alert_metrics(evaluate.labelled(risk, labels), alerts).first()
    # x covers 1, 2, 3 (two of three malicious); y covers 3, 4 (none); event 5 is covered by neither.
    assert (row.alerts, row.alert_precision, row.detectable) == (2, 0.5, 3)
    assert abs(row.alert_recall - 2 / 3) < 1e-12
    summary = evaluate.class_summary(evaluate.class_metrics(evaluate.labelled(risk, labels))).first()
    assert summary.macro_precision == 0.5 and summary.weighted_recall == 1.0


def test_reconstructed_report_has_null_counters(spark):
    risk = spark.createDataFrame([assessment(0, 0, 50.0)], RISK_ASSESSMENTS)
    from authwatch.schema import RULE_DETECTIONS
    none = spark.createDataFrame([], RULE_DETECTIONS)
    rows = quality.detection_report(none, risk, spark.createDataFrame([], SECURITY_ALERTS)).where("section = 'suppressed'")
    assert {r.value for r in rows.collect()} == {None}


def test_location_edge_cases(spark):
    events = frame(spark, parse("""
        0 u1 s1 success lat=10 lon=20 country=US
        60 u1 s1 success
        120 u1 s1 success lat=10 lon=21 country=GB
    """))
    got = {r.anchor_event_id: r for r in build_features(events).collect()}
    assert got["e000001"].user_previous_success_geo__status == "missing_current_location"
    assert got["e000001"].seconds_since_user_previous_success_with_location == 60
    last = got["e000002"]
    # The last success has no country; the last located one is two minutes back.
    assert last.country_changed_since_previous_success is None
    assert last.implied_velocity__status == "capped" and last.implied_velocity_kmh_from_previous_success == 1200.0
