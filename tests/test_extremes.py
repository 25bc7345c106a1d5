"""Least and greatest values in intervals, against a plain scan; the mean check of alerts; what probes move."""

import random

from pyspark.sql import functions as F

from authwatch.config import FeatureConfig
from authwatch.operators.extremes import LEVELS, RADIX, covering_nodes, interval_extremes
from authwatch.plans import audit, validate
from authwatch.plans.features import build_features
from authwatch.sources.adapters import auth_events

SF = "/root/testdata/sf0.001"


def test_covering_nodes_are_the_interval(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(-9000, 9000), rng.choice((0, 1, 5, 63, 64, 700, 20_000))) for _ in range(200)] + [(0, 8 ** 6 * 3), (-1, 0)]
    rows = spark.createDataFrame([(a, a + n) for a, n in pairs], "a bigint, b bigint")
    for r in rows.withColumn("nodes", covering_nodes(F.col("a"), F.col("b"))).collect():
        spans = sorted((n.node * RADIX ** n.level, (n.node + 1) * RADIX ** n.level) for n in r.nodes)
        assert len(spans) <= 2 * RADIX * LEVELS
        at = r.a
        for begin, end in spans:
            assert begin == at
            at = end
        assert at == max(r.a, r.b)


def test_extremes_equal_a_plain_scan(spark):
    rng = random.Random(2)
    points = [(rng.choice("ab"), rng.randint(-10 ** 6, 10 ** 7), rng.random()) for _ in range(3000)] + [("a", 5, None), (None, 5, 1.0), ("b", None, 9.0)]
    spans = [(i, rng.choice(("a", "b", "none", None)), x, x + rng.choice((0, 30, 999, 60_000, 5_000_000, -4)))
             for i, x in enumerate(rng.randint(-2 * 10 ** 6, 10 ** 7) for _ in range(300))] + [(900, "a", None, 5)]
    spans += [(1000 + i, "a", p[1], p[1]) for i, p in enumerate(points[:40]) if p[0] == "a"]
    got = interval_extremes(spark.createDataFrame(points, "k string, us bigint, v double"),
                            spark.createDataFrame(spans, "interval_id bigint, k string, first_us bigint, last_us bigint"), ["k"], "v", 700).collect()
    assert len(got) == len(spans)
    for r in got:
        inside = [v for k, us, v in points if k == r.k and k is not None and None not in (us, v, r.first_us) and r.first_us <= us <= r.last_us]
        assert (r.least, r.greatest) == ((min(inside), max(inside)) if inside else (None, None))


def test_empty_sides(spark):
    points = spark.createDataFrame([], "k string, us bigint, v double")
    spans = spark.createDataFrame([(1, "a", 0, 9)], "interval_id bigint, k string, first_us bigint, last_us bigint")
    assert [(r.least, r.greatest) for r in interval_extremes(points, spans, ["k"], "v").collect()] == [(None, None)]
    assert interval_extremes(points, spans.limit(0), ["k"], "v").count() == 0


def test_mean_between_the_scores_of_its_range(spark):
    risk = spark.createDataFrame([("bot_activity", 10, 20.0), ("bot_activity", 20, 40.0), ("bot_activity", 99, 90.0), ("other", 15, 95.0), (None, 15, 1.0)],
                                 "primary_attack_category string, s bigint, risk_score double").withColumn("anchor_event_time", F.timestamp_seconds("s"))
    alerts = spark.createDataFrame([("sum", 60.0, 10, 20), ("mean", 30.0, 10, 20), ("edge", 40.0009, 10, 20), ("over", 40.002, 10, 20),
                                    ("low", 19.9, 10, 20), ("nothing", 5.0, 30, 40)], "alert_id string, aggregate_risk_score double, a bigint, b bigint").selectExpr(
        "*", "'bot_activity' AS attack_category", "timestamp_seconds(a) AS first_seen", "timestamp_seconds(b) AS last_seen")
    got = {r.alert_id: r.plausible for r in validate.mean_plausibility(alerts, risk).collect()}
    assert got == {"sum": False, "mean": True, "edge": True, "over": False, "low": False, "nothing": True}


def test_probes_move_only_what_leaks(spark):
    events, config = auth_events(spark, SF), FeatureConfig()
    names = [c for listed in audit.columns_by_key(config).values() for c in listed]
    assert len(names) == len(set(names)) and set(audit.columns_by_key(config)) == {"user_id", "source_id", "session_id", "device_id"}
    snapshot = build_features(events, config).cache()
    assert audit.moved_by_probes(events, snapshot, config).count() == 0
    bad = snapshot.withColumn("source_failure_count__1h", F.col("source_failure_count__1h") + 1)
    added = {r.probe: r for r in audit.probes(events).collect()}
    got = audit.moved_by_probes(events, bad, config).collect()
    assert all(r["columns"] == ["source_failure_count__1h"] for r in got)
    want = {(p, r.event_id) for r in events.collect() for p, a in added.items()
            if r.source_id == a.source_id and r.event_time.timestamp() * 1e6 <= a.limit_us + 0.5}
    assert {(r.probe, r.anchor_event_id) for r in got} == want
    assert added["future"].event_time > max(r.event_time for r in events.select("event_time").collect())
