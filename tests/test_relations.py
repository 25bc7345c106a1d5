"""Order statistics by refinement, relations between the tables of a run, scoring counters, evaluation by split."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from authwatch.operators.ranks import nearest_rank, select_ranks
from authwatch.plans import evaluate, relations, scoring
from authwatch.schema import RULE_DETECTIONS
from tests.streams import START


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_ranks_equal_sorting_however_narrow_the_ranges(spark, kind):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        # a hot key, crowded values with a few far away, repeats, negative ones
        value = rng.choice([rng.randrange(-50, 50), rng.randrange(10**6), 10**12 + rng.randrange(3000), -(10**15)])
        rows.append((rng.choice("aaab"), float(value) / 7 if kind == "double" else value))
    rows += [("c", rows[0][1]), ("d", None), (None, rows[0][1])]
    df = spark.createDataFrame(rows, f"k string, v {kind}")
    ranks = {"low": F.lit(1), "mid": nearest_rank(0.5), "high": nearest_rank(0.9), "last": F.col("__n"), "beyond": F.col("__n") + 1}

    def want(values):
        values = sorted(v for v in values if v is not None)
        at = lambda n: values[n - 1]
        return (at(1), at(math.ceil(0.5 * len(values))), at(math.ceil(0.9 * len(values))), values[-1], None)

    got = {r.k: (r.low, r.mid, r.high, r["last"], r.beyond) for r in select_ranks(df, ["k"], "v", ranks, few=5).collect()}
    assert got == {k: want(v for kk, v in rows if kk == k) for k in "abc"}
    whole = select_ranks(df, [], "v", ranks, few=5).collect()
    assert [tuple(r) for r in whole] == [want(v for _, v in rows)]
    assert [tuple(r) for r in select_ranks(df.where("v IS NULL"), [], "v", ranks).collect()] == [(None,) * 5]
    assert select_ranks(df.where("v IS NULL"), ["k"], "v", ranks).isEmpty()


def detection(spark, rows):
    """(anchor, rule, strength, group, reason) as stored detections."""
    full = [["1.0.0", f"{a}{r}{s}", a, START, r, "1.0.0", "brute_force", "brute_force", "high", s, g, [], [why]] for a, r, s, g, why in rows]
    return spark.createDataFrame(full, RULE_DETECTIONS)


def test_counters_and_ties_do_not_depend_on_order(spark):
    rows = [("a", "R1", 0.5, "g", "x"), ("a", "R1", 0.5, "g", "y"), ("a", "R1", 0.2, "g", "z"), ("a", "R2", 0.1, "g", "x"),
            ("b", "R1", 0.9, "g", "x"), ("b", "R3", 0.9, "h", "x")]
    anchors = spark.createDataFrame([("a", START), ("c", START)], "anchor_event_id string, anchor_event_time timestamp")
    for part in (rows, rows[::-1]):
        found = detection(spark, part).repartition(3)
        kept = {(r.anchor_event_id, r.rule_id): (r.d.signal_strength, r.d.reason_codes, r.repeats) for r in scoring.strongest(found).collect()}
        assert kept[("a", "R1")] == (0.5, ["y"], 3) and len(kept) == 4
        assert tuple(scoring.scoring_counters(found, anchors).first()) == (3, 4, 2, 3)
        rebuilt = scoring.results_from_detections(found, anchors).collect()
        assert {r.anchor_event_id: len(r.results) for r in rebuilt} == {"a": 2, "b": 2, "c": 0}
        assert all(r.anchor_event_time is not None for r in rebuilt)
    none = detection(spark, [])
    assert tuple(scoring.scoring_counters(none, anchors.limit(0)).first()) == (0, 0, 0, 0)


def test_relations_name_each_misfit(spark):
    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "anchor_event_id string")

    found = detection(spark, [("a", "R1", 0.5, "g", "x"), ("a", "R2", 0.5, "g", "x"), ("lost", "R1", 0.5, "g", "x"), ("lost", "R2", 0.5, "g", "x")])
    alerts = spark.createDataFrame(
        [("1", ["R1"], None), ("2", ["R1", "R9", "R9"], "u"), ("3", ["R8", "R9"], None), ("4", [], "s")],
        "alert_id string, contributing_rule_ids array<string>, scope_value string")

    def run(scope_expected):
        report = relations.run_relations(found, ids("a", "b", "b", "x"), alerts, scope_expected, ids("a", "b", "new", "new"), ids("a", "b", "x"))
        return {r.check: r.violations for r in report.collect()}

    assert run(False) == {
        "ORPHANED_DETECTION_ANCHORS": 1, "REPEATED_ASSESSMENTS": 1, "ASSESSMENTS_OUTSIDE_ANCHORS": 1, "ANCHORS_WITHOUT_ASSESSMENT": 1,
        "REPEATED_ANCHORS": 1, "ASSESSMENTS_OUTSIDE_SCOPE": 0, "SCOPE_WITHOUT_ASSESSMENT": 0, "REPEATED_SCOPE": 0,
        "DANGLING_ALERT_RULES": 2, "UNEXPECTED_ALERT_SCOPE": 2}
    assert run(True)["UNEXPECTED_ALERT_SCOPE"] == 0
    empty = relations.run_relations(found.limit(0), ids(), alerts.limit(0), False)
    assert {r.violations for r in empty.collect()} == {0}


def test_parts_add_up_to_the_whole(spark):
    minute = dt.timedelta(minutes=1)
    rows = spark.createDataFrame([
        ("a", START, 1, "brute_force", 0, "brute_force", True, "train", "brute_force", "brute_force"),
        ("b", START + minute, 1, "brute_force", 1, "normal", False, "test", "none", "brute_force"),
        ("c", START + 2 * minute, 0, None, 0, "brute_force", True, "test", "brute_force", "none"),
        ("d", START + 3 * minute, 2, "brute_force", 0, "brute_force", True, None, "brute_force", "brute_force"),
        ("e", START + 4 * minute, 0, None, 0, "novel", True, "novel_anomaly_holdout", "none", "none")],
        "anchor_event_id string, anchor_event_time timestamp, fired_rule_count long, primary_attack_category string, insufficient_data_count long, "
        "attack_class string, malicious boolean, split string, actual string, predicted string")
    rates = {r.part: r for r in evaluate.rates(rows).collect()}
    assert set(rates) == {"overall", "train", "test", "novel_anomaly_holdout"}
    assert rates["overall"].events == 5 and rates["test"].events == 2
    assert (rates["overall"].detection_rate, rates["test"].false_positive_rate, rates["train"].false_positive_rate) == (0.5, 1.0, None)
    metrics = {(r.part, r["class"]): r for r in evaluate.class_metrics(rows).collect()}
    whole = metrics[("overall", "brute_force")]
    assert (whole.support, whole.predicted, whole.true_positives) == (3, 3, 2)
    assert metrics[("test", "brute_force")].recall == 0.0 and metrics[("test", "brute_force")].f1 is None
    alerts = spark.createDataFrame(
        [("x", "brute_force", START, START + minute), ("y", "brute_force", START + 3 * minute, START + 3 * minute)],
        "alert_id string, attack_category string, first_seen timestamp, last_seen timestamp")
    found = {r.part: (r.alerts, r.alert_precision, r.alert_recall) for r in evaluate.alert_metrics(rows, alerts).collect()}
    # x holds one malicious and one benign event: right for the training part only; y is right for the whole only.
    assert found == {"overall": (2, 0.5, 1.0), "train": (2, 0.5, 1.0), "test": (2, 0.0, None), "novel_anomaly_holdout": (2, 0.0, None)}
