"""What keeps the window features and the rules from growing faster than the events."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from authwatch.config import DetectionConfig, FeatureConfig, SkewConfig
from authwatch.functions.scalar import micros_of
from authwatch.operators import histories
from authwatch.operators.arrays import _measurer
from authwatch.operators.prefix import CHUNK, LONG, neighbour, neighbours, with_chunk
from authwatch.plans import baseline as baselines
from authwatch.plans.baseline import fit_baseline
from authwatch.plans.features import US, build_features, dense_entities
from authwatch.plans.rules import RULE_IDS, evaluate_rules
from authwatch.plans.scoring import PLAIN, score_results, score_snapshot
from authwatch.runtime import cut_lineage
from authwatch.schema import BASELINE_FEATURES, feature_catalog
from tests.naive import assert_same, snapshot
from tests.streams import frame, random_rows


def rows_of(df):
    return {r["anchor_event_id"]: r.asDict() for r in df.collect()}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("whole_rows", [0, 50])
def test_entities_cut_into_chunks_equal_brute_force(spark, whole_rows):
    rows = random_rows(404)
    config = replace(FeatureConfig(), skew=SkewConfig(dense_rows=0, chunk="5m", whole_rows=whole_rows))
    assert_same(rows_of(build_features(frame(spark, rows), config)), snapshot(rows, config), "chunks")


def test_short_dense_entities_are_one_chunk(spark):
    rows = frame(spark, random_rows(505)).withColumn(US, micros_of(F.col("event_time")))
    config = FeatureConfig(skew=SkewConfig(dense_rows=0, chunk="5m", whole_rows=60))
    dense = dense_entities(rows, config, ["source"])["source"]
    chunked = with_chunk(rows.join(dense, "source_id"), US, 300_000_000)
    found = chunked.groupBy("source_id", LONG).agg(F.count("*").alias("n"), F.count_distinct(CHUNK).alias("chunks")).collect()
    assert {r[LONG] for r in found} == {True, False}
    assert all(r[LONG] == (r.n > 60) and (r.chunks > 1) == r[LONG] for r in found)


def test_neighbours_are_those_of_both_directions(spark):
    rows = with_chunk(frame(spark, random_rows(606)).select("event_id", "user_id", micros_of(F.col("event_time")).alias(US)), US, 300_000_000)
    twice = neighbour(neighbour(rows, ["user_id"], US, "p", forward=False), ["user_id"], US, "n", forward=True)

    def plain(df, name):  # tied rows may take any order in each direction
        return sorted((r.user_id, r[US], r[name] or -1) for r in df.collect())

    once = neighbours(rows, ["user_id"], US, "p", "n")
    assert plain(once, "p") == plain(twice, "p") and plain(once, "n") == plain(twice, "n")


def test_long_known_sets_are_looked_up_with_the_same_verdicts(spark, monkeypatch):
    rows = random_rows(707)
    events = frame(spark, rows)
    names = [n for n, *_ in BASELINE_FEATURES]

    def run():
        return rows_of(build_features(events, FeatureConfig(), fit_baseline(events.where("rand(1) < 0.3")), names))

    listed = run()
    monkeypatch.setattr(baselines, "LIST_VALUES", 2)
    assert run() == listed
    assert {r["is_new_device_for_user"] for r in listed.values()} >= {True, False}


def test_unwanted_baseline_columns_cost_no_windows(spark):
    events = frame(spark, random_rows(808))
    plan = optimized(build_features(events, FeatureConfig(), fit_baseline(events), ["user_event_rate_ratio"]))
    assert "source_unique_user_count" not in plan and "targeted_user_count" not in plan


def test_events_carry_only_what_is_read_of_their_user(spark):
    events = frame(spark, random_rows(808))
    fitted = fit_baseline(events)
    names = ["user_event_rate_ratio", "is_new_country_for_user", "user_in_baseline"]
    few, all_ = (build_features(events, FeatureConfig(), fitted, columns) for columns in (names, None))
    plan = optimized(few)
    assert not [c for c in ("hour_histogram", "centroid_latitude", "response_time_std_ms") if c in plan]
    assert sorted(map(repr, few.select("anchor_event_id", *names).collect())) == sorted(map(repr, all_.select("anchor_event_id", *names).collect()))


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], -1)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def odd_events(spark, seed):
    """Some without a user or source, some twice."""
    events = frame(spark, random_rows(seed))
    n = F.substring("event_id", -1, 1)
    events = events.withColumns({"user_id": F.when(n != "3", F.col("user_id")), "source_id": F.when(n != "4", F.col("source_id"))})
    return events.unionByName(events.where(n == "5"))


def test_no_shuffle_carries_a_whole_snapshot(spark, no_broadcast):
    """Beside dense sources, rows, window tables and users are dealt out once each; the wide row is made where they meet."""
    events = frame(spark, random_rows(812))
    df = build_features(events, FeatureConfig(skew=SkewConfig(dense_rows=60)), fit_baseline(events))
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    widths = [int(n) for n in re.findall(r"\n\(\d+\) Exchange\nInput \[(\d+)\]", plan)]
    assert len(widths) > 5 and max(widths) <= 64 < len(df.columns) / 2
    assert "source_failure_rate__1h" in df.columns and len(re.findall("REPARTITION_BY_COL", plan)) == 6


@pytest.mark.parametrize("stay", ["false", "true"])
def test_rows_that_meet_by_user_give_the_same_snapshot(spark, no_broadcast, stay):
    """Dense sources, whose tables meet the rows in the user's partition, against frames alone; also where Spark deals out by all keys of a join."""
    events = odd_events(spark, 813)
    fitted = fit_baseline(events.where("event_id < 'e000150'"))
    dense, frames = (build_features(events, FeatureConfig(skew=SkewConfig(dense_rows=n)), fitted) for n in (60, 10**9))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", stay)
    got, expected = (sorted(repr(r) for r in df.collect()) for df in (dense, frames))
    assert got == expected and len(got) > 220


def test_values_with_short_histories_are_dealt_out_once(spark, monkeypatch):
    """Users of a device, none of whom is dense: their occurrences need one shuffle, not one to merge and one to order them."""
    plans = []
    monkeypatch.setattr(histories, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df))
    rows = random_rows(815)
    config = FeatureConfig(skew=SkewConfig(dense_rows=43))
    got = rows_of(build_features(frame(spark, rows), config, columns=["device_user_count__1h", "user_attempt_count__1h"]))
    assert [len(re.findall(r"Exchange hashpartitioning\(device_id", plan)) for plan in plans] == [1]
    expected = snapshot(rows, config)
    assert all(r["device_user_count__1h"] == expected[e]["device_user_count__1h"] for e, r in got.items())


def test_derived_columns_are_those_of_their_own_windows(spark):
    """Rates and coefficients of variation that follow from published columns, against the columns asked for alone."""
    events, config = odd_events(spark, 814), FeatureConfig(skew=SkewConfig(dense_rows=60))
    names = [f.name for f in feature_catalog(config) if f.kind == "source" and f.aggregate in ("rate", "cov")]
    whole, alone = (build_features(events, config, columns=c) for c in (None, names))
    assert sorted(map(repr, whole.select("anchor_event_id", *names).collect())) == sorted(map(repr, alone.select("anchor_event_id", *names).collect()))


def test_rules_are_not_folded_into_functions_over_their_verdicts(spark):
    config = DetectionConfig(enabled_rule_ids=("PAD-MFA-001",))
    table = cut_lineage(build_features(frame(spark, random_rows(909))))
    plan = optimized(score_results(evaluate_rules(table, config), config).select("anchor_event_id", "risk_score"))
    assert "MFA_INSUFFICIENT_ATTEMPT_HISTORY" in plan
    assert plan.count("MFA_INSUFFICIENT_ATTEMPT_HISTORY") == 1 and "filter(results" in plan.replace("filter(slice(results", "filter(results")


def test_sequences_and_windows_of_a_kind_share_one_sort(spark):
    config = FeatureConfig(skew=SkewConfig(dense_rows=10**9))
    df = build_features(frame(spark, random_rows(111)), config, columns=["user_attempt_count__5m", "prior_failures_since_user_success"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [user_id") == 1


def test_arrays_meet_no_window_operator_and_keep_ties(spark):
    """User, pair and user-device windows of short histories: no Window operator in the plan, repeated ids and nulls as by frames."""
    rows = random_rows(811)
    events = frame(spark, rows)
    events = events.unionByName(events.where("event_id < '5'"))
    config = replace(FeatureConfig(), skew=SkewConfig(dense_rows=10**9))
    names = [f.name for f in feature_catalog(config) if f.kind in ("user", "pair", "user_device")]
    names += ["prior_consecutive_user_failures", "previous_pair_outcome", "implied_velocity__status", "country_changed_since_previous_success"]
    fast = build_features(events, config, columns=names)
    assert "Window" not in fast._jdf.queryExecution().executedPlan().toString()
    dense = build_features(events, replace(config, skew=SkewConfig(dense_rows=0)), columns=names)
    assert sorted(map(repr, fast.collect())) == sorted(map(repr, dense.collect()))


def test_measures_do_not_depend_on_where_batches_end(spark):
    import pyarrow as pa

    n = 400
    users = sorted(f"u{i % 37}" for i in range(n))
    table = pa.table({"user_id": users, US: list(range(n)), "__v_n": [1] * n})
    plan = [("user", None, [("w", 5, ["n"])], {}, [])]
    out = [sum((b.column(1).to_pylist() for b in _measurer(["user_id"], plan, ["__user__n__w"], least)(iter(table.to_batches(size)))), [])
           for least, size in ((1, 1), (30, 7), (10**6, 100))]
    place = [sum(users[j] == users[i] for j in range(i)) for i in range(n)]
    assert out == [[min(5, p) for p in place]] * 3


def test_scores_by_slot_are_those_over_elements(spark):
    """Both ways over verdicts with and without evidence; the columns that reports read need no function over elements."""
    config = DetectionConfig()
    results = cut_lineage(evaluate_rules(build_features(frame(spark, random_rows(909))), config))
    whole, slots = score_results(results, config), score_results(results, config, len(RULE_IDS))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, slots.collect()))
    read = ["anchor_event_id", "risk_score", "severity", "primary_attack_category", "fired_rule_count", "fired_rule_ids", "insufficient_data_count"]
    assert "lambdafunction" in optimized(whole.select(*read)) and "lambdafunction" not in optimized(slots.select(*read))
    plain = evaluate_rules(build_features(frame(spark, random_rows(909))), config, explain=False)
    assert sorted(map(repr, score_results(plain, config).select(*read).collect())) == sorted(map(repr, whole.select(*read).collect()))


@pytest.mark.parametrize("reducer", ["max", "bounded_sum"])
def test_scores_without_verdicts_are_those_of_verdicts(spark, reducer):
    """A report that reads only the number of fired rules has neither strengths nor verdicts in its plan."""
    config = DetectionConfig()
    config = replace(config, scoring=replace(config.scoring, correlation_reducer=reducer))
    snap = cut_lineage(build_features(frame(spark, random_rows(909))))
    whole, plain = score_results(evaluate_rules(snap, config), config), score_snapshot(snap, config)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, whole.select(*PLAIN).collect()))
    some = replace(config, enabled_rule_ids=("PAD-BF-001",))
    assert sorted(map(repr, score_snapshot(snap, some).collect())) == sorted(map(repr, score_results(evaluate_rules(snap, some), some).select(*PLAIN).collect()))
    if reducer == "max":
        plan = optimized(plain.select("anchor_event_id", "fired_rule_count"))
        assert "named_struct" not in plan and "tanh" not in plan and "weight" not in plan


def test_reports_of_one_pass_store_no_assessments(spark, monkeypatch):
    import __spark_entry__ as entry

    stored = []
    monkeypatch.setattr(entry, "cut_lineage", lambda df: stored.append(df.columns) or cut_lineage(df))
    got = entry.queries()["eval_scenario_rates_by_split"](spark, "/root/testdata/sf0.001").collect()
    assert got and not [c for c in stored if "risk_score" in c]
