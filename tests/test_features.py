from dataclasses import replace

import pytest

from authwatch.config import AuthwatchError, FeatureConfig, SkewConfig
from authwatch.plans.features import build_features
from authwatch.schema import feature_catalog
from tests.naive import assert_same, snapshot
from tests.streams import frame, parse, random_rows

ALL_DENSE = SkewConfig(dense_rows=0, chunk="5m")
SOME_DENSE = SkewConfig(dense_rows=60, chunk="5m")
SPARSE = SkewConfig(dense_rows=10**9)


def rows_of(df):
    return {r["anchor_event_id"]: r.asDict() for r in df.collect()}


def test_catalog_is_201_columns_in_order(spark):
    config = FeatureConfig()
    names = [f.name for f in feature_catalog(config)]
    assert len(names) == len(set(names)) == 201
    df = build_features(frame(spark, parse("0 u1 s1 failure")), config)
    assert df.columns == names


@pytest.mark.parametrize("seed", [101, 202, 303])
def test_frame_form_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    config = replace(FeatureConfig(), skew=SPARSE)
    assert_same(rows_of(build_features(frame(spark, rows), config)), snapshot(rows, config), "frame")


@pytest.mark.parametrize("seed,skew", [(101, ALL_DENSE), (202, SOME_DENSE)])
def test_sweep_form_equals_brute_force(spark, seed, skew):
    rows = random_rows(seed)
    config = replace(FeatureConfig(), skew=skew)
    assert_same(rows_of(build_features(frame(spark, rows), config)), snapshot(rows, config), "sweep")


def test_ties_never_see_each_other(spark):
    got = rows_of(build_features(frame(spark, parse("""
        0 u1 s1 failure
        10 u1 s1 failure
        60 u1 s1 failure
        60 u1 s1 success
        60 u1 s1 failure
    """))))
    assert [got[f"e{i:06d}"]["user_attempt_count__5m"] for i in range(5)] == [0, 1, 2, 2, 2]
    assert got["e000004"]["prior_consecutive_user_failures"] == 2


def test_left_edge_is_inclusive(spark):
    got = rows_of(build_features(frame(spark, parse("""
        0 u1 s1 failure
        299.999999 u1 s2 failure
        300 u1 s3 failure
        300.000001 u1 s4 failure
    """))))
    counts = [got[f"e{i:06d}"]["user_attempt_count__5m"] for i in range(4)]
    assert counts == [0, 1, 2, 2]


def test_shuffle_and_future_events_change_nothing(spark):
    rows = random_rows(7, n=80)
    config = replace(FeatureConfig(), skew=SPARSE)
    base = rows_of(build_features(frame(spark, rows), config))
    late = parse("99999 u1 s0 success")[0] | {"event_id": "late"}
    again = rows_of(build_features(frame(spark, list(reversed(rows)) + [late]).repartition(7), config))
    again.pop("late")
    assert again == base


def test_column_subset_and_unknown_column(spark):
    events = frame(spark, parse("0 u1 s1 failure"))
    df = build_features(events, columns=["user_attempt_count__5m", "hour_of_day"])
    assert df.columns == ["anchor_event_id", "anchor_event_time", "user_attempt_count__5m", "hour_of_day"]
    row = df.first()
    assert row.hour_of_day == 12
    with pytest.raises(ValueError):
        build_features(events, columns=["nope"])


def test_calendar_and_context(spark):
    row = build_features(frame(spark, parse("0 u1 s1 success lat=10 lon=20 rt=7 client=bot"))).first()
    assert (row.day_of_week, row.is_weekend, row.hour_sin) == (0, False, pytest.approx(0.0, abs=1e-12))
    assert row.current_has_location and row.current_has_device and row.current_response_time_ms == 7
    assert row.user_failure_rate__5m is None and row.user_failure_count__5m == 0
    assert row.user_in_baseline is False and row.is_new_device_for_user is None


def test_config_rejects_bad_ladders():
    with pytest.raises(AuthwatchError):
        FeatureConfig(windows=("5m", "1m"))
    with pytest.raises(AuthwatchError):
        FeatureConfig(windows=("1m", "5m"))


def test_repeated_ids_of_dense_entities_stay_single_rows(spark):
    events = frame(spark, parse("0 u1 s1 failure\n5 u1 s1 success\n9 u2 s1 failure"))
    config = FeatureConfig(skew=SkewConfig(dense_rows=0))
    rows = build_features(events.unionByName(events), config, columns=["source_attempt_count__1h"]).collect()
    assert sorted(r.source_attempt_count__1h for r in rows) == [0, 0, 2, 2, 4, 4]
