import json
import uuid

import pytest

from authwatch.config import AuthwatchError, SplitConfig
from authwatch.functions.privacy import prohibited
from authwatch.plans import split
from authwatch.plans.fingerprint import fingerprint
from authwatch.plans.validate import validate_events
from authwatch.sources.ingest import ingest_csv, ingest_jsonl
from authwatch.sources import publish as publish_module
from authwatch.sources.publish import publish, read_published, verify_manifest
from authwatch.sources.synth import SynthConfig, generate
from tests.streams import START, frame, parse

KEY = bytes(range(32))
ROW = {
    "schema_version": "1.0.0", "event_time": "2024-03-04T12:00:00Z", "user_id": "bob", "source_id": "10.0.0.1",
    "device_id": "dev", "session_id": "s1", "application_id": "app", "authentication_method": "password",
    "authentication_outcome": "success",
}


def uid(n):
    return str(uuid.UUID(int=n))


def test_csv_ingestion(spark, tmp_path):
    path = tmp_path / "in.csv"
    header = ["Event-ID", *[c.replace("_", " ").title() for c in ROW], "Failure Reason", "Response-Time-MS"]
    good = [uid(1), *ROW.values(), "N/A", "12"]
    bad = [uid(2), *ROW.values(), "null", "99999"]
    nobody = [uid(3), *[("" if c == "user_id" else v) for c, v in ROW.items()], "", "1"]
    path.write_text("\n".join(",".join(r) for r in (header, good, bad, nobody)))
    got = ingest_csv(spark, str(path), KEY)
    row = got.accepted.collect()
    assert len(row) == 1 and row[0].response_time_ms == 12 and row[0].failure_reason is None
    import hashlib
    import hmac
    assert row[0].user_id == "u:" + hmac.new(KEY, b"user:bob", hashlib.sha256).hexdigest()[:32]
    errors = sorted((r.error_code, r.error_field) for r in got.quarantined.collect())
    assert errors == [("I002", "response_time_ms"), ("I003", "user_id")]
    with pytest.raises(AuthwatchError):
        got.enforce("fail")


def test_csv_files_with_different_headers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    names, values = ["event_id", *ROW], {"event_id": uid(1), **ROW}
    (folder / "a.csv").write_text(",".join(names) + "\n" + ",".join(values[n] for n in names) + "\n")
    swapped = [{"user_id": "source_id", "source_id": "user_id"}.get(n, n) for n in names]
    values["event_id"] = uid(2)
    bad = dict(values, event_id="secret-looking-id", user_id="someone@example.org")
    lines = [swapped, [values[n] for n in swapped], [bad[n] for n in swapped]]
    (folder / "b.csv").write_text("\n".join(",".join(x) for x in lines))
    got = ingest_csv(spark, str(folder), KEY)
    assert {(r.user_id, r.source_id) for r in got.accepted.collect()} == {
        (a.user_id, a.source_id) for a in got.accepted.where(f"event_id = '{uid(1)}'").collect()}
    assert got.accepted.count() == 2
    # where and why, but nothing of the row itself
    quarantined = got.quarantined.collect()
    assert [(r.source_file.rsplit("/", 1)[1], r.row_number, r.error_code, r.error_field) for r in quarantined] == [("b.csv", 3, "I002", "event_id")]
    assert not any(v in str(quarantined) for v in ("secret-looking-id", "someone@example.org"))
    # a sensitive column in any file refuses the whole input
    (folder / "c.csv").write_text("event_id,password\n" + uid(3) + ",hunter2\n")
    with pytest.raises(AuthwatchError):
        ingest_csv(spark, str(folder), KEY)


def test_sensitive_and_label_columns_reject_the_file(spark, tmp_path):
    for name in ("passwordHash", "campaign_id"):
        path = tmp_path / f"{name}.csv"
        path.write_text(f"event_id,{name}\n{uid(1)},x\n")
        with pytest.raises(AuthwatchError):
            ingest_csv(spark, str(path), KEY)
    assert prohibited(["access-Token", "user"]) == ["access-Token"]


def test_jsonl_ingestion(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    good = {"event_id": uid(1), **ROW, "response_time_ms": 5, "extra": {"a": {"b": 1}}}
    path.write_text("\n".join([json.dumps(good), "", "{broken", "[1, 2]"]))
    got = ingest_jsonl(spark, str(path), KEY)
    assert [r.response_time_ms for r in got.accepted.collect()] == [5]
    assert [r.error_code for r in got.quarantined.collect()] == ["I005", "I005"]
    path.write_text(json.dumps({**good, "a": {"accessToken": 1}}))
    with pytest.raises(AuthwatchError):
        ingest_jsonl(spark, str(path), KEY)


def test_publish_round_trip(spark, tmp_path):
    events, truth = generate(spark, SynthConfig(hours=2, events_per_hour=20, users=10, campaigns={"brute_force": 1}))
    root = str(tmp_path / "out")
    publish(spark, root, {"auth_events": events, "ground_truth": truth})
    assert all(r.matches for r in verify_manifest(spark, root).collect())
    stored = read_published(spark, root, "auth_events")
    assert stored.count() == 140 and fingerprint(stored).first() == fingerprint(events.repartition(3)).first()
    with pytest.raises(AuthwatchError):
        publish(spark, root, {"auth_events": events})
    assert validate_events(stored).where("level = 'error' AND violations > 0").isEmpty()


def test_split_boundaries_and_policies(spark):
    events = frame(spark, parse("\n".join(f"{i * 3600} u1 s1 failure" for i in range(20))))
    config = SplitConfig(train_fraction=.5, validation_fraction=.25, test_fraction=.25, purge="1h", embargo="0s",
                         strict_isolation=False)
    base = int(START.timestamp() * 10**6)
    ends = split.boundaries(events, config)
    assert ends == (base + 10 * 3600 * 10**6, base + 15 * 3600 * 10**6, base + 19 * 3600 * 10**6 + 1)
    rows = [(f"e{i:06d}", "c1" if i in (8, 12) else f"n{i}", "brute_force" if i in (8, 12) else "normal", i in (8, 12), True)
            for i in range(20)]
    labels = spark.createDataFrame(rows, "event_id string, campaign_id string, scenario string, malicious boolean, "
                                         "supervised_training_eligible boolean")
    got = {r.event_id: (r.split, r.exclusion_reason) for r in split.assign(events, labels, config, ends).collect()}
    assert got["e000008"] == got["e000012"] == ("excluded", "campaign_crosses_split_boundary")
    assert got["e000010"] == got["e000015"] == ("excluded", "purged_after_boundary")
    assert got["e000009"] == ("train", None) and got["e000019"] == ("test", None)
    with pytest.raises(AuthwatchError):
        split.check_exclusions(split.assign(events, labels, config, ends), config)


def test_published_tables_without_a_fixed_schema_are_read_typed(spark, tmp_path):
    root = str(tmp_path / "own")
    df = spark.createDataFrame([(1, [1.5, None], (2, "x")), (2, None, None)], "n int, xs array<double>, s struct<a: int, b: string>")
    publish(spark, root, {"user_baselines": df})
    got = read_published(spark, root, "user_baselines")
    assert got.dtypes == df.dtypes and sorted(got.collect()) == sorted(df.collect())
    assert {r.field for r in verify_manifest(spark, root).where("matches").collect()} == {"rows", "digest", "columns", "types"}


def test_half_written_runs_are_not_seen_and_a_late_commit_is_refused(spark, tmp_path):
    root = str(tmp_path / "race")
    one, two = (spark.range(n).toDF("n") for n in (3, 5))
    two.write.parquet(f"{root}/run_id=half/numbers")  # a run that ended before its manifest
    publish(spark, root, {"numbers": one})
    assert read_published(spark, root, "numbers").count() == 3
    # a run that saw no manifest when it began, and comes second
    late = tmp_path / "race" / "manifest.tmp"
    late.write_text("{}")
    jvm = spark.sparkContext._jvm
    with pytest.raises(AuthwatchError, match="first"):
        publish_module._move_new(spark, *[jvm.org.apache.hadoop.fs.Path(f"file://{p}") for p in (late, f"{root}/manifest.json")])
    assert read_published(spark, root, "numbers").count() == 3 and all(r.matches for r in verify_manifest(spark, root).collect())


def test_changed_files_do_not_match_the_manifest(spark, tmp_path):
    root = str(tmp_path / "changed")
    run = publish(spark, root, {"numbers": spark.range(4).toDF("n")})
    spark.range(1).toDF("n").write.mode("append").parquet(f"{run}/numbers")
    assert {r.field: r.matches for r in verify_manifest(spark, root).collect()} == {
        "rows": False, "digest": False, "columns": True, "types": True}
