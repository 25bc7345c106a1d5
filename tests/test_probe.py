import os

import pytest

from authwatch.config import AuthwatchError
from authwatch.sources.probe import file_findings, probe_files, read_sound

SCHEMA = "n bigint, name string"


def parts(path):
    return sorted(f for f in os.listdir(path) if f.startswith("part-"))


def test_bad_files_are_named_and_the_rest_is_read(spark, tmp_path):
    root = str(tmp_path / "with space")
    df = spark.range(400).selectExpr("id AS n", "concat('name ', id) AS name")
    df.repartition(4).write.parquet(root)
    df.where("n < 0").coalesce(1).write.mode("append").parquet(root)  # sound, without rows
    names = parts(root)
    rows = {f: spark.read.parquet(f"{root}/{f}").count() for f in names}
    full = [f for f in names if rows[f]]
    assert len(full) == 4 and len(names) == 5
    whole = open(f"{root}/{full[0]}", "rb").read()
    footer = int.from_bytes(whole[-8:-4], "little")
    bad = {
        "part-a.parquet": b"", "part-b.parquet": b"PAR1", "part-c.parquet": b"name,n\nx,1\n" * 50,
        "part-d.parquet": whole[:len(whole) // 2],  # cut off
        "part-e.parquet": whole[:-8 - footer] + b"\xff" * footer + whole[-8:],  # garbled footer
    }
    for f, data in bad.items():
        with open(f"{root}/{f}", "wb") as out:
            out.write(data)
    probed = probe_files(spark, root)
    got = {os.path.basename(r.path): r for r in probed.collect()}
    assert set(got) == set(names) | set(bad)
    assert {f for f, r in got.items() if r.problem} == set(bad)
    assert {f: got[f].row_count for f in names} == rows and all(got[f].row_count == 0 for f in bad)
    assert {f: r.length for f, r in got.items()} == {f: os.path.getsize(f"{root}/{f}") for f in got}
    findings = file_findings(probed, "F001").collect()
    assert sorted(os.path.basename(r.field) for r in findings) == sorted(bad)
    assert {(r.code, r.level, r.violations) for r in findings} == {("F001", "error", 1)}
    assert sorted(r.n for r in read_sound(spark, root, probed, SCHEMA).collect()) == list(range(400))


def test_partitioned_and_sound_tables(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(30).selectExpr("id AS n", "concat('k', id % 3) AS kind").write.partitionBy("kind").parquet(root)
    probed = probe_files(spark, root)
    assert probed.where("problem IS NOT NULL").isEmpty() and file_findings(probed).isEmpty()
    got = read_sound(spark, root, probed, "n bigint, kind string").groupBy("kind").count().collect()
    assert {(r.kind, r["count"]) for r in got} == {("k0", 10), ("k1", 10), ("k2", 10)}


def test_nothing_readable(spark, tmp_path):
    root = tmp_path / "none"
    root.mkdir()
    (root / "part-0.parquet").write_bytes(b"no table")
    probed = probe_files(spark, str(root))
    assert [r.problem for r in probed.collect()] == ["no_parquet"]
    with pytest.raises(AuthwatchError):
        read_sound(spark, str(root), probed, SCHEMA)
