import hashlib
import hmac

import pytest

from authwatch.config import AuthwatchError
from authwatch.functions.privacy import DOMAINS, pseudonymise

VALUES = [None, "", "bob", "Bob", " bob", "zoë", "日本語", "a\x00b", "x" * 10_000, "bob"]


def plain(key, column, value):
    if value is None:
        return None
    prefix, domain = DOMAINS[column]
    return f"{prefix}:{hmac.new(key, f'{domain}:{value}'.encode(), hashlib.sha256).hexdigest()[:32]}"


def raw(spark):
    rows = [(i, v, v, None, v, "kept") for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "n int, user_id string, source_id string, device_id string, session_id string, other string")


@pytest.mark.parametrize("size", [32, 63, 64, 65, 200])
def test_values_are_keyed_digests(spark, size):
    key = bytes(i % 256 for i in range(7, 7 + size))
    df = raw(spark)
    got = pseudonymise(df, key)
    assert got.schema.names == df.schema.names
    for r in got.collect():
        value = VALUES[r.n]
        assert (r.user_id, r.source_id, r.session_id) == tuple(plain(key, c, value) for c in ("user_id", "source_id", "session_id"))
        assert r.device_id is None and r.other == "kept"


def test_equal_values_of_different_columns_stay_apart(spark):
    rows = pseudonymise(raw(spark), bytes(32)).where("n = 2").first()
    assert len({rows[c].split(":")[1] for c in ("user_id", "source_id", "session_id")}) == 3


def test_tables_without_rows_or_without_some_columns(spark):
    assert pseudonymise(raw(spark).limit(0), bytes(32)).count() == 0
    got = pseudonymise(raw(spark).select("n", "user_id"), bytes(32))
    assert got.columns == ["n", "user_id"] and got.count() == len(VALUES)


def test_short_keys_are_refused(spark):
    with pytest.raises(AuthwatchError):
        pseudonymise(raw(spark), bytes(31))


def test_no_plan_shows_the_key_and_none_needs_python(spark):
    key = b"correct horse battery staple, twice over"
    df = pseudonymise(raw(spark), key)
    df.collect()
    run = df._jdf.queryExecution()
    shown = run.toString() + run.logical().toJSON() + run.executedPlan().toJSON()
    shown += "".join(run.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(m))
                     for m in ("extended", "codegen", "cost", "formatted"))
    pads = [bytes(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C)]
    for secret in (key, *pads):
        for text in (secret[:32].hex(), secret[:32].hex().upper(), secret[:32].decode("latin1"),
                     ", ".join(str(b - 256 * (b > 127)) for b in secret[:8])):
            assert text not in shown
    assert "ArrowEvalPython" not in shown and "BatchEvalPython" not in shown
