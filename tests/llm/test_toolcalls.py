import json
import random

import pytest
from pyspark.sql import functions as F

from authwatch.llm import toolcalls

TOOLS = {"find": {"q": ("string", True), "n": ("integer", False), "w": ("number", False), "deep": ("object", False), "all": ("boolean", False), "tags": ("array", False)}}
CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, status string"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"


@pytest.mark.parametrize("arguments, errors", [
    ('{"q": "x", "n": 3, "w": 2, "deep": {"b": 1, "a": []}, "all": true, "tags": []}', []), ('{"q":"x","w":1.5}', []), ('{}', ["missing:q"]),
    ('{"q": null}', ["type:q"]), ('{"q": 1, "n": "1"}', ["type:n", "type:q"]), ('{"q":"x","n":1.5}', ["type:n"]),
    ('{"q":"x","other":1,"Q":2}', ["unknown:Q", "unknown:other"]), ("[1]", ["not_object"]), ("{", ["not_json"]), (None, ["not_json"]), ("", ["not_json"]),
    ('{"q":"x","q":"y"}', ["not_json"]), ('{"q":"x","deep":[],"all":0,"tags":{}}', ["type:all", "type:deep", "type:tags"])])
def test_validation(spark, arguments, errors):
    calls = spark.createDataFrame([("find", arguments), ("lose", '{"q":"x"}')], "name string, arguments string")
    got = {r.name: r.errors for r in toolcalls.validated(calls, toolcalls.schema_rows(spark, TOOLS)).collect()}
    assert got == {"find": errors, "lose": ["unknown_tool"]}


def test_canonical_json(spark):
    rows = [('{ "b" : [1, {"z":2,"a":"é\\u00e9\\n"}], "a":null}',), ("{",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").coalesce(1).select(toolcalls.canonical(F.col("j"))).collect()]
    assert got == ['{"a":null,"b":[1,{"a":"éé\\n","z":2}]}', None, None]


def test_link_order_and_status(spark):
    calls = [(1, 5, "a", "find", '{"q": "1"}', "own"), (1, 2, "b", "find", '{"q": "2"}', "own"), (1, 3, "dup", "find", "{}", "own"), (1, 3, "dup", "find", "{}", "own"),
             (1, 8, "lone", "find", "bad", "own"), (2, 1, "a", "find", '{"q":"3"}', "own"), (None, 1, "a", "find", "{}", "own"), (1, 9, None, "find", "{}", "own"),
             (3, 1, "x", "find", '{"q":"x"}', "own"), (3, 2, "y", "find", '{"q":"y"}', "own")]
    results = [(1, 1, "a", "early"), (1, 6, "b", None), (1, 7, "gone", "orphan"), (3, 3, "x", "rx"), (3, 4, "y", "ry")]
    needs = [(1, "b", "a"), (1, "b", "a"), (1, "lone", "nothing"), (3, "x", "y"), (3, "y", "x"), (None, "b", "a")]
    messages = [(1, 0, "user", 'say "hi"'), (1, 0, "user", 'say "hi"'), (4, 0, None, None)]
    out = toolcalls.link(
        spark.createDataFrame(messages, "conv_id bigint, turn bigint, role string, text string"), spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(results, RESULTS), toolcalls.schema_rows(spark, TOOLS), spark.createDataFrame(needs, "conv_id bigint, call_id string, needed_id string")).collect()
    assert len(out) == len(calls) + len(results) + len(messages)
    at = {(r.conv_id, r.kind, r.call_id): r for r in out}
    status = {k: r.status for k, r in at.items()}
    assert status[1, "call", "a"] == status[1, "result", "a"] == status[1, "call", "b"] == "linked"
    assert status[1, "call", "dup"] == "repeated" and status[1, "call", "lone"] == "no_result" and status[2, "call", "a"] == "no_result"
    assert status[1, "result", "gone"] == "no_call" and status[None, "call", "a"] == "no_result" and status[1, "call", None] == "no_result"
    assert {status[3, k, c] for k in ("call", "result") for c in "xy"} == {"cycle"}
    # call a (turn 5) < its result (turn 1) < call b, which needs it < b's result
    key = lambda r: (r.order_turn, r.order_level, r.turn)
    chain = [at[1, "call", "a"], at[1, "result", "a"], at[1, "call", "b"], at[1, "result", "b"]]
    assert [key(r) for r in chain] == sorted(key(r) for r in chain) and chain[0].order_turn == 5
    assert at[1, "message", None].json == '{"content":"say \\"hi\\"","role":"user"}' and at[4, "message", None].json == '{"content":null,"role":null}'
    assert at[1, "call", "a"].json == '{"arguments":{"q":"1"},"call":{"call_id":"a","name":"find"}}'
    assert at[1, "call", "lone"].errors == ["not_json"] and at[1, "result", "b"].json == '{"call_id":"b","content":null,"role":"tool"}'
    assert all(json.dumps(json.loads(r.json), sort_keys=True, ensure_ascii=False, separators=(",", ":")) == r.json for r in out)


def test_long_chain_and_empty_tables(spark):
    calls = spark.createDataFrame([(1, t, f"c{t}", "find", "{}", "") for t in range(0, 16, 2)], CALLS)
    results = spark.createDataFrame([(1, 15 - t, f"c{t}", "r") for t in range(0, 16, 2)], RESULTS)
    needs = spark.createDataFrame([(1, f"c{t}", f"c{t - 2}") for t in range(2, 16, 2)], "conv_id bigint, call_id string, needed_id string")
    messages = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    schemas = toolcalls.schema_rows(spark, TOOLS)
    out = toolcalls.link(messages, calls, results, schemas, needs).collect()
    order = [r.call_id + r.kind[0] for r in sorted(out, key=lambda r: (r.order_turn, r.order_level, r.turn))]
    assert order == [f"c{t}{k}" for t in range(0, 16, 2) for k in "cr"]
    assert toolcalls.link(messages, calls.limit(0), results.limit(0), schemas).count() == 0


def test_chain_longer_than_two_hundred_levels(spark):
    """Each call needs the result before it; a pair that needs each other, and what follows it, stays unsettled."""
    n = 130
    ids = [f"c{t}" for t in range(n)]
    calls = spark.createDataFrame([(1, 2 * n - t, c, "find", "{}", "") for t, c in enumerate(ids)] + [(2, t, f"c{t}", "find", "{}", "") for t in range(3)], CALLS)
    results = spark.createDataFrame([(1, t, c, "r") for t, c in enumerate(ids)] + [(2, t, f"c{t}", "r") for t in range(3)], RESULTS)
    needs = spark.createDataFrame([(1, ids[t], ids[t - 1]) for t in range(1, n)] + [(1, ids[t], ids[t - 40]) for t in range(60, n, 60)]
                                  + [(2, "c0", "c1"), (2, "c1", "c0"), (2, "c2", "c1")], "conv_id bigint, call_id string, needed_id string")
    messages = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    out = toolcalls.link(messages, calls, results, toolcalls.schema_rows(spark, TOOLS), needs).collect()
    chain = sorted((r for r in out if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_level, r.turn))
    assert [r.call_id + r.kind[0] for r in chain] == [c + k for c in ids for k in "cr"] and {r.status for r in chain} == {"linked"}
    assert [r.order_level for r in chain] == list(range(2 * n)) and {r.order_turn for r in chain} == {2 * n}
    assert {(r.status, r.order_level) for r in out if r.conv_id == 2} == {("cycle", None)}


def test_order_of_random_graphs(spark):
    draw, nodes, edges = random.Random(3), [], []
    for g in range(12):
        size = draw.randint(1, 14)
        nodes += [(f"{g}/{i}", draw.randint(0, 20)) for i in range(size)]
        acyclic = draw.random() < 0.7
        pairs = {(draw.randrange(size), draw.randrange(size)) for _ in range(draw.randint(0, 2 * size))}
        edges += [(f"{g}/{a}", f"{g}/{b}") for a, b in pairs if a > b or not acyclic]
    parents = {n: [b for a, b in edges if a == n] for n, _ in nodes}
    want, turn = {}, dict(nodes)
    while free := [n for n in turn if n not in want and all(p in want for p in parents[n])]:
        for n in free:
            above = [want[p] for p in parents[n]]
            want[n] = (max([turn[n], *(t for t, _ in above)]), max([0, *(k + 1 for _, k in above)]))
    want = {n: want.get(n, (turn[n], None)) for n in turn}
    got = toolcalls.ordered(spark.createDataFrame(nodes, "node string, turn bigint"), spark.createDataFrame(edges, "node string, parent string")).collect()
    assert len(got) == len(nodes) and {r.node: (r.order_turn, r.order_level) for r in got} == want
