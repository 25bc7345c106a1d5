"""Chat formatting with linked tool calls (operator 4, DataFrame operations only).

Calls and results are linked by an equi-join on (conversation, call id), ordered so that nothing stands before what it
needs, checked against the tools' schemas, and written as canonical JSON: keys sorted, no blanks. One row for each
message comes out, so a conversation of any length is never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authwatch.runtime import cut_lineage, discard, stored_so_far

#: JSON types of schema entries against the leading word of Spark's variant type names.
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
          "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


def canonical(json: Column) -> Column:
    """The JSON text with sorted keys and no blanks; null if it isn't valid JSON."""
    return F.to_json(F.try_parse_json(json))


def schema_rows(spark, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """Schemas as rows (name, parameter, type, required), from {tool: {parameter: (type, required)}}."""
    rows = [(t, p, kind, required) for t, ps in tools.items() for p, (kind, required) in ps.items()]
    return spark.createDataFrame(rows, "name string, parameter string, type string, required boolean")


def _kind(value: Column) -> Column:
    """JSON type of a variant."""
    word = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    out = None
    for kind, words in _TYPES.items():
        if kind != "number":
            out = F.when(word.isin(*words), kind) if out is None else out.when(word.isin(*words), kind)
    return out.otherwise("number")


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``errors`` to calls (name, arguments), sorted texts: none means valid.

    ``not_json``, ``not_object``, ``unknown_tool``, ``missing:p``, ``type:p``, ``unknown:p``. A tool's schema is one
    small array; the join is on the tool's name.
    """
    tools = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("parameter", "type", "required"))).alias("spec"))
    parsed = calls.join(tools, "name", "left").withColumn("tree", F.try_parse_json("arguments"))
    is_object = F.coalesce(_kind(F.col("tree")) == "object", F.lit(False))
    parsed = parsed.withColumn("fields", F.when(is_object, F.col("tree").cast("map<string,variant>")))

    def check(s: Column) -> Column:
        value = F.try_element_at("fields", s["parameter"])
        kind = _kind(value)
        wrong = (kind != s["type"]) & ~((s["type"] == "number") & (kind == "integer"))
        return F.when(value.isNull(), F.when(s["required"], F.concat(F.lit("missing:"), s["parameter"]))).when(
            wrong, F.concat(F.lit("type:"), s["parameter"]))

    known = F.transform("spec", lambda s: s["parameter"])
    other = F.transform(F.filter(F.map_keys("fields"), lambda k: ~F.array_contains(known, k)),
                        lambda k: F.concat(F.lit("unknown:"), k))
    found = F.sort_array(F.concat(F.filter(F.transform("spec", check), lambda e: e.isNotNull()), other))
    errors = (F.when(F.col("tree").isNull(), F.array(F.lit("not_json"))).when(~is_object, F.array(F.lit("not_object")))
              .when(F.col("spec").isNull(), F.array(F.lit("unknown_tool"))).otherwise(found))
    return parsed.withColumn("errors", errors).drop("spec", "tree", "fields")


def _roots(single: DataFrame) -> DataFrame:
    """Follow (node, parent) of nodes with one parent to the first ancestor that isn't such a node, by pointer doubling.

    ``order_turn`` and ``order_level`` become the least the path allows, ``steps`` its length. As many rounds as the
    logarithm of the longest path; nodes on a cycle or behind one keep some parent that is itself in the table.
    """
    spark, mark = single.sparkSession, stored_so_far()
    at = cut_lineage(single.withColumns({"steps": F.lit(1), "moved": F.lit(True)}))
    moving = at.count()
    while moving:
        above = at.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("order_turn").alias("its_turn"),
                          F.col("order_level").alias("its_level"), F.col("steps").alias("its_steps"))
        at = cut_lineage(at.join(above, "parent", "left").select(
            "node", F.coalesce("next", "parent").alias("parent"), F.greatest("order_turn", "its_turn").alias("order_turn"),
            F.greatest("order_level", F.col("its_level") + F.col("steps")).alias("order_level"),
            (F.col("steps") + F.coalesce("its_steps", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        discard(spark, mark, 1)
        still = at.where("moved").count()
        if still == moving:  # no path ended in this round, so none of those left ever ends
            break
        moving = still
    return at.drop("moved")


def ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, order_turn, order_level) of a directed graph: by these, then turn, parents stand before children.

    ``nodes``: node, turn. ``edges``: distinct node, parent; an edge to an unknown parent is ignored. The turn is the
    node's own, or a parent's if that is later, so a well-ordered conversation stays as it is; the level is the length
    of the longest chain above the node. Each round settles all nodes whose parents are settled, and whatever hangs
    below them by single parents however long that chain is: as many rounds as there are nodes with several unsettled
    parents on one path. Nodes on a cycle or behind one, and no others, get a null level.
    """
    edges = cut_lineage(edges.join(nodes.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select("node", "parent"))
    start = nodes.withColumns({"order_turn": F.col("turn").cast("bigint"), "order_level": F.lit(0)})
    news = cut_lineage(start.join(edges.select("node").distinct(), "node", "left_anti").select("node", "order_turn", "order_level"))
    waiting = start.join(edges.groupBy("node").agg(F.count("*").alias("open")), "node")
    done = [news]
    while True:
        closed = edges.join(news.select(F.col("node").alias("parent"), "order_turn", "order_level"), "parent").groupBy("node").agg(
            F.count("*").alias("closed"), F.max("order_turn").alias("its_turn"), (F.max("order_level") + 1).alias("its_level"))
        waiting = cut_lineage(waiting.join(closed, "node", "left").select(
            "node", "turn", F.greatest("order_turn", "its_turn").alias("order_turn"),
            F.greatest("order_level", "its_level").alias("order_level"), (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")))
        if waiting.isEmpty():
            break
        edges = cut_lineage(edges.join(news.select(F.col("node").alias("parent")), "parent", "left_anti"))
        free = waiting.where("open = 0").select("node", "order_turn", "order_level")
        below = _roots(waiting.where("open = 1").join(edges, "node").select("node", "parent", "order_turn", "order_level"))
        root = free.select(F.col("node").alias("parent"), F.col("order_turn").alias("its_turn"), F.col("order_level").alias("its_level"))
        news = cut_lineage(free.unionByName(below.join(root, "parent").select(
            "node", F.greatest("order_turn", "its_turn").alias("order_turn"),
            F.greatest("order_level", F.col("its_level") + F.col("steps")).alias("order_level"))))
        if news.isEmpty():
            break
        done.append(news)
        if len(done) > 30:  # keeps the plan short
            done = [cut_lineage(reduce(DataFrame.unionByName, done))]
        waiting = waiting.join(news.select("node"), "node", "left_anti")
    return reduce(DataFrame.unionByName, done).unionByName(waiting.select(
        "node", F.col("turn").cast("bigint").alias("order_turn"), F.lit(None).cast("int").alias("order_level")))


def link(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame,
         needs: DataFrame | None = None) -> DataFrame:
    """One row for each message, call and result, linked, ordered, checked and serialised.

    ``messages``: conv_id, turn, role, text. ``calls``: conv_id, turn, call_id, name, arguments (JSON text).
    ``results``: conv_id, turn, call_id, content. ``needs``: conv_id, call_id, needed_id, a call that uses another
    call's result. Other columns are ignored.

    Returns conv_id, turn, kind, call_id, status, errors, order_turn, order_level, json. ``status`` of a call is
    ``linked``, ``no_result`` or ``repeated`` (its id occurs on several rows), of a result ``linked``, ``no_call`` or
    ``repeated``, of a message ``plain``; ``cycle`` where the needs go round. Rows with a null conversation or call id
    link to nothing. Repeated rows stay. Null texts are JSON null.
    """
    id_ = F.to_json(F.struct("conv_id", "call_id"))
    calls = validated(calls.select("conv_id", "turn", "call_id", "name", "arguments"), schemas).withColumn("id", id_)
    results = results.select("conv_id", "turn", "call_id", "content").withColumn("id", id_)
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    # one row for each identifier on either side, so that the join's sides are unique whatever is repeated
    c = calls.where(whole).groupBy("id").agg(F.count("*").alias("call_rows"), F.min("turn").alias("call_turn"))
    r = results.where(whole).groupBy("id").agg(F.count("*").alias("result_rows"), F.min("turn").alias("result_turn"))
    links = cut_lineage(c.join(r, "id", "full"))

    nodes = links.where("call_rows IS NOT NULL").select(F.concat(F.lit("c"), "id").alias("node"), F.col("call_turn").alias("turn"))
    nodes = nodes.unionByName(links.where("result_rows IS NOT NULL").select(
        F.concat(F.lit("r"), "id").alias("node"), F.col("result_turn").alias("turn")))
    edges = links.where("call_rows IS NOT NULL AND result_rows IS NOT NULL").select(
        F.concat(F.lit("r"), "id").alias("node"), F.concat(F.lit("c"), "id").alias("parent"))
    if needs is not None:
        other = F.to_json(F.struct("conv_id", F.col("needed_id").alias("call_id")))
        edges = edges.unionByName(needs.where(whole & F.col("needed_id").isNotNull()).select(
            F.concat(F.lit("c"), id_).alias("node"), F.concat(F.lit("r"), other).alias("parent")).distinct())
    order = ordered(cut_lineage(nodes), edges)

    def line(*fields: Column) -> Column:
        return canonical(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))

    def placed(rows: DataFrame, kind: str, lone: str) -> DataFrame:
        rows = rows.withColumn("node", F.concat(F.lit(kind[0]), F.when(whole, F.col("id"))))
        rows = rows.join(links, "id", "left").join(order, "node", "left")
        mine, its = f"{kind}_rows", "result_rows" if kind == "call" else "call_rows"
        cyclic = F.col("order_turn").isNotNull() & F.col("order_level").isNull()
        status = (F.when(F.col(mine) > 1, "repeated").when(cyclic, "cycle")
                  .when(F.col(mine).isNotNull() & F.col(its).isNotNull(), "linked").otherwise(lone))
        return rows.withColumns({"status": status, "kind": F.lit(kind),
                                 "order_turn": F.coalesce("order_turn", F.col("turn").cast("bigint"))})

    plain = messages.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit("plain").alias("status"), F.array().cast("array<string>").alias("errors"),
        F.col("turn").cast("bigint").alias("order_turn"), F.lit(0).alias("order_level"),
        line(F.col("role"), F.col("text").alias("content")).alias("json"))
    tree = F.coalesce(canonical(F.col("arguments")), F.lit("null"))
    call_json = F.concat(F.lit('{"arguments":'), tree, F.lit(',"call":'), F.regexp_replace(
        line(F.col("call_id"), F.col("name")), r"^\{", "{"), F.lit("}"))
    called = placed(calls, "call", "no_result").withColumn("json", call_json)
    answered = placed(results, "result", "no_call").withColumns({
        "errors": F.array().cast("array<string>"), "json": line(F.col("call_id"), F.col("content"), F.lit("tool").alias("role"))})
    columns = ["conv_id", "turn", "kind", "call_id", "status", "errors", "order_turn", "order_level", "json"]
    return plain.unionByName(called.select(columns)).unionByName(answered.select(columns))
