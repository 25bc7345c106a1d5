"""URL rules by a sort-merge range join (operator 1, DataFrame operations only).

A host is turned round ("www.example.com" becomes "com.example.www."), so the hosts under a rule's host are exactly the
keys that begin with the rule's key: an interval. The same holds for a path below its beginning. Intervals of
prefixes nest or are apart, so one sorted sweep over interval borders and points needs only a stack: a border of an
interval carries the rule on top of the stack behind it, and each point takes the last border before it.

The sweep runs in range partitions of the sorted keys; the top of the stack at a partition's start is the last border of the
partitions before it, found from one row for each partition. Points are distinct keys, so a host or url that
holds a third of all rows is one point. Keys are compared as UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authwatch.llm.columns import free_name
from authwatch.runtime import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to /, ? or #, with A-Z lower-cased; then the path up to ? or #.

    Both are empty for a null url or one without ://.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    whole = F.regexp_extract(rest, r"(?s)\A[^?#]*", 0)
    host = F.regexp_extract(whole, r"(?s)\A[^/]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(whole, r"(?s)/.*\z", 0)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each ended by a dot; equal or deeper hosts begin with it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def innermost(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The longest prefix that each distinct point begins with: (key, found), found null where there is none.

    ``points``: distinct binary ``key``. ``prefixes``: distinct binary ``prefix`` and ``parent``, the longest other
    prefix that it begins with. No byte of a key may be 0xFF, as in UTF-8.
    """
    border = F.struct(F.col("prefix").alias("top"))
    events = points.select("key", F.lit(1).alias("kind"), F.lit(None).cast("struct<top:binary>").alias("border"))
    events = events.unionByName(prefixes.select(
        F.col("prefix").alias("key"), F.lit(0).alias("kind"), border.alias("border")))
    events = events.unionByName(prefixes.select(
        F.concat("prefix", F.lit(b"\xff")).alias("key"), F.lit(0).alias("kind"),
        F.struct(F.col("parent").alias("top")).alias("border")))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored once: the numbers of range partitions must be the same for both readers below
    events = cut_lineage(events.repartitionByRange(n, "key", "kind").withColumn("part", F.spark_partition_id()))
    last = events.where("kind = 0").groupBy("part").agg(F.max_by("border", "key").alias("border"))
    ends = events.select("part").distinct().join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    carry = ends.select("part", F.last("border", True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("border", F.last("border", True).over(sweep)).where("kind = 1")
    return swept.join(F.broadcast(carry), "part").select(
        "key", F.coalesce("border", "carried")["top"].alias("found"))


def _parents(prefixes: DataFrame, shorter: Column) -> DataFrame:
    """Add ``parent`` to distinct prefixes, given the array of all shorter beginnings that may be prefixes."""
    pairs = prefixes.select("prefix", F.explode(shorter).alias("parent"))
    found = pairs.join(prefixes.select(F.col("prefix").alias("parent")), "parent").groupBy("prefix").agg(
        F.max_by("parent", F.length("parent")).alias("parent"))
    return prefixes.select("prefix").join(found, "prefix", "left")


def _chain(key: Column) -> Column:
    """All beginnings of a host key that end in a dot, itself included."""
    labels = F.split(key, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels) - 1),
                       lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))


def classify(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to the pages (in place of columns of those names).

    ``rules``: host, path, action. A rule fits its host and all subdomains where the path begins with the rule's;
    the longest host + path wins, then the longer host. Of rules with the same host and path the greatest action
    counts (block over allow). Rules with a null take no part. Without a fitting rule, ``rule`` is null and
    ``verdict`` is ``default``. Every row of pages gives one row, also null, empty and repeated urls.
    """
    host, path = url_parts(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND action IS NOT NULL").select(
        host_key(F.translate("host", _UPPER, _LOWER)).alias("host_key"), F.concat("host", "path").alias("rule"),
        "path", "action").groupBy("host_key", "path").agg(F.max("action").alias("action"), F.max("rule").alias("rule"))

    urls = pages.select("host", "path").distinct().withColumn("host_key", host_key(F.col("host")))
    top = rules.select("host_key").distinct()
    top = _parents(top.select(F.encode("host_key", "UTF-8").alias("prefix")), F.transform(
        F.filter(_chain(F.decode("prefix", "UTF-8")), lambda k: k != F.decode("prefix", "UTF-8")),
        lambda k: F.encode(k, "UTF-8")))
    hosts = innermost(urls.select(F.encode("host_key", "UTF-8").alias("key")).distinct(), top).where(
        "found IS NOT NULL")
    # the stack of a host is its innermost rule host and those above it
    stacks = top.select("prefix", F.explode(_chain(F.decode("prefix", "UTF-8"))).alias("host_key")).join(
        rules.select("host_key").distinct(), "host_key")
    hosts = hosts.join(stacks, F.col("found") == F.col("prefix")).select(
        F.decode("key", "UTF-8").alias("host_key"), F.col("host_key").alias("rule_host"))

    def pair(h: str, p: str) -> Column:
        return F.concat(F.encode(h, "UTF-8"), F.lit(b"\x00"), F.encode(p, "UTF-8"))

    active = urls.join(hosts, "host_key").withColumn("key", pair("rule_host", "path"))
    paths = rules.withColumn("prefix", pair("host_key", "path"))
    shorter = F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda i: F.concat(
        F.encode("host_key", "UTF-8"), F.lit(b"\x00"), F.encode(F.substring(F.col("path"), F.lit(1), i), "UTF-8")))
    nested = _parents(paths, F.when(F.length("path") > 0, shorter).otherwise(F.array().cast("array<binary>")))
    best = innermost(active.select("key").distinct(), nested).where("found IS NOT NULL").join(
        paths.select(F.col("prefix").alias("found"), "rule", "action",
                     F.struct(F.length("rule"), F.length("host_key")).alias("rank")), "found")
    verdicts = active.join(best, "key").groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "action"), "rank").alias("won"))
    won = free_name(pages, "won")
    verdicts = verdicts.withColumnRenamed("won", won)
    return pages.join(verdicts, ["host", "path"], "left").withColumns({
        "rule": F.col(won)["rule"], "verdict": F.coalesce(F.col(won)["action"], F.lit(default))}).drop(won)
