"""Whether the tables of one run still fit together: findings over detections, assessments, alerts and the evaluated anchors.

Tables that share a key are tagged, put under each other and grouped once by that key; the tags that a group holds tell what is missing,
repeated or orphaned. No pair of tables is joined for a check of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row for each key of any table with, per table, the number of its rows under that key. A null key is a key of its own."""
    stacked = reduce(DataFrame.unionByName, [
        df.select(F.col(key).alias("key"), F.lit(tag).alias("tag")) for tag, (df, key) in tables.items()])
    return stacked.groupBy("key").agg(*[F.count_if(F.col("tag") == tag).alias(tag) for tag in tables])


def anchor_relations(
    detections: DataFrame, assessments: DataFrame, anchors: DataFrame | None = None, scope: DataFrame | None = None,
) -> DataFrame:
    """(check, violations): anchors, not rows, of each kind of misfit. Tables that are not given have no check.

    Repeated detections of an anchor are its rules and no misfit; every other table holds an anchor once.
    """
    tables = {"detections": (detections, "anchor_event_id"), "assessments": (assessments, "anchor_event_id")}
    checks = {"ORPHANED_DETECTION_ANCHORS": "detections > 0 AND assessments = 0", "REPEATED_ASSESSMENTS": "assessments > 1"}
    for name, df in (("anchors", anchors), ("scope", scope)):
        if df is not None:
            tables[name] = (df, "anchor_event_id")
            checks |= {f"ASSESSMENTS_OUTSIDE_{name.upper()}": f"assessments > 0 AND {name} = 0",
                       f"{name.upper()}_WITHOUT_ASSESSMENT": f"assessments = 0 AND {name} > 0", f"REPEATED_{name.upper()}": f"{name} > 1"}
    found = tagged_counts(tables).agg(*[F.count_if(F.expr(rule)).alias(check) for check, rule in checks.items()])
    return _long(found, list(checks))


def alert_relations(detections: DataFrame, alerts: DataFrame, scope_expected: bool) -> DataFrame:
    """(check, violations): alerts that name a rule without any detection, and alerts with scope values where the run has no scope.

    Both tables shrink to their distinct rule ids before they are grouped; only alerts of rules that dangle are counted again.
    """
    named = alerts.select("alert_id", F.explode(F.array_distinct("contributing_rule_ids")).alias("rule_id"))
    rules = tagged_counts({"detected": (detections.select("rule_id").distinct(), "rule_id"),
                           "named": (named.select("rule_id").distinct(), "rule_id")})
    lost = rules.where("detected = 0").select(F.col("key").alias("rule_id"))
    dangling = named.join(lost, "rule_id").groupBy("alert_id").agg(F.lit(1).alias("one")).agg(F.count("*").alias("violations"))
    leaks = alerts.agg(F.count_if(F.col("scope_value").isNotNull() & F.lit(not scope_expected)).alias("violations"))
    return dangling.select(F.lit("DANGLING_ALERT_RULES").alias("check"), "violations").unionByName(
        leaks.select(F.lit("UNEXPECTED_ALERT_SCOPE").alias("check"), "violations"))


def run_relations(
    detections: DataFrame, assessments: DataFrame, alerts: DataFrame, scope_expected: bool,
    anchors: DataFrame | None = None, scope: DataFrame | None = None,
) -> DataFrame:
    """All findings of one run as (check, violations); a fitting run has only zeros, and so have empty tables."""
    return anchor_relations(detections, assessments, anchors, scope).unionByName(alert_relations(detections, alerts, scope_expected))


def _long(one_row: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in names])
    return one_row.select(F.explode(pairs).alias("p")).select("p.check", "p.violations")
