"""Risk assessment: correlation-aware noisy-OR over the fired rules of an anchor.

Works on the per-anchor verdict array, so scoring is row-wise and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig, config_fingerprint
from ..schema import CORRELATION_GROUPS, RISK_ASSESSMENTS, SCHEMA_VERSION, SEVERITIES
from .rules import META, STORED, evaluate_rules, lit, rules_for, status_sql, strength


def severity_sql(score: str, config: DetectionConfig) -> str:
    s = config.scoring
    return (
        f"CASE WHEN {score} >= {lit(float(s.critical))} THEN 'critical' "
        f"WHEN {score} >= {lit(float(s.high))} THEN 'high' "
        f"WHEN {score} >= {lit(float(s.medium))} THEN 'medium' ELSE 'low' END"
    )


def severity_rank(column: str) -> str:
    return "CASE {} {} END".format(column, " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)))


def _group_value(group: str, config: DetectionConfig) -> str:
    values = f"transform(filter(fired, r -> r.correlation_group = '{group}'), r -> r.weight * r.signal_strength)"
    if config.scoring.correlation_reducer == "max":
        return f"coalesce(array_max({values}), 0D)"
    # Ascending order fixes the floating-point result.
    return f"1D - aggregate(sort_array({values}), 1D, (acc, v) -> acc * (1D - v))"


def _by_slot(rows: DataFrame, slots: int, config: DetectionConfig) -> tuple[DataFrame, dict[str, str]]:
    """What scores are made of, from each of the array's places: compiled code, where functions over elements are interpreted."""
    at = range(slots)
    rows = rows.selectExpr("*", *[f"get(results, {i}) AS __r{i}" for i in at])
    rows = rows.selectExpr(
        *rows.columns[:-slots], *[f"__r{i}.status AS __s{i}" for i in at], *[f"__r{i}.correlation_group AS __g{i}" for i in at],
        *[f"CASE WHEN __r{i}.status = 'fired' THEN __r{i}.weight * __r{i}.signal_strength END AS __c{i}" for i in at],
        *[f"CASE WHEN __r{i}.status = 'fired' THEN __r{i}.rule_id END AS __id{i}" for i in at],
        *[f"CASE WHEN __r{i}.status = 'fired' THEN named_struct('c', -(__r{i}.weight * __r{i}.signal_strength), 'v', -__r{i}.severity_rank, "
          f"'s', -__r{i}.signal_strength, 'rule_id', __r{i}.rule_id, 'category', __r{i}.attack_category) END AS __k{i}" for i in at])
    return _slot_values(rows, slots)


def _slot_values(rows: DataFrame, slots: int) -> tuple[DataFrame, dict[str, str]]:
    """From each slot's status, correlation group, contribution, fired id and rank (``__s``, ``__g``, ``__c``, ``__id``, ``__k``)."""
    at = range(slots)
    count = {s: " + ".join(f"CASE WHEN __s{i} = '{s}' THEN 1 ELSE 0 END" for i in at) for s in ("fired", "insufficient_data")}
    rows = rows.selectExpr("*", f"{count['fired']} AS __n")
    # A missing verdict comes first in the sorted ids; the leading null lets a single slot have a greatest value too.
    ids = ", ".join(f"__id{i}" for i in at)
    values = {
        "fired_count": "__n", "insufficient": count["insufficient_data"],
        "ids": f"slice(sort_array(array({ids})), {slots + 1} - __n, __n)",
        "category": f"least(__k0, {', '.join(f'__k{i}' for i in at)}).category",
        **{g: "coalesce(greatest(cast(null as double), {}), 0D)".format(", ".join(f"CASE WHEN __g{i} = '{g}' THEN __c{i} END" for i in at))
           for g in CORRELATION_GROUPS},
    }
    return rows, values


def _score_sql(values: dict[str, str], config: DetectionConfig) -> str:
    s = config.scoring
    residual = " * ".join(f"(1D - ({values[g]}))" for g in CORRELATION_GROUPS)
    combined = f"least(1D, greatest(0D, 1D - {residual}))"
    return (
        f"CASE WHEN {values['fired_count']} = 0 THEN 0D ELSE "
        f"least(100D, greatest({lit(float(s.min_fired_risk_score))}, bround(100D * {combined}, {s.round_decimals}))) END"
    )


#: What ``score_snapshot`` returns of an assessment.
PLAIN = ("anchor_event_id", "anchor_event_time", "risk_score", "severity", "primary_attack_category", "fired_rule_count", "fired_rule_ids",
         "insufficient_data_count")


def score_snapshot(snapshot: DataFrame, config: DetectionConfig | None = None) -> DataFrame:
    """The columns ``PLAIN`` of each anchor's assessment, as ``evaluate_rules`` and ``score_results`` give them.

    Statuses and strengths are columns, no verdict is built; what a reader leaves out is not computed.
    """
    config = config or DetectionConfig()
    if config.scoring.correlation_reducer != "max":
        return score_results(evaluate_rules(snapshot, config, explain=False), config).select(*PLAIN)
    rules = list(enumerate(rules_for(snapshot, config)))
    rows = snapshot.selectExpr("*", *[f"{status_sql(r)} AS __s{i}" for i, r in rules])
    rows = rows.selectExpr(
        "anchor_event_id", "anchor_event_time", *[f"__s{i}" for i, _ in rules],
        *[f"CASE WHEN __s{i} = 'fired' THEN {strength(r.components, config.signal)} END AS __v{i}" for i, r in rules])
    weight = {i: lit(float(config.family_weights[r.family])) for i, r in rules}
    rows = rows.selectExpr(
        "anchor_event_id", "anchor_event_time", *[f"__s{i}" for i, _ in rules], *[f"'{r.group}' AS __g{i}" for i, r in rules],
        *[f"{weight[i]} * __v{i} AS __c{i}" for i, _ in rules], *[f"CASE WHEN __s{i} = 'fired' THEN '{r.rule_id}' END AS __id{i}" for i, r in rules],
        *[f"CASE WHEN __s{i} = 'fired' THEN named_struct('c', -({weight[i]} * __v{i}), 'v', {-SEVERITIES.index(r.severity)}, 's', -__v{i}, "
          f"'rule_id', '{r.rule_id}', 'category', '{r.category}') END AS __k{i}" for i, r in rules])
    rows, values = _slot_values(rows, len(rules))
    return rows.selectExpr("*", f"{_score_sql(values, config)} AS risk_score").selectExpr(
        "anchor_event_id", "anchor_event_time", "risk_score", f"{severity_sql('risk_score', config)} AS severity",
        f"{values['category']} AS primary_attack_category", f"cast({values['fired_count']} as bigint) AS fired_rule_count",
        f"{values['ids']} AS fired_rule_ids", f"cast({values['insufficient']} as bigint) AS insufficient_data_count")


def score_results(results: DataFrame, config: DetectionConfig | None = None, slots: int | None = None) -> DataFrame:
    """One assessment per evaluated anchor, zero scores included.

    ``slots``, if known, is the most verdicts an anchor's array can hold; each place is then read by itself.
    """
    config = config or DetectionConfig()
    s = config.scoring
    values = {
        "fired_count": "size(fired)", "insufficient": f"size(filter({STORED}, r -> r.status = 'insufficient_data'))",
        "ids": "array_sort(transform(fired, r -> r.rule_id))", "category": "CASE WHEN size(ranked) > 0 THEN ranked[0].category END",
        **{g: _group_value(g, config) for g in CORRELATION_GROUPS},
    }
    if slots and config.scoring.correlation_reducer == "max":
        results, values = _by_slot(results, slots, config)
    rows = results.selectExpr("*", f"filter({STORED}, r -> r.status = 'fired') AS fired")
    score = _score_sql(values, config)
    ranked = (
        "sort_array(transform(fired, r -> named_struct('c', -(r.weight * r.signal_strength), "
        "'v', -r.severity_rank, 's', -r.signal_strength, 'rule_id', r.rule_id, "
        "'category', r.attack_category, 'evidence', r.evidence)))"
    )
    rows = rows.selectExpr("*", f"{score} AS risk_score", f"{ranked} AS ranked")
    return rows.selectExpr(
        f"'{SCHEMA_VERSION}' AS detection_schema_version", "anchor_event_id", "anchor_event_time", "risk_score",
        f"{severity_sql('risk_score', config)} AS severity",
        f"{values['category']} AS primary_attack_category",
        "array_sort(array_distinct(transform(fired, r -> r.attack_category))) AS contributing_categories",
        f"cast({values['fired_count']} as bigint) AS fired_rule_count",
        f"{values['ids']} AS fired_rule_ids",
        f"slice(flatten(transform(ranked, r -> r.evidence)), 1, {s.top_evidence_count}) AS top_evidence",
        f"cast({values['insufficient']} as bigint) AS insufficient_data_count",
        "'1.0.0' AS scoring_version",
        f"'{config_fingerprint(config)}' AS configuration_fingerprint",
    ).select(*RISK_ASSESSMENTS.names)


def strongest(detections: DataFrame) -> DataFrame:
    """One row per (anchor, rule): the strongest repeat as ``d``, the number of repeats, the earliest time.

    Among equally strong repeats the greatest row wins, field by field, so the choice does not depend on the order of rows.
    """
    row = F.struct("signal_strength", F.expr(severity_rank("severity")).alias("severity_rank"), "severity", "rule_family", "attack_category",
                   "correlation_group", "reason_codes", "evidence")
    return detections.groupBy("anchor_event_id", "rule_id").agg(
        F.max(row).alias("d"), F.count("*").alias("repeats"), F.min("anchor_event_time").alias("detected_at"))


def scoring_counters(detections: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row: assessed anchors, detections scored, repeats collapsed, and reductions (correlation groups, summed over anchors)."""
    per_anchor = strongest(detections).groupBy("anchor_event_id").agg(
        F.count("*").alias("scored"), F.sum(F.col("repeats") - 1).alias("collapsed"),
        F.size(F.collect_set("d.correlation_group")).cast("long").alias("reduced"))  # a fixed vocabulary
    zero = F.lit(0).cast("long")
    evaluated = anchors.select("anchor_event_id", zero.alias("scored"), zero.alias("collapsed"), zero.alias("reduced"))
    sums = per_anchor.unionByName(evaluated).groupBy("anchor_event_id").agg(*[F.max(c).alias(c) for c in ("scored", "collapsed", "reduced")])
    return sums.agg(
        F.count("*").alias("assessment_count"), F.coalesce(F.sum("scored"), zero).alias("scored_detection_count"),
        F.coalesce(F.sum("collapsed"), zero).alias("duplicate_detection_count"), F.coalesce(F.sum("reduced"), zero).alias("group_reductions"))


def results_from_detections(
    detections: DataFrame, anchors: DataFrame, config: DetectionConfig | None = None
) -> DataFrame:
    """Rebuild the verdict array from a stored detection table.

    Repeats of (anchor, rule) collapse to the strongest, see ``strongest``.  At most one entry per registered rule is
    gathered per anchor.  ``anchors`` is the evaluated inventory; anchors that only the detections know are assessed too.
    """
    config = config or DetectionConfig()
    weights = F.create_map(*[x for rule, (family, *_) in META.items() for x in (
        F.lit(rule), F.lit(float(config.family_weights.get(family, 0.0))))])
    entry = F.struct(
        "rule_id", "d.rule_family", "d.attack_category", "d.correlation_group", "d.severity",
        F.expr(severity_rank("d.severity")).alias("severity_rank"),
        weights[F.col("rule_id")].alias("weight"), F.lit("fired").alias("status"),
        "d.signal_strength", "d.evidence", "d.reason_codes")
    per_anchor = strongest(detections).select("anchor_event_id", "detected_at", entry.alias("r")).groupBy("anchor_event_id").agg(
        F.min("detected_at").alias("detected_at"), F.collect_list("r").alias("results"))
    joined = anchors.select("anchor_event_id", "anchor_event_time").join(per_anchor, "anchor_event_id", "full_outer").select(
        "anchor_event_id", F.coalesce("anchor_event_time", "detected_at").alias("anchor_event_time"), "results")
    empty = F.array().cast(joined.schema["results"].dataType)
    return joined.withColumn("results", F.coalesce("results", empty))


def scoring_stats(assessments: DataFrame) -> DataFrame:
    """Counts per severity, and how many anchors scored zero."""
    return assessments.groupBy("severity").agg(
        F.count("*").alias("anchors"),
        F.count_if(F.col("fired_rule_count") == 0).alias("zero_scores"),
        F.sum("fired_rule_count").alias("scored_detections"),
    )
