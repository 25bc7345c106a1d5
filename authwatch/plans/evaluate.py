"""Detection quality against ground truth; labels meet detections only here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import micros
from ..functions.scalar import micros_of
from ..operators.prefix import running, with_chunk
from ..operators.ranks import nearest_rank, select_ranks
from ..schema import SPLITS

# Which scenario each attack category claims (the MFA category claims none).
CATEGORY_TO_SCENARIO = {
    "brute_force": "brute_force",
    "password_spraying": "password_spraying",
    "credential_stuffing": "credential_stuffing",
    "distributed_brute_force": "distributed_brute_force",
    "account_takeover_indicator": "account_takeover_indicator",
    "impossible_travel_indicator": "impossible_travel",
    "bot_activity": "bot_activity",
}
CLASSES = sorted(CATEGORY_TO_SCENARIO.values())
NONE = "none"


def labelled(assessments: DataFrame, labels: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Assessments with a label, their split, actual class and predicted class."""
    rows = assessments.select(
        "anchor_event_id", "anchor_event_time", "fired_rule_count", "primary_attack_category",
        "insufficient_data_count",
    ).join(labels.selectExpr("event_id AS anchor_event_id", "attack_class", "malicious"), "anchor_event_id")
    if splits is not None:
        rows = rows.join(splits.selectExpr("event_id AS anchor_event_id", "split"), "anchor_event_id", "left")
    else:
        rows = rows.withColumn("split", F.lit(None).cast("string"))
    listed = ", ".join(f"'{c}'" for c in CLASSES)
    claim = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in CATEGORY_TO_SCENARIO.items())
    return rows.selectExpr(
        "*",
        f"CASE WHEN malicious AND attack_class IN ({listed}) THEN attack_class ELSE '{NONE}' END AS actual",
        f"coalesce(CASE primary_attack_category {claim} END, '{NONE}') AS predicted")


def _per_part(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums for each part (overall, and each split) and key.

    Events are summed once by split; only those few sums are added up again, so that no event is counted twice.
    """
    by_split = rows.groupBy("split", *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    parts = F.explode(F.array_compact(F.array(F.lit("overall"), F.col("split"))))
    return by_split.withColumn("part", parts).groupBy("part", *keys).agg(*[F.sum(n).alias(n) for n in sums])


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _div(top, bottom):
    return F.when(bottom != 0, top / bottom)


def rates(rows: DataFrame) -> DataFrame:
    bad, fired = F.col("malicious"), F.col("fired_rule_count") > 0
    sums = _per_part(rows, [], {
        "events": F.lit(1), "malicious": _one_if(bad), "benign": _one_if(~bad), "detected": _one_if(bad & fired),
        "false_positives": _one_if(~bad & fired), "insufficient": F.col("insufficient_data_count")})
    return sums.select(
        "part", "events", "malicious", "benign",
        _div(F.col("false_positives"), F.col("benign")).alias("false_positive_rate"),
        _div(F.col("detected"), F.col("malicious")).alias("detection_rate"),
        _div(F.col("insufficient"), F.col("events")).alias("insufficient_data_rate"))


def scenario_rates(rows: DataFrame) -> DataFrame:
    sums = _per_part(rows.where("malicious"), ["attack_class"], {"events": F.lit(1), "detected": _one_if(F.col("fired_rule_count") > 0)})
    return sums.select("part", "attack_class", "events", (F.col("detected") / F.col("events")).alias("detection_rate"))


def confusion(rows: DataFrame) -> DataFrame:
    """(part, actual, one column per predicted class)."""
    classes = [*CLASSES, NONE]
    return _per_part(rows, ["actual"], {f"predicted_{c}": _one_if(F.col("predicted") == c) for c in classes})


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; null where nothing was observed."""
    cells = _per_part(rows, ["actual", "predicted"], {"n": F.lit(1)})
    names = F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class")
    sums = cells.select("part", "actual", "predicted", "n", names).groupBy("part", "class").agg(
        *[F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name) for name, cond in (
            ("support", F.col("actual") == F.col("class")),
            ("predicted", F.col("predicted") == F.col("class")),
            ("true_positives", (F.col("actual") == F.col("class")) & (F.col("predicted") == F.col("class"))),
        )])
    p, r = _div(F.col("true_positives"), F.col("predicted")), _div(F.col("true_positives"), F.col("support"))
    sums = sums.select("*", p.alias("precision"), r.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return sums.withColumn("f1", F.when(both != 0, 2.0 * F.col("precision") * F.col("recall") / both))


def class_summary(metrics: DataFrame) -> DataFrame:
    """Macro means and support-weighted means over the classes of each part."""
    out = []
    for name in ("precision", "recall", "f1"):
        value = F.col(name)
        weight = F.sum(F.when(value.isNotNull(), F.col("support")))
        out.append(F.avg(value).alias(f"macro_{name}"))
        out.append(_div(F.sum(value * F.col("support")), weight).alias(f"weighted_{name}"))
    return metrics.groupBy("part").agg(*out)


def alert_metrics(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alert precision and recall, overall and per split.

    An alert is right when most assessments of its category inside its time range
    are malicious; a detectable malicious event is recalled when some alert of its
    category covers it.  Both are prefix counts on one timeline per category, so no
    range join is needed however long alerts are.  Every part judges all alerts by its own
    events; splits other than those of the schema count only overall.
    """
    parts = ["overall", *SPLITS]
    member = {p: F.lit(True) if p == "overall" else F.col("split") == p for p in parts}
    # Equal instants of a category merge before the running sums; each part has its own two columns.
    points = rows.where("primary_attack_category IS NOT NULL").groupBy(
        F.col("primary_attack_category").alias("category"), micros_of(F.col("anchor_event_time")).alias("us")).agg(
        *[F.count_if(m).alias(f"n_{p}") for p, m in member.items()], *[F.count_if(m & F.col("malicious")).alias(f"bad_{p}") for p, m in member.items()])
    sums = [f"{s}_{p}" for s in ("n", "bad") for p in parts]
    spans = alerts.select(
        "alert_id", F.col("attack_category").alias("category"),
        micros_of(F.col("first_seen")).alias("first_us"), micros_of(F.col("last_seen")).alias("last_us"))
    # Half ticks make both ends of a span inclusive.
    nothing, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    line = points.select("category", (F.col("us") * 2).alias("tick"), *sums, F.lit(0).alias("opened"), F.lit(0).alias("closed"),
                         none.alias("alert_id"), F.lit(0).alias("side"))
    for side, tick in ((1, F.col("first_us") * 2 - 1), (2, F.col("last_us") * 2 + 1)):
        line = line.unionByName(spans.select(
            "category", tick.alias("tick"), *[nothing.alias(c) for c in sums], F.lit(int(side == 1)).alias("opened"),
            F.lit(int(side == 2)).alias("closed"), "alert_id", F.lit(side).alias("side")))
    line = running(with_chunk(line, "tick", 2 * micros("1h")), ["category"], "tick", {
        **{f"seen_{c}": ("sum", c) for c in sums}, "open_before": ("sum", "opened"), "closed_before": ("sum", "closed")})
    sign = F.when(F.col("side") == 2, 1).otherwise(-1)
    judged = line.where("side > 0").groupBy("alert_id").agg(*[F.sum(sign * F.col(f"seen_{c}")).alias(c) for c in sums])
    right = judged.agg(F.count("*").alias("alerts"), *[
        F.count_if((F.col(f"n_{p}") > 0) & (2 * F.col(f"bad_{p}") > F.col(f"n_{p}"))).alias(f"correct_{p}") for p in parts])
    covered = line.where("side = 0 AND open_before > closed_before").agg(
        *[F.coalesce(F.sum(f"bad_{p}"), nothing).alias(f"covered_{p}") for p in parts])
    # Two single rows side by side, then a row for each part.
    by_part = right.join(F.broadcast(covered)).select("alerts", F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.col(f"correct_{p}").alias("correct_alerts"), F.col(f"covered_{p}").alias("covered")) for p in parts
    ])).alias("p")).select("alerts", "p.*")
    fired = F.col("fired_rule_count")
    detectable = _per_part(rows, [], {"events": F.lit(1), "detectable": _one_if(F.col("malicious") & (fired > 0)), "detections": fired})
    out = detectable.join(by_part, "part")
    alerts_n = F.col("alerts")
    return out.select(
        "part", "events", "alerts", "detectable",
        _div(F.col("correct_alerts"), alerts_n).alias("alert_precision"),
        F.when(alerts_n > 0, _div(F.col("covered"), F.col("detectable"))).alias("alert_recall"),
        (1000.0 * alerts_n / F.col("events")).alias("alerts_per_thousand_events"),
        _div(F.col("detections"), alerts_n).alias("duplicate_reduction_ratio"))


def campaign_latencies(rows: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Per malicious campaign: first event, and seconds until its first detection (null if missed)."""
    us = micros_of(F.col("anchor_event_time"))
    members = rows.where("malicious").join(
        campaigns.selectExpr("event_id AS anchor_event_id", "campaign_id"), "anchor_event_id")
    return members.groupBy("campaign_id").agg(
        F.count("*").alias("events"), F.min(us).alias("first_us"),
        F.min(F.when(F.col("fired_rule_count") > 0, us)).alias("first_fired_us"),
    ).select("campaign_id", "events", ((F.col("first_fired_us") - F.col("first_us")) / 1e6).alias("latency_seconds"))


def campaign_metrics(latencies: DataFrame) -> DataFrame:
    """One row: coverage and nearest-rank latency summary."""
    counts = latencies.agg(
        F.count("*").alias("campaigns"), F.count("latency_seconds").alias("detected"),
        F.min("latency_seconds").alias("latency_min"), F.avg("latency_seconds").alias("latency_mean"),
        F.max("latency_seconds").alias("latency_max"))
    micro = latencies.select((F.col("latency_seconds") * 1e6).cast("long").alias("v"))
    ranks = select_ranks(micro, [], "v", {"p50": nearest_rank(0.5), "p90": nearest_rank(0.9)}).select(
        (F.col("p50") / 1e6).alias("latency_median"), (F.col("p90") / 1e6).alias("latency_p90"))
    # Single-row aggregates side by side.
    return counts.join(F.broadcast(ranks)).select(
        "campaigns", "detected", (F.col("campaigns") - F.col("detected")).alias("missed"),
        _div(F.col("detected"), F.col("campaigns")).alias("coverage"),
        "latency_min", "latency_median", "latency_mean", "latency_p90", "latency_max")
