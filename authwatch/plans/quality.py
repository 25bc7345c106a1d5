"""Quality reports as aggregate tables (rows of section, name, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import micros_of
from ..operators.ranks import nearest_rank, select_ranks
from ..schema import NOVELTY_FEATURES

DISTRIBUTIONS = (
    "authentication_method", "authentication_outcome", "failure_reason", "mfa_outcome",
    "country_code", "client_type",
)
_NEAR_ZERO = 1e-12


def event_summary(events: DataFrame) -> DataFrame:
    """One row: volume, duplicates, span, hourly rate and distinct entities."""
    us = micros_of(F.col("event_time"))
    base = events.agg(
        F.count("*").alias("row_count"), F.min(us).alias("first_us"), F.max(us).alias("last_us"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_rate_{c}") for c in events.columns])
    # Distinct counts over exploded (column, value) pairs: one shuffle, no wide expand.
    names = {"event_id": "event_ids", "user_id": "users", "source_id": "sources", "device_id": "devices",
             "application_id": "applications"}
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("v")) for c, n in names.items()])
    distinct = events.select(F.explode(pairs).alias("p")).where("p.v IS NOT NULL").groupBy("p.n", "p.v").agg(
        F.lit(1).alias("one")).groupBy("n").agg(F.count("*").alias("c"))
    counts = distinct.agg(*[
        F.coalesce(F.max(F.when(F.col("n") == n, F.col("c"))), F.lit(0)).alias(f"unique_{n}")
        for n in names.values()])
    hours = (F.col("last_us") - F.col("first_us")) / 3.6e9
    rows = F.col("row_count")
    return base.join(F.broadcast(counts)).select(
        "row_count", (rows - F.col("unique_event_ids")).alias("duplicate_event_ids"), "first_us", "last_us",
        F.when(hours > 0, rows / hours).otherwise(rows.cast("double")).alias("event_rate_per_hour"),
        "unique_users", "unique_sources", "unique_devices", "unique_applications",
        *[f"null_rate_{c}" for c in events.columns])


def distributions(events: DataFrame, top_countries: int | None = None) -> DataFrame:
    """(field, value, events); with ``top_countries`` only the most frequent countries."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in DISTRIBUTIONS])
    counts = events.select(F.explode(pairs).alias("p")).where("p.value IS NOT NULL").groupBy(
        "p.field", "p.value").agg(F.count("*").alias("events"))
    if top_countries is None:
        return counts
    order = Window.partitionBy("field").orderBy(F.desc("events"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("field") != "country_code") | (F.col("rank") <= top_countries)).drop("rank")


def response_time(events: DataFrame) -> DataFrame:
    """One row: min, max, mean and linearly interpolated p50 and p95."""
    base = events.agg(
        F.min("response_time_ms").cast("double").alias("rt_min"),
        F.max("response_time_ms").cast("double").alias("rt_max"), F.avg("response_time_ms").alias("rt_mean"),
        F.count("response_time_ms").alias("rt_count"))
    n = F.col("__n")

    def position(f: float):
        return (n - 1) * F.lit(f)

    ranks = {}
    for name, f in (("p50", 0.5), ("p95", 0.95)):
        ranks[f"{name}_lo"] = F.floor(position(f)) + 1
        ranks[f"{name}_hi"] = F.ceil(position(f)) + 1
    picked = select_ranks(events, [], "response_time_ms", ranks)
    out = base.join(F.broadcast(picked))

    def blend(name: str, f: float):
        at = (F.col("rt_count") - 1) * F.lit(f)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(f"rt_{name}")

    return out.select("rt_min", "rt_max", "rt_mean", blend("p50", 0.5), blend("p95", 0.95))


def ground_truth_summary(truth: DataFrame) -> DataFrame:
    return truth.groupBy("scenario").agg(
        F.count("*").alias("events"), F.count_if("malicious").alias("malicious"),
        F.count_if("supervised_training_eligible").alias("eligible"))


def feature_quality(snapshot: DataFrame) -> DataFrame:
    """Per snapshot column: null rate, and range, mean, variance flags and infinities of numbers."""
    numeric = {n for n, t in snapshot.dtypes if t in ("bigint", "double")}
    aggs, stacks = [], []
    for i, (name, dtype) in enumerate(snapshot.dtypes):
        aggs.append(f"avg(cast({name} IS NULL as double)) AS n{i}")
        if name in numeric:
            # Moments over finite values only, shifted by nothing: counts are exact in double here.
            finite = f"CASE WHEN abs(cast({name} as double)) < double('Infinity') THEN cast({name} as double) END"
            aggs += [f"min({finite}) AS lo{i}", f"max({finite}) AS hi{i}", f"avg({finite}) AS av{i}",
                     f"var_pop({finite}) AS va{i}",
                     f"count_if(abs(cast({name} as double)) = double('Infinity')) AS in{i}"]
            stacks.append(f"'{name}', n{i}, lo{i}, hi{i}, av{i}, va{i}, in{i}")
        else:
            null = "cast(null as double)"
            stacks.append(f"'{name}', n{i}, {null}, {null}, {null}, {null}, 0L")
    wide = snapshot.agg(*[F.expr(a) for a in aggs])
    rows = wide.selectExpr(
        f"stack({len(stacks)}, {', '.join(stacks)}) AS "
        "(feature, null_rate, min_value, max_value, mean_value, variance, infinities)")
    return rows.selectExpr(
        "feature", "null_rate", "min_value", "max_value", "mean_value", "infinities",
        "min_value = max_value AS zero_variance",
        f"min_value != max_value AND variance < {_NEAR_ZERO}D AS near_zero_variance")


def baseline_coverage(snapshot: DataFrame) -> DataFrame:
    """One row: share of covered anchors and, among the judged ones, of novel contexts."""
    return snapshot.agg(
        F.avg(F.col("user_in_baseline").cast("double")).alias("user_coverage"),
        F.avg(F.col("source_in_baseline").cast("double")).alias("source_coverage"),
        *[F.avg(F.col(n).cast("double")).alias(f"{n}_rate") for n in NOVELTY_FEATURES])


def geo_status_rates(snapshot: DataFrame) -> DataFrame:
    counts = snapshot.groupBy(F.col("user_previous_success_geo__status").alias("status")).agg(
        F.count("*").alias("anchors"))
    return counts.select("status", "anchors", (F.col("anchors") / F.sum("anchors").over(Window.partitionBy())).alias("share"))


def detection_counts(detections: DataFrame) -> DataFrame:
    """Fired rows per rule, family, category and severity as (dimension, value, detections)."""
    dims = ("rule_id", "rule_family", "attack_category", "severity")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    return detections.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(
        F.count("*").alias("detections"))


def five_numbers(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Min, nearest-rank median, mean, nearest-rank p90 and max of a numeric column."""
    keys = keys or []
    base = df.groupBy(*keys).agg(
        F.count(column).alias("n"), F.min(column).alias("min_value"), F.avg(column).alias("mean_value"),
        F.max(column).alias("max_value"))
    picked = select_ranks(
        df, keys, column, {"median_value": nearest_rank(0.5), "p90_value": nearest_rank(0.9)})
    joined = base.join(picked, keys, "left") if keys else base.join(F.broadcast(picked))
    return joined.select(*keys, "n", "min_value", "median_value", "mean_value", "p90_value", "max_value")


def detection_report(
    detections: DataFrame, assessments: DataFrame, alerts: DataFrame, suppressed: DataFrame | None = None
) -> DataFrame:
    """(section, name, value).  Without ``suppressed`` (tables only) those counters are null, not zero."""
    text = lambda c: F.col(c).cast("string")
    out = detection_counts(detections).select(
        F.concat(F.lit("detections_by_"), "dimension").alias("section"), F.col("value").alias("name"),
        F.col("detections").cast("double").alias("value"))
    severities = assessments.groupBy("severity").agg(F.count("*").alias("v"))
    out = out.unionByName(severities.select(F.lit("assessments_by_severity").alias("section"),
                                            F.col("severity").alias("name"), F.col("v").cast("double").alias("value")))
    for section, df, column in (
        ("risk_score", assessments.where("fired_rule_count > 0"), "risk_score"),
        ("signal_strength", detections, "signal_strength"),
        ("alert_peak_risk", alerts, "peak_risk_score"),
        ("alert_size", alerts, "contributing_event_count"),
    ):
        five = five_numbers(df, column)
        out = out.unionByName(five.selectExpr(
            f"'{section}' AS section",
            "stack(6, 'count', cast(n as double), 'min', cast(min_value as double), 'median', "
            "cast(median_value as double), 'mean', mean_value, 'p90', cast(p90_value as double), "
            "'max', cast(max_value as double)) AS (name, value)"))
    reasons = ("cooldown", "rate_limit", "below_score_floor", "below_severity_floor")
    if suppressed is None:
        spark = detections.sparkSession
        unseen = spark.createDataFrame([("suppressed", r, None) for r in reasons],
                                       "section string, name string, value double")
    else:
        unseen = suppressed.groupBy("reason").agg(F.sum("events").alias("v")).select(
            F.lit("suppressed").alias("section"), text("reason").alias("name"), F.col("v").cast("double").alias("value"))
    return out.unionByName(unseen)
