"""Chronological split: boundaries, assignment, campaign isolation, purge and embargo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuthwatchError, SplitConfig, micros
from ..functions.scalar import micros_of
from ..operators.ranks import select_ranks

_SUPERVISED = "split IN ('train', 'validation', 'test')"


def boundaries(events: DataFrame, config: SplitConfig) -> tuple[int, int, int]:
    """(train_end, validation_end, test_end) in microseconds.

    Fraction boundaries are the event times at two exact ranks, found by rank
    selection; only the three numbers reach the driver.
    """
    if config.mode == "boundaries":
        return config.train_end_us, config.validation_end_us, config.test_end_us
    us = events.select(micros_of(F.col("event_time")).alias("us"))

    def rank(fraction: float):
        return F.least(F.col("__n"), F.floor(F.col("__n") * F.lit(fraction)) + 1)

    row = select_ranks(us, [], "us", {
        "train_end": rank(config.train_fraction),
        "validation_end": rank(config.train_fraction + config.validation_fraction),
        "last": F.col("__n"),
    }).first()
    if row is None or row["last"] is None:
        raise AuthwatchError("cannot split an empty event set")
    ends = (row["train_end"], row["validation_end"], row["last"] + 1)
    if not ends[0] < ends[1] < ends[2]:
        raise AuthwatchError("the fractions do not yield three non-empty intervals")
    return ends


def assign(
    events: DataFrame, labels: DataFrame, config: SplitConfig, ends: tuple[int, int, int] | None = None
) -> DataFrame:
    """(event_id, split, exclusion_reason) for every event."""
    ends = ends or boundaries(events, config)
    train_end, validation_end, test_end = ends
    rows = events.select("event_id", micros_of(F.col("event_time")).alias("us")).join(
        labels.select("event_id", "campaign_id", "scenario", "supervised_training_eligible"), "event_id", "left")
    holdout = ", ".join(f"'{s}'" for s in config.holdout_scenarios)
    held = f"scenario IN ({holdout})" if holdout else "false"
    rows = rows.selectExpr(
        "event_id", "us", "campaign_id",
        f"CASE WHEN {held} OR NOT supervised_training_eligible THEN 'novel_anomaly_holdout' "
        f"WHEN us < {train_end}L THEN 'train' WHEN us < {validation_end}L THEN 'validation' "
        f"WHEN us < {test_end}L THEN 'test' ELSE 'excluded' END AS split",
        "scenario",
    )
    grouped = "scenario IS NOT NULL" + (
        " AND scenario != 'normal'" if config.normal_grouping == "singleton" else "")
    rows = rows.selectExpr(
        "event_id", "us", "split", f"CASE WHEN {grouped} THEN campaign_id END AS grp",
        "CASE WHEN split = 'excluded' THEN 'after_test_end' END AS reason")
    groups = rows.where("grp IS NOT NULL").groupBy("grp").agg(
        sum(F.max(F.when(F.col("split") == s, 1).otherwise(0)) for s in ("train", "validation", "test")).alias("spans"),
        F.min_by("split", F.struct("us", "event_id")).alias("first_split"),
    ).where("spans > 1")
    rows = rows.join(groups, "grp", "left")
    crossing = f"spans IS NOT NULL AND {_SUPERVISED}"
    if config.boundary_campaign_policy == "exclude":
        rows = rows.selectExpr(
            "event_id", "us", f"CASE WHEN {crossing} THEN 'excluded' ELSE split END AS split",
            f"CASE WHEN {crossing} THEN 'campaign_crosses_split_boundary' ELSE reason END AS reason")
    else:
        rows = rows.selectExpr(
            "event_id", "us", f"CASE WHEN {crossing} THEN first_split ELSE split END AS split",
            f"CASE WHEN {crossing} THEN NULL ELSE reason END AS reason")
    purge, embargo = micros(config.purge), micros(config.embargo)
    cases = []
    for edge in (train_end, validation_end):
        if purge > 0:
            cases.append(f"WHEN us >= {edge}L AND us < {edge + purge}L THEN 'purged_after_boundary'")
        if embargo > 0:
            cases.append(f"WHEN us >= {edge - embargo}L AND us < {edge}L THEN 'embargoed_before_boundary'")
    cut = f"CASE WHEN {_SUPERVISED} THEN CASE {' '.join(cases)} END END" if cases else "cast(null as string)"
    return rows.selectExpr("*", f"{cut} AS cut").selectExpr(
        "event_id", "CASE WHEN cut IS NOT NULL THEN 'excluded' ELSE split END AS split",
        "coalesce(cut, reason) AS exclusion_reason")


def manifest(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per split: events, classes, campaigns of attacks, and exclusions by reason."""
    rows = assignments.join(labels.select("event_id", "scenario", "malicious", "campaign_id"), "event_id", "left")
    counts = rows.groupBy("split").agg(
        F.count("*").alias("events"),
        F.count_if("malicious").alias("malicious"),
        F.count_if(~F.col("malicious")).alias("benign"),
        F.count_if(F.col("malicious").isNull()).alias("unlabelled"),
        *[F.count_if(F.col("exclusion_reason") == r).alias(r) for r in (
            "after_test_end", "campaign_crosses_split_boundary", "purged_after_boundary",
            "embargoed_before_boundary")],
    )
    campaigns = rows.where("scenario != 'normal'").groupBy("split", "campaign_id").agg(
        F.lit(1).alias("one")).groupBy("split").agg(F.count("*").alias("campaigns"))
    return counts.join(campaigns, "split", "left").fillna(0, ["campaigns"])


def scenario_distribution(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    return assignments.join(labels.select("event_id", "scenario"), "event_id").groupBy(
        "split", "scenario").agg(F.count("*").alias("events"))


def check_exclusions(assignments: DataFrame, config: SplitConfig) -> None:
    row = assignments.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "excluded").alias("x")).first()
    if row.n and row.x / row.n > config.max_excluded_fraction:
        raise AuthwatchError(
            f"split excluded {row.x / row.n:.1%} of events, above {config.max_excluded_fraction:.1%}")
