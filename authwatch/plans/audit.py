"""Leakage audit: twelve named checks, each a count of violations over whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions.scalar import bucket, micros_of
from ..operators.ranks import select_ranks
from ..runtime import cut_lineage
from ..schema import GROUND_TRUTH_COLUMNS, SUPERVISED_SPLITS, feature_catalog
from .baseline import Baseline
from .features import build_features
from .fingerprint import fingerprint

_SPLIT_LIST = ", ".join(f"'{s}'" for s in SUPERVISED_SPLITS)
_CAMPAIGN_COLUMNS = ("campaign_id", "campaign_stage", "scenario_variant")
_SPLIT_COLUMNS = ("split", "exclusion_reason")
_RESULT = "check string, status string, severity string, violations bigint, message string"


def columns_by_key(config: FeatureConfig) -> dict[str, list[str]]:
    """Prior-only columns by the event column whose history alone decides them.

    Pairs and user devices are histories of one user too, so five kinds of entity come down to four keys.
    """
    own = {"source": "source_id", "session": "session_id", "device": "device_id"}
    out: dict[str, list[str]] = {"user_id": [], **{key: [] for key in own.values()}}
    for f in feature_catalog(config):
        if f.leakage == "prior_only":
            kind = f.kind or ("source" if "_source_" in f.name else "user")
            out[own.get(kind, "user_id")].append(f.name)
    return {key: names for key, names in out.items() if names}


def moved_rows(base: DataFrame, changed: DataFrame, columns: list[str]) -> DataFrame:
    """Anchors of ``base`` whose prior-only columns differ in ``changed``."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("anchor_event_id", F.struct(*columns).alias(name))

    return packed(base, "a").join(packed(changed, "b"), "anchor_event_id").where(~F.col("a").eqNullSafe(F.col("b")))


def probes(events: DataFrame) -> DataFrame:
    """Two rows of events: ``future`` repeats the last event a day later, ``twin`` the middle one at the same instant.

    ``probe`` names the row, ``limit_us`` is the last instant at which nothing may move.
    """
    us = micros_of(F.col("event_time"))
    last = events.orderBy(F.desc("event_time"), F.desc("event_id")).limit(1)
    # the instant at place n // 2 of the canonical order
    middle = select_ranks(events.select(us.alias("us")), [], "us", {"middle_us": F.floor(F.col("__n") / 2) + 1})
    pivot = events.join(F.broadcast(middle), us == F.col("middle_us")).drop("middle_us").orderBy("event_id").limit(1)
    future = last.withColumns({"probe": F.lit("future"), "limit_us": us}).withColumn("event_time", F.expr("event_time + INTERVAL 1 DAY"))
    twin = pivot.withColumns({"probe": F.lit("twin"), "limit_us": us})
    return future.unionByName(twin)


def moved_by_probes(events: DataFrame, snapshot: DataFrame, config: FeatureConfig, added: DataFrame | None = None) -> DataFrame:
    """(probe, anchor_event_id, columns): rows up to the probe's limit that move when the probe joins the events, and what moves.

    A probe can only touch histories of its own user, source, session and device, so only these entities' events are taken, and
    a row's columns are compared where it shares their key with the probe. Both changed streams are computed in one run: their
    keys carry the probe's name, so that they do not meet. Everything else keeps its events, hence its values.
    """
    by_key = columns_by_key(config)
    columns = [c for names in by_key.values() for c in names]
    added = cut_lineage(added if added is not None else probes(events))  # two rows
    keys = list(by_key)
    marks = added.select("probe", "limit_us", *[F.col(c).alias(f"probe_{c}") for c in keys])
    shares = [F.coalesce(F.col(c) == F.col(f"probe_{c}"), F.lit(False)) for c in keys]
    reached = events.join(F.broadcast(marks), functools.reduce(lambda a, b: a | b, shares))
    kept = cut_lineage(reached.select(*events.columns, "probe", "limit_us", *[s.alias(f"own_{c}") for c, s in zip(keys, shares)]))

    def named(column: str):
        return F.concat(F.col("probe"), F.lit("/"), F.col(column)).alias(column)

    def apart(df: DataFrame) -> DataFrame:
        """Events whose ids and entities are their probe's own."""
        marked = {"event_id", *keys}
        return df.select(*[named(c) if c in marked else F.col(c) for c in events.columns])

    again = build_features(apart(kept).unionByName(apart(added.withColumn("event_id", F.concat("event_id", F.lit("-probe"))))),
                           config, columns=columns)

    def packed(df: DataFrame, side: str) -> DataFrame:
        """One struct of columns for each key."""
        return df.select("anchor_event_id", *[F.struct(*names).alias(f"{side}_{key}") for key, names in by_key.items()])

    again = cut_lineage(packed(again, "again")).withColumnRenamed("anchor_event_id", "again_id")
    rows = kept.where(micros_of(F.col("event_time")) <= F.col("limit_us")).select(
        "probe", F.col("event_id").alias("anchor_event_id"), named("event_id").alias("again_id"), *[f"own_{c}" for c in keys])
    pairs = rows.join(again, "again_id").join(packed(snapshot, "stored"), "anchor_event_id")
    moved = [F.col(f"own_{key}") & ~F.col(f"stored_{key}").eqNullSafe(F.col(f"again_{key}")) for key in keys]
    names = [F.when(F.col(f"own_{key}") & ~F.col(f"stored_{key}")[c].eqNullSafe(F.col(f"again_{key}")[c]), F.lit(c))
             for key, listed in by_key.items() for c in listed]
    return pairs.where(functools.reduce(lambda a, b: a | b, moved)).select(
        "probe", "anchor_event_id", F.array_compact(F.array(*names)).alias("columns"))


def purge_violations(events: DataFrame, assignments: DataFrame, window_us: int) -> DataFrame:
    """Per split: supervised events whose lookback ``[t - window, t)`` reaches an event of another supervised split.

    Time is cut into buckets as wide as the window, so a lookback ends in its own bucket or the one before. One row for
    each bucket keeps every split's first and last instant: a neighbour reaches in if its first instant in the same bucket is
    earlier, or its last one in the bucket before is late enough. Simultaneous events do not see each other.
    """
    width = max(1, window_us)
    rows = events.select("event_id", micros_of(F.col("event_time")).alias("us")).join(
        assignments.where(f"split IN ({_SPLIT_LIST})").select("event_id", "split"), "event_id")
    # read three times below, so the split is made once
    marks = cut_lineage(rows.groupBy("split", "us").agg(F.count("*").alias("n")).withColumn(
        "bucket", bucket(F.col("us"), width)))

    def edge(fold, name):
        return [fold(F.when(F.col("split") == s, F.col("us"))).alias(f"{name}_{s}") for s in SUPERVISED_SPLITS]

    own = marks.groupBy("bucket").agg(*edge(F.min, "first"))
    before = marks.withColumn("bucket", F.col("bucket") + 1).groupBy("bucket").agg(*edge(F.max, "last"))
    reached = " OR ".join(
        f"(split != '{s}' AND (first_{s} < us OR last_{s} >= us - {window_us}L))" for s in SUPERVISED_SPLITS)
    return marks.join(own, "bucket").join(before, "bucket", "left").groupBy("split").agg(
        F.sum("n").alias("events"),
        F.coalesce(F.sum(F.expr(f"CASE WHEN {reached} THEN n END")), F.lit(0)).alias("violations"))


def split_campaigns(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Attack campaigns present in more than one supervised split."""
    rows = labels.where("scenario != 'normal'").select("event_id", "campaign_id").join(
        assignments.where(f"split IN ({_SPLIT_LIST})").select("event_id", "split"), "event_id")
    flags = [F.max(F.when(F.col("split") == s, 1).otherwise(0)) for s in SUPERVISED_SPLITS]
    return rows.groupBy("campaign_id").agg(sum(flags).alias("splits")).where("splits > 1")


def holdout_in_supervised(assignments: DataFrame, labels: DataFrame, scenarios) -> DataFrame:
    listed = ", ".join(f"'{s}'" for s in scenarios) or "''"
    return labels.where(f"scenario IN ({listed}) OR NOT supervised_training_eligible").select("event_id").join(
        assignments.where(f"split IN ({_SPLIT_LIST})"), "event_id")


def key_integrity(features: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """One row: ids missing from each table and ids repeated in each."""
    sides = {"features": features.select(F.col("anchor_event_id").alias("event_id")),
             "labels": labels.select("event_id"), "splits": splits.select("event_id")}
    tagged = None
    for name, side in sides.items():
        part = side.select("event_id", F.lit(name).alias("side"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("event_id").agg(*[
        F.count_if(F.col("side") == n).alias(n) for n in sides])
    return counts.agg(
        *[F.count_if(F.col(n) == 0).alias(f"missing_from_{n}") for n in sides],
        *[F.count_if(F.col(n) > 1).alias(f"duplicated_in_{n}") for n in sides])


def audit(
    events: DataFrame,
    snapshot: DataFrame,
    config: FeatureConfig,
    labels: DataFrame | None = None,
    assignments: DataFrame | None = None,
    baseline: Baseline | None = None,
    train_events: DataFrame | None = None,
    recompute: bool = True,
) -> DataFrame:
    """All checks as (check, status, severity, violations, message); missing inputs are skipped."""
    rows: list[tuple] = []

    def add(check: str, violations: int | None, message: str):
        status = "skipped" if violations is None else ("passed" if violations == 0 else "failed")
        rows.append((check, status, "error", violations, message))

    names = set(snapshot.columns)
    add("NO_GROUND_TRUTH_COLUMNS", len(names & set(GROUND_TRUTH_COLUMNS)), "label columns in the snapshot")
    add("NO_CAMPAIGN_COLUMNS", len(names & set(_CAMPAIGN_COLUMNS)), "campaign columns in the snapshot")
    add("NO_SPLIT_COLUMNS", len(names & set(_SPLIT_COLUMNS)), "split columns in the snapshot")
    moved = {r["probe"]: r["n"] for r in moved_by_probes(events, snapshot, config).groupBy("probe").agg(
        F.count("*").alias("n")).collect()} if recompute else None  # at most two rows
    add("NO_FUTURE_CONTRIBUTION", None if moved is None else moved.get("future", 0), "rows moved by a later event")
    add("NO_SAME_TIMESTAMP_CONTRIBUTION", None if moved is None else moved.get("twin", 0), "rows moved by a simultaneous event")
    have_fit = baseline is not None and train_events is not None
    if have_fit:
        train = fingerprint(train_events, train_events.columns).first()
        if assignments is not None:
            approved = events.join(assignments.where("split = 'train'").select("event_id"), "event_id", "left_semi")
            same = fingerprint(approved.select(*train_events.columns), train_events.columns).first() == train
            add("BASELINE_SOURCE_FINGERPRINT_MATCHES_TRAIN", int(not same), "fit events differ from the train split")
        else:
            add("BASELINE_SOURCE_FINGERPRINT_MATCHES_TRAIN", None, "no split given")
        fitted = baseline.users.agg(F.sum("event_count").alias("n")).first().n
        add("BASELINE_NOT_FIT_ON_EVALUATION_DATA", abs((fitted or 0) - train.row_count),
            "events in the baseline beyond the train split")
    else:
        add("BASELINE_SOURCE_FINGERPRINT_MATCHES_TRAIN", None, "no baseline given")
        add("BASELINE_NOT_FIT_ON_EVALUATION_DATA", None, "no baseline given")
    if assignments is not None:
        total = purge_violations(events, assignments, config.max_window_us).agg(F.sum("violations").alias("v")).first().v
        add("PURGE_INTERVAL_RESPECTED", total or 0, "supervised events looking into another split")
    else:
        add("PURGE_INTERVAL_RESPECTED", None, "no split given")
    if assignments is not None and labels is not None:
        add("CAMPAIGN_GROUPS_ISOLATED", split_campaigns(assignments, labels).count(), "campaigns across splits")
        add("HOLDOUT_EXCLUDED_FROM_SUPERVISED",
            holdout_in_supervised(assignments, labels, config.split.holdout_scenarios).count(),
            "holdout events in a supervised split")
    else:
        add("CAMPAIGN_GROUPS_ISOLATED", None, "no split or labels given")
        add("HOLDOUT_EXCLUDED_FROM_SUPERVISED", None, "no split or labels given")
    bad = [f.name for f in feature_catalog(config)
           if f.name.startswith("current_") != (f.group == "current_context")]
    add("CURRENT_VS_PRIOR_FIELDS_DISTINGUISHED", len(bad), "columns whose name hides their class")
    if assignments is not None and labels is not None:
        row = key_integrity(snapshot, labels, assignments).first()
        add("JOIN_KEY_INTEGRITY", sum(row), "ids missing or repeated between tables")
    else:
        add("JOIN_KEY_INTEGRITY", None, "no split or labels given")
    return events.sparkSession.createDataFrame(rows, _RESULT)
