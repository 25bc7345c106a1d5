"""Behavioural baselines: per-user and per-source summaries, fitted once, joined to events."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AuthwatchError, BaselineConfig, FeatureConfig, config_fingerprint, micros, seconds
from ..functions.scalar import bucket, haversine_km, located, micros_of
from ..operators.histories import sample_std
from ..operators.prefix import neighbour, with_chunk
from ..operators.ranks import nearest_rank, select_ranks
from ..runtime import cut_lineage
from ..schema import BASELINE_FEATURES, SCHEMA_VERSION, SPARK_TYPES

US = "event_us"
KNOWN_SETS = {
    "known_device_ids": "device_id",
    "known_source_ids": "source_id",
    "known_country_codes": "country_code",
    "known_application_ids": "application_id",
    "known_auth_methods": "authentication_method",
}
#: Values of a known set that travel with the user's row; longer sets are looked up by (user, value).
LIST_VALUES = 64


@dataclass
class Baseline:
    users: DataFrame
    sources: DataFrame
    known: DataFrame
    interval_start_us: int
    interval_end_us: int

    @cached_property
    def long_sets(self) -> set[str]:
        """Known sets of which some user has too many values to travel with the user's row."""
        sizes = self.known.groupBy("user_id", "set_name").count().where(F.col("count") > LIST_VALUES)
        return {r.set_name for r in sizes.select("set_name").distinct().collect()}


def fit_interval(events: DataFrame) -> tuple[int, int]:
    """[min, max] event time in microseconds."""
    row = events.agg(F.min(micros_of(F.col("event_time"))).alias("a"),
                     F.max(micros_of(F.col("event_time"))).alias("b")).first()
    if row.a is None:
        raise AuthwatchError("a baseline needs at least one event")
    return row.a, row.b


def check_fit(events: DataFrame, permitted: DataFrame, start_us: int, end_us: int) -> None:
    """Every event must be inside the interval and among the permitted ids."""
    if end_us <= start_us:
        raise AuthwatchError("the baseline has to start before it ends")
    inside = micros_of(F.col("event_time")).between(start_us, end_us)
    outside = events.where(~inside).count()
    stray = events.where(inside).join(permitted.select("event_id"), "event_id", "left_anti").count()
    if outside or stray:
        raise AuthwatchError(
            f"baseline fit rejected: {outside} event(s) outside the interval, {stray} not permitted")


def known_values(events: DataFrame, config: BaselineConfig) -> DataFrame:
    """(user_id, set_name, value, occurrences, truncated): the known sets, one row for each value.

    With ``known_set_max_size`` only the most frequent values of each set, ties by value.
    """
    pairs = F.array(*[
        F.struct(F.lit(name).alias("set_name"), F.col(column).cast("string").alias("value"))
        for name, column in KNOWN_SETS.items()
    ])
    counts = (
        events.select("user_id", F.explode(pairs).alias("p"))
        .where("p.value is not null")
        .groupBy("user_id", "p.set_name", "p.value").agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") >= config.known_set_min_occurrences)
    )
    if config.known_set_max_size is None:
        return counts.withColumn("truncated", F.lit(False))
    order = Window.partitionBy("user_id", "set_name").orderBy(F.desc("occurrences"), F.asc("value"))
    # One more than the cap is kept to learn whether the set was truncated; the
    # rank filter lets Spark drop the rest before the shuffle.
    top = counts.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= config.known_set_max_size + 1)
    whole = Window.partitionBy("user_id", "set_name")
    return (
        top.withColumn("truncated", F.max("rank").over(whole) > config.known_set_max_size)
        .where(F.col("rank") <= config.known_set_max_size)
    )


def interarrival(events: DataFrame, chunk: str = "1h") -> DataFrame:
    """Per user: nearest-rank median and 90th percentile of the gaps between its events."""
    rows = with_chunk(events.select("user_id", US), US, micros(chunk))
    gaps = neighbour(rows, ["user_id"], US, "prev_us", forward=False).where("prev_us is not null")
    gaps = gaps.select("user_id", (F.col(US) - F.col("prev_us")).alias("gap"))
    picked = select_ranks(
        gaps, ["user_id"], "gap",
        {"median_us": nearest_rank(0.5), "p90_us": nearest_rank(0.9)},
    )
    return picked.select(
        "user_id",
        (F.col("median_us") / 1e6).alias("interarrival_median_s"),
        (F.col("p90_us") / 1e6).alias("interarrival_p90_s"),
    )


def _response_stats(config: BaselineConfig) -> list[Column]:
    n, total = F.col("__rt_n"), F.col("__rt_sum")
    enough = n >= config.response_time_min_events
    return [
        F.when(enough, total / n).alias("response_time_mean_ms"),
        F.when(enough, F.expr(sample_std("__rt_n", "__rt_sum", "__rt_sumsq"))).alias("response_time_std_ms"),
    ]


def _response_sums() -> list[Column]:
    rt = F.col("response_time_ms").cast("long")
    return [
        F.count(rt).alias("__rt_n"), F.sum(rt).alias("__rt_sum"),
        F.sum((rt * rt).cast("decimal(38,0)")).alias("__rt_sumsq"),
    ]


def _common(min_events: int, hours: float) -> list[Column]:
    enough = F.col("event_count") >= min_events
    rate = F.when(enough, F.col("event_count") / F.lit(hours)) if hours > 0 else F.lit(None).cast("double")
    return [
        F.when(enough, F.col("__ok") / F.col("event_count")).alias("success_rate"),
        rate.alias("event_rate_per_hour"),
    ]


def fit_users(events: DataFrame, config: BaselineConfig, hours: float, order_statistics: bool = True) -> DataFrame:
    """One row per user; without ``order_statistics`` the median and p90 of its gaps, which no feature reads, are left out."""
    rows = events.withColumn(US, micros_of(F.col("event_time")))
    rows = rows.withColumn("__hour", F.pmod(bucket(F.col(US), 3_600_000_000), F.lit(24)))
    here = located("coarse_latitude", "coarse_longitude")
    ok = F.col("authentication_outcome") == "success"
    base = rows.groupBy("user_id").agg(
        F.count("*").alias("event_count"),
        F.count_if(ok).alias("__ok"),
        *[F.expr(f"count_if(__hour = {h})").alias(f"__h{h}") for h in range(24)],
        *_response_sums(),
        F.count_if(here).alias("located_event_count"),
        F.avg(F.when(here, F.col("coarse_latitude"))).alias("centroid_latitude"),
        F.avg(F.when(here, F.col("coarse_longitude"))).alias("centroid_longitude"),
    )
    alpha = config.hour_histogram_alpha
    base = base.select(
        "user_id", "event_count", *_common(config.min_events_per_user, hours),
        F.expr("array({})".format(", ".join(
            f"(__h{h} + {alpha!r}D) / (event_count + {24 * alpha!r}D)" for h in range(24)
        ))).alias("hour_histogram"),
        *_response_stats(config),
        "centroid_latitude", "centroid_longitude", "located_event_count",
    )
    return base.join(interarrival(rows), "user_id", "left") if order_statistics else base


def entropy_bits(events: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Per key: Shannon entropy of a column in bits and its number of distinct values."""
    counts = events.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    # H = log2(N) - sum(c * log2 c) / N needs one pass over the counts.
    sums = counts.groupBy(key).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log2(F.col("c"))).alias("s"), F.count("*").alias("k"))
    raw = F.log2(F.col("n")) - F.col("s") / F.col("n")
    return sums.select(
        key,
        F.when(F.col("k") == 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), raw)).alias(f"{name}_entropy"),
        F.col("k").alias(f"distinct_{name}_count"),
    )


def fit_sources(events: DataFrame, config: BaselineConfig, hours: float) -> DataFrame:
    ok = F.col("authentication_outcome") == "success"
    base = events.groupBy("source_id").agg(
        F.count("*").alias("event_count"), F.count_if(ok).alias("__ok"), *_response_sums())
    base = base.select(
        "source_id", "event_count", *_common(config.min_events_per_source, hours), *_response_stats(config))
    # Distinct users through a pre-aggregated pair list, so a hot source splits over its users.
    users = events.groupBy("source_id", "user_id").agg(F.lit(1).alias("one")).groupBy("source_id").agg(
        F.count("*").alias("targeted_user_count"))
    clients = entropy_bits(events, "source_id", "client_type", "client_type")
    agents = entropy_bits(events, "source_id", "user_agent_family", "user_agent")
    out = base.join(users, "source_id").join(clients, "source_id", "left").join(agents, "source_id", "left")
    return out.fillna(0, ["distinct_client_type_count", "distinct_user_agent_count"])


def fit_baseline(
    events: DataFrame,
    config: BaselineConfig | None = None,
    permitted: DataFrame | None = None,
    interval_us: tuple[int, int] | None = None,
    order_statistics: bool = True,
) -> Baseline:
    """Fit on approved reference events; ``permitted`` switches the fit guard on, ``order_statistics`` is that of ``fit_users``."""
    config = config or BaselineConfig()
    start_us, end_us = interval_us or fit_interval(events)
    if permitted is not None:
        check_fit(events, permitted, start_us, end_us)
    hours = (end_us - start_us) / 3_600_000_000
    return Baseline(
        fit_users(events, config, hours, order_statistics), fit_sources(events, config, hours),
        # read once for each kind of value by the transform
        cut_lineage(known_values(events, config)), start_us, end_us)


NOVELTY = {
    "is_new_device_for_user": "known_device_ids",
    "is_new_source_for_user": "known_source_ids",
    "is_new_country_for_user": "known_country_codes",
    "is_new_application_for_user": "known_application_ids",
    "is_new_auth_method_for_user": "known_auth_methods",
}


def known_flags(rows: DataFrame, baseline: Baseline, wanted: set[str] | None = None) -> DataFrame:
    """Add a column for each wanted novelty verdict: true where the user was seen with the value, else null."""
    for name in NOVELTY:
        if wanted is None or name in wanted:
            column = KNOWN_SETS[NOVELTY[name]]
            values = baseline.known.where(F.col("set_name") == NOVELTY[name]).select(
                "user_id", F.col("value").alias(column), F.lit(True).alias(f"__{name}"))
            rows = rows.join(values, ["user_id", column], "left")
    return rows


def rate_counts(config: FeatureConfig) -> dict[str, str]:
    """The window count that a baseline column compares with the baseline."""
    ref = config.baseline.rate_reference_window
    return {"user_event_rate_ratio": f"user_attempt_count__{ref}", "source_user_fanout_ratio": f"source_unique_user_count__{ref}",
            "source_event_rate_ratio": f"source_attempt_count__{ref}"}


def _with_lists(users: DataFrame, known: DataFrame, sets: list[str]) -> DataFrame:
    """Users with an array of the known values of each set."""
    lists = known.where(F.col("set_name").isin(sets)).groupBy("user_id").agg(
        *[F.collect_list(F.when(F.col("set_name") == s, F.col("value"))).alias(s) for s in sets])
    return users.join(lists, "user_id", "left")


#: Of a user's row, what each column reads.
_USER_READS = {
    "login_hour_deviation": ("hour_histogram",), "user_success_rate_deviation": ("success_rate",),
    "user_event_rate_ratio": ("event_rate_per_hour",), "response_time_zscore": ("response_time_mean_ms", "response_time_std_ms"),
    "distance_from_user_baseline_centroid_km": ("centroid_latitude", "centroid_longitude"),
}


#: The same of a source's row.
_SOURCE_READS = {"source_user_fanout_ratio": ("targeted_user_count",), "source_event_rate_ratio": ("event_rate_per_hour",)}
_SOURCE_COLUMNS = {n for n, *_ in BASELINE_FEATURES if n.startswith("source_")}


def with_sources(rows: DataFrame, baseline: Baseline, wanted: set[str]) -> DataFrame:
    """Add what the ``wanted`` columns read of the row's source, for ``baseline_columns``."""
    if not wanted & _SOURCE_COLUMNS:
        return rows
    read = sorted({c for n in wanted for c in _SOURCE_READS.get(n, ())})
    # Stored, so that Spark knows the size beforehand: where sources are few, no event is dealt out for them.
    sources = cut_lineage(baseline.sources.select("source_id", *read))
    return rows.join(sources.select("source_id", F.lit(True).alias("__source_known"), *[F.col(c).alias(f"__source_{c}") for c in read]),
                     "source_id", "left")


def with_users(rows: DataFrame, baseline: Baseline, wanted: set[str], config: FeatureConfig,
               join: Callable[[DataFrame, DataFrame], DataFrame] = lambda rows, users: rows.join(users, "user_id", "left")) -> DataFrame:
    """Add the ``wanted`` baseline columns of the row's user, and what its ratio reads; no windows are needed yet.

    Known values come with the user's row; those of ``baseline.long_sets`` have flags in ``rows`` (``known_flags``).
    """
    novelty = {n: f"__{n}" for n in NOVELTY if n in wanted}
    listed = {n: NOVELTY[n] for n, flag in novelty.items() if flag not in rows.columns}
    users = baseline.users
    if listed:
        users = _with_lists(users, baseline.known, list(listed.values()))
    # Each event carries its user's struct through the join, so nothing else is in it; the mark tells a user from none.
    read = [*listed.values(), *sorted({c for n in wanted for c in _USER_READS.get(n, ())})]
    users = users.select("user_id", F.struct(F.lit(True).alias("known"), *read).alias("ub"))
    # Size decides: small summaries are broadcast by Spark, larger ones sort-merged.
    rows = join(rows, users)
    known = F.col("ub").isNotNull()

    def is_new(name: str) -> Column:
        value = F.col(KNOWN_SETS[NOVELTY[name]])
        if name in listed:
            unseen = ~F.coalesce(F.array_contains(F.col(f"ub.{listed[name]}"), value.cast("string")), F.lit(False))
        else:
            unseen = F.col(novelty[name]).isNull()
        return F.when(known & value.isNotNull(), unseen)

    hour = F.pmod(bucket(F.col(US), 3_600_000_000), F.lit(24)).cast("int")
    rt_std = F.col("ub.response_time_std_ms")
    limit = config.baseline.max_response_time_zscore
    z = F.when(rt_std != 0, (F.col("response_time_ms") - F.col("ub.response_time_mean_ms")) / rt_std)
    here = located("coarse_latitude", "coarse_longitude")
    observed = F.when(F.col("authentication_outcome") == "success", 1.0).otherwise(0.0)
    columns = {
        **{name: is_new(name) for name in novelty},
        "login_hour_deviation": F.lit(1.0) - F.element_at(F.col("ub.hour_histogram"), hour + 1),
        "user_success_rate_deviation": observed - F.col("ub.success_rate"),
        "response_time_zscore": F.when(
            z.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z))),
        "distance_from_user_baseline_centroid_km": F.when(
            here & F.col("ub.centroid_latitude").isNotNull(),
            haversine_km("ub.centroid_latitude", "ub.centroid_longitude", "coarse_latitude", "coarse_longitude")),
        "user_in_baseline": known,
    }
    columns = {n: c for n, c in columns.items() if n in wanted}
    if "user_event_rate_ratio" in wanted:
        columns["__user_event_rate_per_hour"] = F.col("ub.event_rate_per_hour")
    return rows.withColumns(columns).drop("ub", *novelty.values())


def baseline_columns(rows: DataFrame, baseline: Baseline | None, config: FeatureConfig,
                     wanted: set[str] | None = None) -> DataFrame:
    """Finish the ``wanted`` (by default all) baseline-derived columns; an unknown entity yields null, never a novelty verdict.

    ``rows`` have been through ``with_sources`` and ``with_users`` and have their window counts.
    """
    if baseline is None:
        return rows.withColumns({
            n: (F.lit(False) if n.endswith("_in_baseline") else F.lit(None).cast(SPARK_TYPES[dtype]))
            for n, dtype, *_ in BASELINE_FEATURES
        })
    wanted = {n for n, *_ in BASELINE_FEATURES} if wanted is None else wanted
    ref_hours = seconds(config.baseline.rate_reference_window) / 3600.0
    counts = rate_counts(config)

    def ratio(name: str, rate: str) -> Column:
        if name not in wanted or counts[name] not in rows.columns:
            return F.lit(None).cast("double")
        return F.when(F.col(rate) > 0, F.col(counts[name]).cast("double") / ref_hours / F.col(rate))

    def fanout(name: str) -> Column:
        if name not in wanted or counts[name] not in rows.columns:
            return F.lit(None).cast("double")
        targeted = F.col("__source_targeted_user_count")
        return F.when(targeted > 0, F.col(counts[name]) / targeted)

    columns = {
        "user_event_rate_ratio": ratio("user_event_rate_ratio", "__user_event_rate_per_hour"),
        "source_user_fanout_ratio": fanout("source_user_fanout_ratio"),
        "source_event_rate_ratio": ratio("source_event_rate_ratio", "__source_event_rate_per_hour"),
        "source_in_baseline": F.col("__source_known").isNotNull() if "source_in_baseline" in wanted else None,
    }
    spent = ["__user_event_rate_per_hour", "__source_known", "__source_targeted_user_count", "__source_event_rate_per_hour"]
    return rows.withColumns({n: c for n, c in columns.items() if n in wanted}).drop(*spent)


def save_baseline(baseline: Baseline, path: str, config: BaselineConfig) -> None:
    """Three Parquet tables and a metadata row, the metadata last."""
    baseline.users.write.mode("errorifexists").parquet(f"{path}/users")
    baseline.sources.write.mode("errorifexists").parquet(f"{path}/sources")
    baseline.known.write.mode("errorifexists").parquet(f"{path}/known")
    spark = baseline.users.sparkSession
    meta = {
        "baseline_schema_version": SCHEMA_VERSION,
        "interval_start_us": baseline.interval_start_us,
        "interval_end_us": baseline.interval_end_us,
        "config_fingerprint": config_fingerprint(config),
        "config": json.dumps(asdict(config), sort_keys=True),
    }
    spark.createDataFrame([meta]).coalesce(1).write.mode("errorifexists").json(f"{path}/metadata")


def load_baseline(spark, path: str, config: BaselineConfig | None = None) -> Baseline:
    meta = spark.read.json(f"{path}/metadata").first()
    if meta.baseline_schema_version != SCHEMA_VERSION:
        raise AuthwatchError(f"unsupported baseline version {meta.baseline_schema_version!r}")
    if config is not None and meta.config_fingerprint != config_fingerprint(config):
        raise AuthwatchError("the stored baseline was fitted with another configuration")
    return Baseline(
        spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/sources"),
        spark.read.parquet(f"{path}/known"), meta.interval_start_us, meta.interval_end_us)
