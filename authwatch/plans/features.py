"""Feature snapshot: one row per event, every history strictly before the event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions.scalar import bucket, cyclic, located, micros_of
from ..operators.arrays import array_features
from ..operators.histories import derived, frame_features, sweep_features
from ..operators.prefix import LONG
from ..operators.sequences import GEO, OWNED, chunked_sequences, frame_sequences
from ..runtime import compile_wide_rows, cut_lineage, keep_dealt
from ..schema import (
    BASELINE_FEATURES, ENTITY_KEYS, SCHEMA_VERSION, SPARK_TYPES, feature_catalog,
)
from .baseline import NOVELTY, Baseline, baseline_columns, known_flags, rate_counts, with_sources, with_users

US = "event_us"
ROW = "__row"
# Upper bits of ROW: the bucket of the row's user, so that tables of single kinds can be dealt by user although they hold no user.
BUCKET = "__bucket"
_BUCKETS, _NUMBER_BITS = 1 << 16, 47
# Narrow kinds first; the last three share one shuffle on the user.
_ORDER = ("session", "device", "source", "user_device", "pair", "user")
_UNDER_USER = ("user_device", "pair", "user")


def current_context() -> dict[str, Column]:
    device = F.col("device_id")
    return {
        "current_authentication_outcome": F.col("authentication_outcome"),
        "current_authentication_method": F.col("authentication_method"),
        "current_mfa_outcome": F.col("mfa_outcome"),
        "current_client_type": F.col("client_type"),
        "current_response_time_ms": F.col("response_time_ms").cast("long"),
        "current_country_code": F.col("country_code"),
        "current_has_device": F.coalesce(device != "", F.lit(False)),
        "current_has_location": located("coarse_latitude", "coarse_longitude"),
    }


def calendar() -> dict[str, Column]:
    # Plain arithmetic on UTC microseconds, so the session time zone cannot matter.
    hours = bucket(F.col(US), 3_600_000_000)
    hour = F.pmod(hours, F.lit(24)).cast("long")
    # 1970-01-01 was a Thursday; Monday is 0.
    day = F.pmod(bucket(F.col(US), 86_400_000_000) + F.lit(3), F.lit(7)).cast("long")
    hour_sin, hour_cos = cyclic(hour, 24)
    day_sin, day_cos = cyclic(day, 7)
    return {
        "hour_of_day": hour, "day_of_week": day, "is_weekend": day >= 5,
        "hour_sin": hour_sin, "hour_cos": hour_cos,
        "day_of_week_sin": day_sin, "day_of_week_cos": day_cos,
    }


def dense_entities(events: DataFrame, config: FeatureConfig, kinds: list[str]) -> dict[str, DataFrame]:
    """Entities whose windows or whole history are too full for one task, per kind.

    The list is at most (events / threshold) rows; it is materialised once and
    only the names of the kinds that occur come to the driver.  ``LONG`` marks
    the entities that are cut into chunks of time.
    """
    period = bucket(F.col(US), config.max_window_us)

    def scan(rows: DataFrame, names: list[str]) -> dict[str, DataFrame]:
        if not names:
            return {}
        entries = []
        for kind in names:
            keys = ENTITY_KEYS[kind]
            second = F.col(keys[1]) if len(keys) > 1 else F.lit(None).cast("string")
            entries.append(F.struct(F.lit(kind).alias("kind"), F.col(keys[0]).alias("k1"), second.alias("k2")))
        counts = (
            rows.select(period.alias("bucket"), F.explode(F.array(*entries)).alias("e"))
            .groupBy("e.kind", "e.k1", "e.k2", "bucket").count()
        )
        dense = counts.groupBy("kind", "k1", "k2").agg(
            F.max("count").alias("peak"), F.sum("count").alias("total")
        ).where((F.col("peak") > config.skew.dense_rows) | (F.col("total") > config.skew.total_rows))
        dense = cut_lineage(dense.select("kind", "k1", "k2", (F.col("total") > config.skew.whole_rows).alias(LONG)))
        found = {row.kind for row in dense.select("kind").distinct().collect()}
        out = {}
        for kind in names:
            if kind in found:
                keys = ENTITY_KEYS[kind]
                out[kind] = dense.where(F.col("kind") == kind).select(
                    *[F.col(f"k{i + 1}").alias(k) for i, k in enumerate(keys)], LONG
                )
        return out

    out = scan(events, [k for k in ("user", "source", "session", "device")
                        if k in kinds or (k == "user" and set(kinds) & set(_UNDER_USER))])
    # A pair or a user's device is only ever dense under a dense user.
    narrow = [k for k in ("pair", "user_device") if k in kinds]
    if "user" in out and narrow:
        out.update(scan(events.join(out["user"], ["user_id"], "left_semi"), narrow))
    return {k: v for k, v in out.items() if k in kinds or k == "user"}


def _read_later(wanted: set[str]) -> set[str]:
    """Columns of the events that are still read once the windows are done."""
    place = ("coarse_latitude", "coarse_longitude")
    reads = {
        "current_authentication_outcome": ("authentication_outcome",), "current_authentication_method": ("authentication_method",),
        "current_mfa_outcome": ("mfa_outcome",), "current_client_type": ("client_type",), "current_response_time_ms": ("response_time_ms",),
        "current_country_code": ("country_code",), "current_has_device": ("device_id",), "current_has_location": place,
        **{n: ("country_code", "region_code", *place) for n in GEO},
    }
    return {"event_id", US, "user_id", *[c for n in wanted for c in reads.get(n, ())]}


def _framed(rows: DataFrame, kind: str, windowed: list, sequences: set[str], config: FeatureConfig) -> DataFrame:
    """The rows with the columns of the kind, by frames."""
    keys = list(ENTITY_KEYS[kind])
    # Sequences sort by time and id, which serves the frames after them too.
    if sequences:
        rows = frame_sequences(rows, kind, sequences, config, keys)
    return frame_features(rows, kind, windowed, config, keys) if windowed else rows


def _kind_tables(rows: DataFrame, dense: DataFrame | None, kind: str, windowed: list, sequences: set[str],
                 config: FeatureConfig, short: frozenset[str]) -> list[DataFrame]:
    """(ROW, columns of the kind) for all rows, in one or two tables: dense entities by the sweep (``short`` is its), the others by frames."""
    names = [f.name for f in windowed]
    if dense is None:
        return [_framed(rows, kind, windowed, sequences, config).select(ROW, *sorted(sequences), *names)]
    members, others = (rows.join(dense, list(ENTITY_KEYS[kind]), how) for how in ("inner", "left_anti"))
    # Not joined with each other, as what comes of a union would be dealt out once more.
    tables = []
    if sequences:
        tables.append(chunked_sequences(members, kind, sequences, config, ROW).select(ROW, *sorted(sequences)).unionByName(
            _framed(others, kind, [], sequences, config).select(ROW, *sorted(sequences))))
    if windowed:
        tables.append(sweep_features(members, kind, windowed, config, ROW, short).select(ROW, *names).unionByName(
            _framed(others, kind, windowed, set(), config).select(ROW, *names)))
    return tables


def _bucket(row: str) -> Column:
    return F.shiftright(row, _NUMBER_BITS)


def _bucket_of(user: str) -> Column:
    return F.pmod(F.hash(user), F.lit(_BUCKETS)).cast("long")


def _with_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows, dealt out by bucket, with their columns of the table; see ``keep_dealt``."""
    table = table.withColumnRenamed(ROW, "__other").repartition(_bucket("__other"))
    return rows.join(table, (_bucket(ROW) == _bucket("__other")) & (F.col(ROW) == F.col("__other")), "left").drop("__other")


def _with_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """The same for the row of the user."""
    users = users.withColumnRenamed("user_id", "__other").repartition(_bucket_of("__other"))
    return rows.join(users, (_bucket(ROW) == _bucket_of("__other")) & (F.col("user_id") == F.col("__other")), "left").drop("__other")


def stored_events(events: DataFrame) -> DataFrame:
    """The events stored with row numbers, for callers that read them too; ``build_features`` then stores none itself."""
    # A number is 33 bits under that of its partition, so 2^14 partitions have room.
    number = F.shiftleft(_bucket_of("user_id"), _NUMBER_BITS) + F.monotonically_increasing_id()
    return cut_lineage(events.coalesce(1 << (_NUMBER_BITS - 33)).withColumn(ROW, number))


def build_features(
    events: DataFrame,
    config: FeatureConfig | None = None,
    baseline: Baseline | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """The snapshot table, or the given subset of its columns (keys always lead)."""
    config = config or FeatureConfig()
    compile_wide_rows(events.sparkSession)
    catalog = feature_catalog(config)
    names = [f.name for f in catalog]
    if columns is not None:
        unknown = sorted(set(columns) - set(names))
        if unknown:
            raise ValueError(f"undeclared feature columns: {unknown}")
    published = names if columns is None else ["anchor_event_id", "anchor_event_time", *[
        n for n in columns if n not in ("anchor_event_id", "anchor_event_time")]]
    wanted = set(published)
    baseline_names = [n for n, *_ in BASELINE_FEATURES]
    wants_baseline = bool(wanted & set(baseline_names))
    needed = set(wanted)
    if wants_baseline and baseline is not None:
        needed |= {count for name, count in rate_counts(config).items() if name in wanted}

    rows = events.withColumn(US, micros_of(F.col("event_time")))
    windowed = {k: [f for f in catalog if f.kind == k and f.name in needed] for k in _ORDER}
    sequences = {k: set(OWNED.get(k, ())) & needed for k in _ORDER}
    if config.geo.enabled:
        sequences["user"] |= set(GEO) & needed
    kinds = [k for k in _ORDER if windowed[k] or sequences[k]]
    dense = dense_entities(rows, config, kinds)

    if dense and ROW not in rows.columns:
        # read many times below: once from the source, then from here; stored row numbers stay the same in every pass
        rows = stored_events(rows)
    by_user = [k for k in kinds if k in _UNDER_USER and "user" not in dense]
    fitted = baseline if wants_baseline else None
    out, late = rows, {}
    if fitted is not None:
        # What the baseline knows comes while rows are narrow, ratios to it when the windows are done.
        out = known_flags(out, fitted, {n for n, s in NOVELTY.items() if n in wanted and s in fitted.long_sets})
        out = with_sources(out, fitted, wanted)
    if dense:
        # Every kind is measured on narrow rows, so its wide columns cross the network once.
        # What follows from other columns is not carried along.
        tables, short = [], frozenset(["user_id"] if by_user else [])
        for kind in kinds:
            if kind not in by_user:
                names = {f.name for f in windowed[kind]}
                late |= {f.name: value for f in windowed[kind] if (value := derived(f, config, names))}
                carried = [f for f in windowed[kind] if f.name not in late]
                tables += _kind_tables(rows, dense.get(kind), kind, carried, sequences[kind], config, short)
        if by_user:
            # Rows, tables and users are dealt out by user once and stay there for the kinds under the user.
            keep_dealt(events.sparkSession)
            out = out.repartition(_bucket(ROW))
            if fitted is not None:
                out = with_users(out, fitted, wanted, config, _with_user)
            out = reduce(_with_table, tables, out).withColumn(BUCKET, _bucket(ROW))
        else:
            if fitted is not None:
                out = with_users(out, fitted, wanted, config)
            if tables:
                out = out.join(reduce(lambda narrow, table: narrow.join(table, ROW), tables), ROW)
    else:
        if fitted is not None:
            out = with_users(out, fitted, wanted, config)
        for kind in kinds:
            if kind not in by_user:
                out = _framed(out, kind, windowed[kind], sequences[kind], config)
    if by_user:
        # The time is kept as microseconds; whatever else is not read any more stays behind.
        later = _read_later(wanted)
        kept = [c for c in out.columns if (c in later or c not in events.columns) and c not in (ROW, BUCKET)]
        out = array_features(out, {k: (windowed[k], sequences[k]) for k in by_user}, config, kept,
                             BUCKET if dense else None).withColumn("event_time", F.timestamp_micros(US))
    if late:
        out = out.selectExpr("*", *[f"{value} AS {name}" for name, value in late.items()])
    if wants_baseline:
        out = baseline_columns(out, baseline, config, wanted)
    direct = {
        "feature_schema_version": F.lit(SCHEMA_VERSION),
        "anchor_event_id": F.col("event_id"),
        "anchor_event_time": F.col("event_time"),
        **current_context(),
        **calendar(),
    }
    types = {f.name: SPARK_TYPES[f.dtype] for f in catalog}
    out = out.withColumns({n: c.cast(types[n]) for n, c in direct.items() if n in wanted})
    return out.select(*published)
