"""Strictly-prior state of an entity: failure runs, elapsed times, last outcome, last success."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import FeatureConfig, micros
from ..functions.scalar import haversine_sql, located_sql
from ..schema import ENTITY_KEYS
from .prefix import LONG, running, with_chunk

US = "event_us"
# Which sequence columns each entity kind owns.
OWNED = {
    "user": (
        "prior_consecutive_user_failures", "prior_failures_since_user_success",
        "seconds_since_user_previous_event", "seconds_since_user_previous_success",
        "seconds_since_user_previous_failure", "previous_user_outcome",
    ),
    "source": ("prior_consecutive_source_failures", "seconds_since_source_previous_event"),
    "pair": (
        "prior_failures_since_pair_success", "seconds_since_pair_previous_event",
        "previous_pair_outcome",
    ),
}
GEO = (
    "distance_km_from_user_previous_success",
    "seconds_since_user_previous_success_with_location",
    "implied_velocity_kmh_from_previous_success",
    "country_changed_since_previous_success",
    "region_changed_since_previous_success",
    "user_previous_success_geo__status",
    "implied_velocity__status",
)
INPUTS = ("authentication_outcome", "country_code", "region_code", "coarse_latitude", "coarse_longitude")

_FAILED = "CASE WHEN authentication_outcome = 'failure' THEN 1L ELSE 0L END"
_OK = "authentication_outcome = 'success'"
_HERE = located_sql("coarse_latitude", "coarse_longitude")


def _state(wanted: set[str]) -> dict[str, tuple[str, str]]:
    """Associative measures over all strictly earlier events (``__cf`` = failures up to the row)."""
    out: dict[str, tuple[str, str]] = {}
    if any("consecutive" in n or "failures_since" in n for n in wanted):
        out["__fails"] = ("sum", _FAILED)
    if any("consecutive" in n for n in wanted):
        out["__cf_reset"] = ("max", "CASE WHEN authentication_outcome != 'failure' THEN __cf END")
    if any("failures_since" in n for n in wanted):
        out["__cf_success"] = ("max", f"CASE WHEN {_OK} THEN __cf END")
    if any(n.endswith("previous_event") for n in wanted):
        out["__last_us"] = ("max", US)
    if "seconds_since_user_previous_success" in wanted:
        out["__last_success_us"] = ("max", f"CASE WHEN {_OK} THEN {US} END")
    if "seconds_since_user_previous_failure" in wanted:
        out["__last_failure_us"] = ("max", f"CASE WHEN authentication_outcome = 'failure' THEN {US} END")
    if any(n.endswith("_outcome") for n in wanted):
        out["__last"] = ("max", f"struct({US}, event_id, authentication_outcome)")
    if wanted & set(GEO):
        out["__success"] = ("max", f"CASE WHEN {_OK} THEN struct({US}, event_id, country_code, region_code) END")
        out["__located"] = (
            "max",
            f"CASE WHEN {_OK} AND {_HERE} THEN struct({US}, event_id, coarse_latitude, coarse_longitude) END")
    return out


def _published(wanted: set[str], config: FeatureConfig) -> dict[str, str]:
    def since(state: str) -> str:
        return f"({US} - {state}) / 1e6D"

    out: dict[str, str] = {}
    for name in sorted(wanted):
        if name in GEO:
            continue
        if "consecutive" in name:
            out[name] = "coalesce(__fails, 0L) - coalesce(__cf_reset, 0L)"
        elif "failures_since" in name:
            out[name] = "coalesce(__fails, 0L) - coalesce(__cf_success, 0L)"
        elif name.endswith("previous_event"):
            out[name] = since("__last_us")
        elif name.endswith("previous_success"):
            out[name] = since("__last_success_us")
        elif name.endswith("previous_failure"):
            out[name] = since("__last_failure_us")
        else:
            out[name] = "__last.authentication_outcome"
    if wanted & set(GEO):
        out.update({k: v for k, v in _geo(config).items() if k in wanted})
    return out


def _geo(config: FeatureConfig) -> dict[str, str]:
    elapsed = f"(({US} - __located.{US}) / 1e6D)"
    status = (
        f"CASE WHEN __success IS NULL THEN 'no_prior_success' WHEN NOT {_HERE} THEN 'missing_current_location' "
        "WHEN __located IS NULL THEN 'missing_prior_location' ELSE 'ok' END"
    )
    haversine = haversine_sql(
        "__located.coarse_latitude", "__located.coarse_longitude", "coarse_latitude", "coarse_longitude")
    distance = f"(CASE WHEN {status} = 'ok' THEN {haversine} END)"
    velocity, velocity_status = implied_velocity(distance, elapsed, config)
    return {
        "distance_km_from_user_previous_success": distance,
        "seconds_since_user_previous_success_with_location": elapsed,
        "implied_velocity_kmh_from_previous_success": velocity,
        "country_changed_since_previous_success": "__success.country_code != country_code",
        "region_changed_since_previous_success": "__success.region_code != region_code",
        "user_previous_success_geo__status": status,
        "implied_velocity__status": velocity_status,
    }


def implied_velocity(distance: str, elapsed: str, config: FeatureConfig) -> tuple[str, str]:
    """(velocity, status); distance is null whenever the comparison is unavailable."""
    cap = f"{config.geo.max_plausible_velocity_kmh!r}D"
    floor = f"{config.geo.min_distance_km_for_velocity!r}D"
    raw = f"{distance} / ({elapsed} / 3600D)"
    velocity = (
        f"CASE WHEN {distance} IS NULL OR {elapsed} IS NULL OR {elapsed} <= 0 THEN NULL "
        f"WHEN {distance} < {floor} THEN 0D ELSE least({raw}, {cap}) END"
    )
    status = (
        f"CASE WHEN {distance} IS NULL THEN 'unavailable' WHEN {elapsed} <= 0 THEN 'zero_elapsed' "
        f"WHEN {distance} < {floor} THEN 'ok' WHEN {raw} > {cap} THEN 'capped' ELSE 'ok' END"
    )
    return velocity, status


def frame_sequences(
    df: DataFrame, kind: str, wanted: set[str], config: FeatureConfig, keys: list[str]
) -> DataFrame:
    state = _state(wanted)
    partition = f"PARTITION BY {', '.join(keys)}"
    prior = f"OVER ({partition} ORDER BY {US} RANGE BETWEEN UNBOUNDED PRECEDING AND 1L PRECEDING)"
    rows = df
    if "__fails" in state:
        rows = rows.selectExpr(
            "*", f"sum({_FAILED}) OVER ({partition} ORDER BY {US}, event_id "
                 "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __cf")
    rows = rows.selectExpr("*", *[f"{op}({expr}) {prior} AS {n}" for n, (op, expr) in state.items()])
    return rows.selectExpr(*df.columns, *[f"{v} AS {n}" for n, v in _published(wanted, config).items()])


def chunked_sequences(
    df: DataFrame, kind: str, wanted: set[str], config: FeatureConfig, row: str = "event_id"
) -> DataFrame:
    """Same values for dense entities; returns (row, columns...), ``row`` being a column that tells events apart."""
    keys = list(ENTITY_KEYS[kind])
    rows = df.select(*dict.fromkeys([row, "event_id", US, *keys, *INPUTS, *({LONG} & set(df.columns))]))
    rows = with_chunk(rows, US, micros(config.skew.chunk))
    state = _state(wanted)
    if "__fails" in state:
        rows = running(rows, keys, US, {"__cf": ("sum", _FAILED)}, tie_break="event_id")
    rows = running(rows, keys, US, state)
    return rows.selectExpr(row, *[f"{v} AS {n}" for n, v in _published(wanted, config).items()])
