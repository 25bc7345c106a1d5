"""Quadratic brute force for the snapshot columns, written from the column definitions only."""

import math
import statistics
from fractions import Fraction

from authwatch.config import micros
from authwatch.schema import DIMENSION_COLUMNS, ENTITY_KEYS, feature_catalog
from tests.streams import START


def us(row):
    delta = row["event_time"] - START
    return (delta.days * 86400 + delta.seconds) * 10**6 + delta.microseconds


def sample_std(values):
    return math.sqrt(statistics.variance([Fraction(v) for v in values])) if len(values) >= 2 else None


def ok_place(row):
    lat, lon = row["coarse_latitude"], row["coarse_longitude"]
    return lat is not None and lon is not None and -90 <= lat <= 90 and -180 <= lon <= 180


def distance(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, max(0.0, h))))


def windowed(feature, past, config):
    m = feature.measure
    if m in DIMENSION_COLUMNS:
        return len({e[DIMENSION_COLUMNS[m]] for e in past} - {None})
    outcomes = [e["authentication_outcome"] for e in past]
    counts = {"attempt_count": len(past), "event_count": len(past),
              "success_count": outcomes.count("success"), "failure_count": outcomes.count("failure"),
              "challenge_count": outcomes.count("challenged"), "blocked_count": outcomes.count("blocked"),
              "mfa_failure_count": sum(e["mfa_outcome"] == "failed" for e in past)}
    if m in counts:
        return counts[m]
    if m in ("failure_rate", "success_rate"):
        return outcomes.count(m.split("_")[0]) / len(past) if len(past) >= config.min_count_for_rate and past else None
    rts = [e["response_time_ms"] for e in past if e["response_time_ms"] is not None]
    if m == "mean_response_time_ms":
        return sum(rts) / len(rts) if rts else None
    if m == "response_time_std_ms":
        return sample_std(rts)
    stamps = [us(e) for e in past]
    gaps = [b - a for a, b in zip(stamps, stamps[1:])]
    mean = sum(gaps) / len(gaps) / 1e6 if gaps else None
    if m == "mean_interarrival_seconds":
        return mean
    std = sample_std(gaps)
    std = None if std is None else std / 1e6
    if m == "interarrival_std_seconds":
        return std
    return None if std is None or not mean else std / mean


def snapshot(rows, config):
    """event_id -> {feature: value} for windowed, sequence and location columns."""
    ordered = sorted(rows, key=lambda r: (us(r), r["event_id"]))
    features = [f for f in feature_catalog(config) if f.kind]
    out = {}
    for row in ordered:
        t = us(row)
        before = [e for e in ordered if us(e) < t]
        mine = {k: [e for e in before if all(e[c] == row[c] for c in cols)] for k, cols in ENTITY_KEYS.items()}
        values = {}
        for f in features:
            past = [e for e in mine[f.kind] if us(e) >= t - micros(f.window)]
            values[f.name] = windowed(f, past, config)

        def run(kind):
            n = 0
            for e in mine[kind]:
                n = n + 1 if e["authentication_outcome"] == "failure" else 0
            return n

        def since_success(kind):
            n = 0
            for e in mine[kind]:
                o = e["authentication_outcome"]
                n = 0 if o == "success" else n + (o == "failure")
            return n

        def elapsed(events):
            return (t - us(events[-1])) / 1e6 if events else None

        pick = lambda kind, o: [e for e in mine[kind] if e["authentication_outcome"] == o]
        values.update({
            "prior_consecutive_user_failures": run("user"),
            "prior_consecutive_source_failures": run("source"),
            "prior_failures_since_user_success": since_success("user"),
            "prior_failures_since_pair_success": since_success("pair"),
            "seconds_since_user_previous_event": elapsed(mine["user"]),
            "seconds_since_source_previous_event": elapsed(mine["source"]),
            "seconds_since_user_previous_success": elapsed(pick("user", "success")),
            "seconds_since_user_previous_failure": elapsed(pick("user", "failure")),
            "seconds_since_pair_previous_event": elapsed(mine["pair"]),
            "previous_user_outcome": mine["user"][-1]["authentication_outcome"] if mine["user"] else None,
            "previous_pair_outcome": mine["pair"][-1]["authentication_outcome"] if mine["pair"] else None,
        })
        wins = pick("user", "success")
        placed = [e for e in wins if ok_place(e)]
        status, dist, speed, speed_status = "ok", None, None, "unavailable"
        if not wins:
            status = "no_prior_success"
        elif not ok_place(row):
            status = "missing_current_location"
        elif not placed:
            status = "missing_prior_location"
        else:
            last = placed[-1]
            dist = distance((last["coarse_latitude"], last["coarse_longitude"]),
                            (row["coarse_latitude"], row["coarse_longitude"]))
            speed, speed_status = dist / ((t - us(last)) / 1e6 / 3600), "ok"
            if speed > config.geo.max_plausible_velocity_kmh:
                speed, speed_status = config.geo.max_plausible_velocity_kmh, "capped"
        changed = lambda c: None if not wins or wins[-1][c] is None or row[c] is None else wins[-1][c] != row[c]
        values.update({
            "distance_km_from_user_previous_success": dist,
            "seconds_since_user_previous_success_with_location": elapsed(placed),
            "implied_velocity_kmh_from_previous_success": speed,
            "country_changed_since_previous_success": changed("country_code"),
            "region_changed_since_previous_success": changed("region_code"),
            "user_previous_success_geo__status": status,
            "implied_velocity__status": speed_status,
        })
        out[row["event_id"]] = values
    return out


def assert_same(actual, expected, context=""):
    for event_id, values in expected.items():
        got = actual[event_id]
        for name, want in values.items():
            have = got[name]
            if isinstance(want, float) and have is not None:
                assert math.isclose(have, want, rel_tol=1e-9, abs_tol=1e-9), (context, event_id, name, have, want)
            else:
                assert have == want, (context, event_id, name, have, want)
