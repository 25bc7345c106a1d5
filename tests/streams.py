"""Micro event streams: '<seconds> <user> <source> <outcome> [key=value ...]' per line."""

import datetime as dt
import random

from authwatch.schema import AUTH_EVENTS

START = dt.datetime(2024, 3, 4, 12, 0, 0, tzinfo=dt.timezone.utc)
SHORT = {
    "dev": "device_id", "sess": "session_id", "app": "application_id",
    "method": "authentication_method", "mfa": "mfa_outcome", "country": "country_code",
    "region": "region_code", "lat": "coarse_latitude", "lon": "coarse_longitude",
    "ua": "user_agent_family", "client": "client_type", "rt": "response_time_ms", "id": "event_id",
}


def event(offset, user, source, outcome="failure", n=0, **extra):
    row = {f.name: None for f in AUTH_EVENTS.fields}
    row.update(
        schema_version="1.0.0", event_id=f"e{n:06d}",
        event_time=START + dt.timedelta(seconds=float(offset)),
        user_id=user, source_id=source, device_id="d1", session_id="sess1",
        application_id="app-00", authentication_method="password", authentication_outcome=outcome,
    )
    for key, value in extra.items():
        name = SHORT[key]
        if name in ("coarse_latitude", "coarse_longitude"):
            value = float(value)
        elif name == "response_time_ms":
            value = int(value)
        row[name] = value
    return row


def parse(text):
    rows = []
    for n, line in enumerate(l for l in text.strip().splitlines() if l.strip()):
        offset, user, source, outcome, *rest = line.split()
        rows.append(event(offset, user, source, outcome, n, **dict(p.split("=", 1) for p in rest)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([[r[f.name] for f in AUTH_EVENTS.fields] for r in rows], AUTH_EVENTS)


def random_rows(seed, n=220, span=3600 * 3, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # Few distinct instants, so ties are common; one hot source takes a large share.
        offset = rng.choice([rng.randrange(span), rng.randrange(40) * 30, rng.random() * span])
        located = rng.random() < 0.7
        rows.append(event(
            round(offset, 6), f"u{rng.randrange(6)}",
            "s0" if rng.random() < hot else f"s{rng.randrange(5)}",
            rng.choice(["success", "failure", "failure", "blocked", "challenged"]), i,
            dev=f"d{rng.randrange(5)}", sess=f"sess{rng.randrange(7)}", app=f"app{rng.randrange(3)}",
            method=rng.choice(["password", "sso", "passkey"]),
            **{k: v for k, v in dict(
                mfa=rng.choice(["failed", "passed", None]), country=rng.choice(["US", "GB", None]),
                region=rng.choice(["A", "B", None]), ua=rng.choice(["x", "y", None]),
                lat=rng.uniform(-80, 80) if located else None, lon=rng.uniform(-170, 170) if located else None,
                rt=rng.choice([None, rng.randrange(3000)]),
            ).items() if v is not None},
        ))
    rng.shuffle(rows)
    return rows
