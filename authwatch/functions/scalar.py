"""Scalar building blocks as Spark column expressions."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088  # fixed value: mean Earth radius


def located_sql(latitude: str, longitude: str) -> str:
    """True when the pair is present, finite and in range; never null."""
    return (
        f"coalesce(NOT isnan({latitude}) AND NOT isnan({longitude}) "
        f"AND {latitude} BETWEEN -90D AND 90D AND {longitude} BETWEEN -180D AND 180D, false)"
    )


def located(latitude: str, longitude: str) -> Column:
    # isnan(null) is false, so the range tests decide; a null there is coalesced to false.
    return F.expr(located_sql(latitude, longitude))


def haversine_sql(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    half_phi = f"sin((radians({lat_b}) - radians({lat_a})) / 2D)"
    half_lambda = f"sin(radians({lon_b} - {lon_a}) / 2D)"
    chord = (
        f"{half_phi} * {half_phi} + cos(radians({lat_a})) * cos(radians({lat_b})) "
        f"* {half_lambda} * {half_lambda}"
    )
    return f"{2.0 * EARTH_RADIUS_KM!r}D * asin(sqrt(least(1D, greatest(0D, {chord}))))"


def haversine_km(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> Column:
    return F.expr(haversine_sql(lat_a, lon_a, lat_b, lon_b))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2.0 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 UUID of ``name`` under a URL-derived namespace, as an expression."""
    space = uuid.uuid5(uuid.NAMESPACE_URL, namespace).hex
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    # Variant bits: the top two bits of the 17th hex digit become binary 10.
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble % 4 + 8).cast("long")))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def micros_of(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def bucket(value: Column, width: int) -> Column:
    """Exact integer floor(value / width) for bigint values."""
    size = F.lit(width).cast("long")
    return ((value - F.pmod(value, size)) / size).cast("long")
