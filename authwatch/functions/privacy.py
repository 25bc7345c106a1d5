"""Pseudonymisation and sensitive-name rules."""

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AuthwatchError

# Prefix and domain of each identifier column.
DOMAINS = {"user_id": ("u", "user"), "source_id": ("s", "source"), "device_id": ("d", "device"),
           "session_id": ("sess", "session")}
# Normalised names that may not occur in input.
PROHIBITED_NAMES = frozenset({
    "password", "passwordhash", "secret", "token", "accesstoken", "refreshtoken", "authorization",
    "cookie", "privatekey",
})
MAX_DEPTH = 5


def normalise(name: str) -> str:
    return re.sub(r"[-_\s]+", "", name.lower())


def prohibited(names) -> list[str]:
    return sorted(n for n in names if normalise(n) in PROHIBITED_NAMES)


def _pads(spark: SparkSession, key: bytes) -> DataFrame:
    """One row with the key's inner and outer pad (RFC 2104), as a table rather than as literals."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pads = [bytearray(b ^ x for b in block) for x in (0x36, 0x5C)]
    return spark.createDataFrame([(pads,)], "authwatch_pads array<binary>")


def _pseudonym(column: str) -> Column:
    prefix, domain = DOMAINS[column]
    message = F.encode(F.concat(F.lit(f"{domain}:"), F.col(column)), "UTF-8")
    inner, outer = F.col("authwatch_pads")[0], F.col("authwatch_pads")[1]
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.concat(F.lit(f"{prefix}:"), F.substring(digest, 1, 32))


def pseudonymise(rows: DataFrame, key: bytes) -> DataFrame:
    """``rows`` with keyed pseudonyms (HMAC-SHA-256) in place of raw identifiers; null stays null.

    Computed by SQL functions alone. The key's pads travel as a broadcast table of one row: no plan, event log or user
    interface shows the content of such a table, as they would show a literal.
    """
    if len(key) < 32:
        raise AuthwatchError("the pseudonym key needs at least 32 bytes")
    found = [c for c in DOMAINS if c in rows.columns]
    padded = rows.join(F.broadcast(_pads(rows.sparkSession, key)))
    return padded.withColumns({c: _pseudonym(c) for c in found}).drop("authwatch_pads")
