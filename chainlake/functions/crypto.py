"""Digests, keyed digests and the big-endian entry envelope, all as JVM expressions."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def hmac_pads(salt: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA-256 (RFC 2104) for a key."""
    key = salt.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(salt: str, c: Column) -> Column:
    """HMAC-SHA-256 of a string column, lower-case hex, inside whole-stage codegen.

    The pads become literals of the plan; see ``hmac_sha256_closure`` when plans
    are visible to people who must not learn the salt.
    """
    inner, outer = hmac_pads(salt)
    digest = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(c, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(digest)), 256)


def hmac_sha256_closure(salt: str):
    """Same value as ``hmac_sha256_hex`` with the salt kept out of the plan."""
    key = salt.encode("utf-8")

    @F.pandas_udf(T.StringType())
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: hmac.new(key, v.encode("utf-8"), hashlib.sha256).hexdigest(),
            na_action="ignore",
        )

    return keyed


def be_hex(c: Column, octets: int) -> Column:
    """Big-endian fixed-width encoding of a non-negative integer (or any bigint at 8 octets)."""
    return F.lpad(F.hex(c.cast("bigint")), octets * 2, "0")


def be_bytes(c: Column, octets: int) -> Column:
    return F.unhex(be_hex(c, octets))


def envelope(
    version: Column,
    index: Column,
    timestamp: Column,
    prev_hash: Column,
    payload_type: Column,
    payload_json: Column,
) -> Column:
    """54-octet header followed by the canonical payload."""
    header = F.concat(
        be_hex(version, 1),
        be_hex(index, 8),
        be_hex(timestamp, 8),
        prev_hash,
        be_hex(payload_type, 1),
        be_hex(F.octet_length(payload_json), 4),
    )
    return F.concat(F.unhex(header), payload_json.cast("binary"))


def entry_hash(
    version: Column,
    index: Column,
    timestamp: Column,
    prev_hash: Column,
    payload_type: Column,
    payload_json: Column,
) -> Column:
    return F.sha2(envelope(version, index, timestamp, prev_hash, payload_type, payload_json), 256)


def row_entry_hash() -> Column:
    """``entry_hash`` over the standard chain-entry columns."""
    return entry_hash(
        F.col("version"),
        F.col("index"),
        F.col("timestamp"),
        F.col("prev_hash"),
        F.col("payload_type"),
        F.col("payload_json"),
    )


def hex_encode(c: Column) -> Column:
    return F.lower(F.hex(c))


def hex_decode(c: Column) -> Column:
    return F.unhex(c)


def is_hash_hex(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{64}$")
