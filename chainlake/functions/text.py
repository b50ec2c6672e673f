"""Small text and time expressions shared by the log operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ms_to_seconds(ms: Column) -> Column:
    """Floor division by 1000, also below zero."""
    return ((ms - F.pmod(ms, F.lit(1000))) / 1000).cast("bigint")


def seconds_to_timestamp(s: Column) -> Column:
    return F.timestamp_seconds(s)


def day_bucket(seconds: Column) -> Column:
    return F.date_trunc("day", F.timestamp_seconds(seconds))


def age_seconds(now_s: int | Column, seconds: Column) -> Column:
    return (F.lit(now_s) if isinstance(now_s, int) else now_s) - seconds


def clean_literal(c: Column) -> Column:
    """Trim spaces, then surrounding single quotes, then surrounding double quotes."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^'+|'+$", ""), '^"+|"+$', "")


def unqualified(name: Column) -> Column:
    """Last dotted part of a table name."""
    return F.substring_index(name, ".", -1)


def strip_qualifier(column: Column, alias: Column, table: Column) -> Column:
    """Drop a leading ``alias.`` or ``table.`` from a column reference."""
    by_alias = F.startswith(column, F.concat(alias, F.lit(".")))
    by_table = F.startswith(column, F.concat(table, F.lit(".")))
    return (
        F.when(by_alias, F.substr(column, F.length(alias) + 2))
        .when(by_table, F.substr(column, F.length(table) + 2))
        .otherwise(column)
    )


def truncate_reason(c: Column, limit: int = 256) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def percent_decode(c: Column) -> Column:
    """Decode ``%XX`` only; a plus sign stays a plus sign."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def request_action(method: Column, query: Column, presigned_is_read: bool = True) -> Column:
    """HTTP method to action; a presigned URL counts as a read when so configured."""
    action = (
        F.when(method.isin("PUT", "POST"), "write").when(method == "DELETE", "delete").otherwise("read")
    )
    if not presigned_is_read:
        return action
    presigned = query.contains("X-Amz-Algorithm") | query.contains("X-Amz-Credential")
    return F.when(F.coalesce(presigned, F.lit(False)), "read").otherwise(action)


def object_bucket(path: Column) -> Column:
    return F.split_part(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit(1))


def object_key(path: Column) -> Column:
    return F.regexp_extract(path, "^/*[^/]+/(.*)$", 1)


def access_key(authorization: Column, query: Column) -> Column:
    """Access key id from a signature header, else from a presigned query string."""
    header = F.nullif(F.regexp_extract(authorization, r"Credential=([A-Za-z0-9_\-]+)/", 1), F.lit(""))
    param = F.regexp_extract(query, r"(?:^|&)X-Amz-Credential=([^&]*)", 1)
    decoded = F.regexp_extract(percent_decode(param), "^([^/]*)/", 1)
    return F.coalesce(header, F.nullif(decoded, F.lit("")))


def source_ip(headers: Column, default: str = "unknown") -> Column:
    """First forwarded hop, else the real-ip header, else ``default``."""
    hop = F.trim(F.split_part(headers["x-forwarded-for"], F.lit(","), F.lit(1)))
    real = F.trim(headers["x-real-ip"])
    return F.coalesce(F.nullif(hop, F.lit("")), F.nullif(real, F.lit("")), F.lit(default))


# Document commands by the action they perform.
DOCUMENT_WRITES = ["insert", "update", "findAndModify"]
DOCUMENT_DELETES = ["delete"]
DOCUMENT_SCHEMA_CHANGES = [
    "drop",
    "createIndexes",
    "dropIndexes",
    "create",
    "collMod",
    "renameCollection",
]


def command_action(command: Column) -> Column:
    """Document command name to action; anything not listed reads."""
    return (
        F.when(command.isin(DOCUMENT_WRITES), "write")
        .when(command.isin(DOCUMENT_DELETES), "delete")
        .when(command.isin(DOCUMENT_SCHEMA_CHANGES), "schema_change")
        .otherwise("read")
    )
