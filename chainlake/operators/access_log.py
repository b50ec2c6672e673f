"""Raw logs to access events: fingerprint, analyse, classify, resolve, assemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions.text import access_key, object_bucket, object_key, request_action, source_ip
from chainlake.operators.fingerprint import (
    analyze_commands,
    analyze_queries,
    drop_internal_commands,
    drop_multipart_initiate,
    fingerprint_commands,
    fingerprint_queries,
)
from chainlake.operators.identity import IdentityConfig, classify_identity
from chainlake.operators.resolve import (
    UserTables,
    fingerprint_requests,
    resolve_users_doc,
    resolve_users_object,
    resolve_users_sql,
)

_EVENT = [
    "event_id",
    "protocol",
    "admin_id",
    "action",
    "resource",
    "scope",
    "query_fingerprint",
    "affected_users",
    "timestamp",
    "session_id",
    "metadata",
]


def _label(app: Column) -> Column:
    return (
        F.when(F.col("caller_class") == "app", app)
        .when(F.col("caller_class") == "suspicious", F.concat(F.lit("suspicious:"), "caller"))
        .otherwise(F.col("caller"))
    )


def _metadata(**members: Column) -> Column:
    entries = [part for name, value in members.items() for part in (F.lit(name), value)]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def build_access_events(
    log: DataFrame, identity: IdentityConfig, tables: UserTables, classes: list[str] | None = None
) -> DataFrame:
    """SQL statement log (``QUERY_LOG``) to access events; ``classes`` filters callers."""
    rows = classify_identity(log, identity)
    if classes:
        rows = rows.filter(F.col("caller_class").isin(classes))
    rows = resolve_users_sql(analyze_queries(fingerprint_queries(rows)), tables)
    names = F.array_join(F.transform("tables", lambda t: t["name"]), ", ")
    columns = F.when(F.size("columns") > 0, F.array_join("columns", ", ")).otherwise("*")
    return rows.select(
        "event_id",
        "protocol",
        _label(F.concat(F.lit("app:"), F.coalesce("credential", F.lit("app")))).alias("admin_id"),
        F.coalesce("action", F.lit("read")).alias("action"),
        F.when(names != "", names).otherwise("(utility)").alias("resource"),
        F.concat_ws(
            "; ", F.concat(F.lit("columns: "), columns), F.concat(F.lit("filter: "), "raw_where")
        ).alias("scope"),
        "query_fingerprint",
        "affected_users",
        F.col("ts_ms").alias("timestamp"),
        "session_id",
        _metadata(source_ip=F.col("source_ip")).alias("metadata"),
    )


def build_doc_events(
    log: DataFrame,
    identity: IdentityConfig,
    collections: UserTables,
    tables: UserTables | None = None,
    classes: tuple[str, ...] = ("admin",),
) -> DataFrame:
    """Document command log to access events; internal commands give none."""
    rows = classify_identity(log, identity).filter(F.col("caller_class").isin(list(classes)))
    rows = drop_internal_commands(analyze_commands(rows))
    rows = fingerprint_commands(resolve_users_doc(rows, collections, tables))
    return rows.select(
        "event_id",
        "protocol",
        _label(F.concat(F.lit("app:"), F.coalesce("credential", F.lit("app")))).alias("admin_id"),
        "action",
        F.col("collection").alias("resource"),
        "scope",
        "query_fingerprint",
        "affected_users",
        F.col("ts_ms").alias("timestamp"),
        "session_id",
        _metadata(source_ip=F.col("source_ip")).alias("metadata"),
    )


def build_object_events(
    log: DataFrame,
    identity: IdentityConfig,
    patterns: list[tuple[str, str]],
    excluded_prefixes: list[str] = (),
    complete_only: bool = True,
    presigned_is_read: bool = True,
) -> DataFrame:
    """Object request log (``OBJECT_LOG``) to access events, also where no user matches."""
    headers = F.col("headers")
    rows = drop_multipart_initiate(log, complete_only).withColumns(
        {
            "source_ip": source_ip(headers, "0.0.0.0"),
            "credential": access_key(headers["authorization"], F.col("query")),
            "protocol": F.lit("s3"),
            "bucket": object_bucket(F.col("path")),
            "key": object_key(F.col("path")),
            "action": request_action(F.col("method"), F.col("query"), presigned_is_read),
        }
    )
    rows = classify_identity(rows, identity)
    rows = fingerprint_requests(resolve_users_object(rows, patterns, excluded_prefixes), patterns)
    return rows.select(
        "event_id",
        "protocol",
        _label(F.lit("app")).alias("admin_id"),
        "action",
        F.concat_ws("/", "bucket", "key").alias("resource"),
        F.concat(
            F.lit("bucket: "), "bucket", F.lit("; key: "), "key", F.lit("; action: "), "action"
        ).alias("scope"),
        "query_fingerprint",
        "affected_users",
        F.col("ts_ms").alias("timestamp"),
        F.md5(F.concat_ws("|", "source_ip", "credential")).alias("session_id"),
        _metadata(
            bucket=F.col("bucket"),
            key=F.col("key"),
            source_ip=F.col("source_ip"),
            user_agent=headers["user-agent"],
        ).alias("metadata"),
    )
