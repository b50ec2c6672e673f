"""Change streams of the data stores as observed changes, with their actor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.operators.scan import Running, bucket_of, running

MARKER_TABLE = "audit_marker"
MARKER_NAMESPACE = ("audit", "markers")
ACTOR_HEADER = "audit-actor"


def parse_marker(data: Column, marker_table: str = MARKER_TABLE) -> Column:
    """Actor of a marker-table insert in change text, doubled quotes undone; else null."""
    actor = F.regexp_extract(data, r"actor_id\[text\]:('[^']*(?:''[^']*)*')(?!')", 1)
    inner = F.replace(F.substring(actor, 2, 1 << 30), F.lit("''"), F.lit("\u0001"))
    cleaned = F.replace(F.replace(inner, F.lit("'"), F.lit("")), F.lit("\u0001"), F.lit("'"))
    return F.when(data.contains(f".{marker_table}: INSERT:") & (actor != ""), cleaned)


def pg_change_stream(lines: DataFrame, marker_table: str = MARKER_TABLE) -> DataFrame:
    """Logical-decoding text (seq, data) to changes; marker rows carry ``marker_actor``."""
    marker = parse_marker(F.col("data"), marker_table)
    table = F.substring_index(F.trim(F.regexp_extract("data", r"^table ([^:]*):", 1)), ".", -1)
    op = F.trim(F.regexp_extract("data", r"^table [^:]*:\s*([^:]*)", 1))
    action = F.when(op.isin("INSERT", "UPDATE"), "write").when(op.isin("DELETE", "TRUNCATE"), "delete")
    return (
        lines.withColumns({"marker_actor": marker, "action": action, "resource": table})
        .filter(
            F.col("marker_actor").isNotNull()
            | (F.col("action").isNotNull() & (F.col("resource") != marker_table))
        )
        .withColumns(
            {
                "source": F.lit("postgres"),
                "scope": F.concat(F.lower(op), F.lit(":"), F.col("resource")),
            }
        )
    )


def doc_change_stream(
    changes: DataFrame, marker_namespace: tuple[str, str] = MARKER_NAMESPACE
) -> DataFrame:
    """Document change events (seq, db, coll, op, doc_key, full_document) to changes."""
    db, coll = marker_namespace
    is_marker = (F.col("db") == db) & (F.col("coll") == coll)
    action = (
        F.when(F.col("op").isin("insert", "update", "replace"), "write")
        .when(F.col("op") == "delete", "delete")
        .when(F.col("op").isin("drop", "rename", "dropDatabase"), "schema_change")
    )
    named = F.coalesce(F.nullif(F.col("coll"), F.lit("")), F.lit("unknown"))
    key = F.coalesce(F.col("doc_key"), F.lit("unknown"))
    return (
        changes.withColumns(
            {
                "marker_actor": F.when(
                    is_marker & (F.col("op") == "insert"),
                    F.get_json_object("full_document", "$.actor_id"),
                ),
                "action": F.when(~is_marker, action),
                "resource": named,
                "source": F.lit("mongodb"),
                "scope": F.concat("op", F.lit(":"), named, F.lit(":key="), key),
            }
        )
        .filter(F.col("marker_actor").isNotNull() | F.col("action").isNotNull())
    )


def actor_from_user_metadata(metadata: Column, header: str = ACTOR_HEADER) -> Column:
    """Actor header of an object's user metadata, whatever its letter case."""
    spelled = "-".join(w.capitalize() for w in header.split("-"))
    exact = [f"x-amz-meta-{header}", f"X-Amz-Meta-{spelled}", f"X-Amz-Meta-{header}"]
    other = F.map_filter(
        metadata, lambda k, v: F.lower(k).endswith(header) & v.isNotNull()
    )
    return F.coalesce(
        *[F.try_element_at(metadata, F.lit(k)) for k in exact], F.get(F.map_values(other), 0)
    )


_NOTIFICATION = (
    "EventName STRING, Records ARRAY<STRUCT<s3: STRUCT<bucket: STRUCT<name: STRING>, "
    "object: STRUCT<key: STRING, size: BIGINT, eTag: STRING, userMetadata: MAP<STRING,STRING>>>>>"
)


def object_event_stream(notifications: DataFrame, header: str = ACTOR_HEADER) -> DataFrame:
    """Object-store notifications (seq, body JSON) to changes; each carries its own actor."""
    name = F.coalesce("n.EventName", F.lit("unknown"))

    def has(*words: str) -> Column:
        out = name.contains(words[0])
        for w in words[1:]:
            out = out | name.contains(w)
        return out

    action = (
        F.when(has("Created", "Put"), "write")
        .when(has("Removed", "Delete"), "delete")
        .when(has("Accessed", "Get", "Head"), "read")
    )
    first = F.get("n.Records", 0)["s3"]
    bucket = F.coalesce(first["bucket"]["name"], F.lit("unknown"))
    key = F.coalesce(first["object"]["key"], F.lit("unknown"))
    return (
        notifications.withColumn("n", F.from_json("body", _NOTIFICATION))
        .withColumns(
            {
                "action": action,
                "resource": F.concat_ws("/", bucket, key),
                "source": F.lit("minio"),
                "scope": F.concat(name, F.lit(":"), bucket, F.lit("/"), key),
                "size": F.coalesce(first["object"]["size"], F.lit(0)),
                "etag": F.coalesce(first["object"]["eTag"], F.lit("")),
                "actor": F.coalesce(
                    actor_from_user_metadata(first["object"]["userMetadata"], header),
                    F.lit("observer:minio"),
                ),
            }
        )
        .filter("n IS NOT NULL AND action IS NOT NULL")
        .drop("n")
    )


def attribute_actor(changes: DataFrame, by: str | None = None, bucket_rows: int = 1_000_000) -> DataFrame:
    """As-of join of each change with the latest marker before it in stream order.

    Marker rows are removed; a change before any marker gets ``observer:<source>``.
    ``seq`` is the unique stream position; ``by`` adds a slot per value of that column.
    """
    keys = ["source"] + ([by] if by else [])
    out = running(
        changes,
        keys,
        ["seq"],
        bucket_of(F.col("seq"), bucket_rows),
        {"__actor": Running("last", F.col("marker_actor"))},
        bucket_rows=bucket_rows,
    )
    return (
        out.filter("marker_actor IS NULL")
        .withColumn("actor", F.coalesce("__actor", F.concat(F.lit("observer:"), "source")))
        .drop("__actor", "marker_actor")
    )
