"""Access and system events to chain payloads, and fan-out to chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions.canon import canonicalize, empty_map, object_text, sorted_map, with_canonical, with_canonical_text
from chainlake.functions.crypto import hmac_sha256_hex
from chainlake.functions.text import ms_to_seconds
from chainlake.schemas import (
    DATA_ACTIONS,
    DEPLOYMENT_CHAIN,
    DEPLOYMENT_PAYLOAD,
    MAX_PAYLOAD_BYTES,
    OBSERVABLE_ACTIONS,
    TYPE_ACCESS,
    TYPE_DEPLOYMENT,
    TYPE_OBSERVED,
    WITNESSABLE_CATEGORIES,
)


def fan_out(events: DataFrame) -> DataFrame:
    """One row per event and chain subject: the deployment first, then each affected user.

    Order and duplicates of ``affected_users`` are kept; ``position`` counts from 0.
    """
    subjects = F.concat(
        F.array(F.lit(DEPLOYMENT_CHAIN)),
        F.coalesce("affected_users", F.array().cast("array<string>")),
    )
    return events.select("*", F.posexplode(subjects).alias("position", "subject"))


def spec_protocol(c: Column) -> Column:
    return F.when(c == "mongo_db", "mongodb").otherwise(c)


def spec_actor_type(c: Column) -> Column:
    return F.when(c == "ci_cd", "cicd").otherwise(c)


def hashed_users(salt: str) -> Column:
    """Keyed digests of the affected users, order and duplicates kept."""
    return F.coalesce(
        F.transform("affected_users", lambda u: hmac_sha256_hex(salt, u)), F.array().cast("array<string>")
    )


def access_members(hashed: Column) -> dict[str, Column]:
    return {
        "actor_id": F.col("admin_id"),
        "actor_type": F.lit("admin"),
        "actor_label": F.col("admin_id"),
        "protocol": spec_protocol(F.col("protocol")),
        "action": F.when(F.col("action").isin(DATA_ACTIONS), F.col("action")).otherwise("write"),
        "resource": F.col("resource"),
        "affected_user_ids": F.array_sort(F.array_distinct(hashed)),
        "query_fingerprint": F.col("query_fingerprint"),
        "scope": F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("rows")),
        "source_ip": F.coalesce(F.element_at("metadata", F.lit("source_ip")), F.lit("unknown")),
        "session_id": F.col("session_id"),
        "correlation_id": F.element_at("metadata", F.lit("correlation_id")),
    }


def deployment_members() -> dict[str, Column]:
    return {
        "actor_id": F.col("admin_id"),
        "actor_type": F.lit("admin"),
        "category": F.lit("admin_access"),
        "action": F.col("action"),
        "resource": F.col("resource"),
        "scope": empty_map(),
        "details": F.struct(
            F.size(F.coalesce("affected_users", F.array().cast("array<string>"))).alias(
                "affected_user_count"
            ),
            F.col("query_fingerprint"),
        ),
        "source_ip": F.coalesce(F.element_at("metadata", F.lit("source_ip")), F.lit("unknown")),
        "session_id": F.col("session_id"),
    }


def to_access_payload(events: DataFrame, salt: str, plain_only: bool = False) -> DataFrame:
    """User-chain payload of each access event."""
    hashed = events.withColumn("__hashed", hashed_users(salt))
    rows = with_canonical(hashed, {"payload_json": access_members(F.col("__hashed"))}, plain_only)
    return rows.drop("__hashed").withColumns(
        {"timestamp": ms_to_seconds(F.col("timestamp")), "payload_type": F.lit(TYPE_ACCESS)}
    )


def access_to_deployment(events: DataFrame, plain_only: bool = False) -> DataFrame:
    """Deployment payload of each access event; carries a user count, never user ids."""
    return with_canonical(events, {"payload_json": deployment_members()}, plain_only).withColumns(
        {"timestamp": ms_to_seconds(F.col("timestamp")), "payload_type": F.lit(TYPE_DEPLOYMENT)}
    )


def access_payloads(events: DataFrame, salt: str, plain_only: bool = False) -> DataFrame:
    """Fan-out with the payload that belongs in each chain, ready for ``build_chains``.

    Digests are made once per event, the text of a row only behind the fan-out: a reader of some chains makes
    the texts of those only, and what each entry is sent to the Unicode helper is one text.
    """
    hashed = events.withColumn("__hashed", hashed_users(salt))
    chains = F.concat(F.array(F.lit(DEPLOYMENT_CHAIN)), "__hashed")
    fanned = hashed.select("*", F.posexplode(chains).alias("position", "chain_id"))
    is_deployment = F.col("position") == 0
    text = F.when(is_deployment, object_text(deployment_members())).otherwise(object_text(access_members(F.col("__hashed"))))
    return with_canonical_text(fanned, {"payload_json": text}, plain_only).select(
        "event_id",
        "position",
        "chain_id",
        ms_to_seconds(F.col("timestamp")).alias("timestamp"),
        F.when(is_deployment, TYPE_DEPLOYMENT).otherwise(TYPE_ACCESS).alias("payload_type"),
        "payload_json",
    )


def longest_chain(events: DataFrame) -> int:
    """Entries the largest chain gets from these events, counted before any digest is made."""
    subjects = events.select(F.explode("affected_users").alias("user")).groupBy("user").count()
    total = events.agg(F.count("*").alias("n"))
    return subjects.agg(F.max("count").alias("n")).unionByName(total).agg(F.max("n")).first()[0] or 0


def system_members() -> dict[str, Column]:
    details = F.coalesce("details", empty_map())
    with_artifact = F.when(
        F.col("artifact_hash").isNotNull(),
        F.map_concat(
            F.map_filter(details, lambda k, v: k != "artifact_hash"),
            F.create_map(F.lit("artifact_hash"), F.col("artifact_hash")),
        ),
    ).otherwise(details)
    return {
        "actor_id": F.col("actor_id"),
        "actor_type": spec_actor_type(F.col("actor_type")),
        "category": F.col("category"),
        "action": F.col("action"),
        "resource": F.col("resource"),
        "scope": F.struct(F.col("scope").alias("description")),
        "details": sorted_map(with_artifact),
        "source_ip": F.coalesce("source_ip", F.lit("unknown")),
        "session_id": F.col("session_id"),
    }


def system_to_deployment(events: DataFrame, plain_only: bool = False) -> DataFrame:
    """Deployment payload of each system event, at the event's own time."""
    return with_canonical(events, {"payload_json": system_members()}, plain_only).select(
        "event_id",
        F.lit(0).alias("position"),
        F.lit(DEPLOYMENT_CHAIN).alias("chain_id"),
        ms_to_seconds(F.col("timestamp")).alias("timestamp"),
        F.lit(TYPE_DEPLOYMENT).alias("payload_type"),
        "payload_json",
    )


def is_observer_witnessable(category: Column) -> Column:
    return category.isin(WITNESSABLE_CATEGORIES)


def observed_members(salt: str, actor: Column, fingerprint: Column) -> dict[str, Column]:
    return {
        "action": F.col("action"),
        "resource": F.col("resource"),
        "actor_id_hash": hmac_sha256_hex(salt, actor),
        "query_fingerprint": fingerprint,
    }


def parse_deployment(entries: DataFrame) -> DataFrame:
    """Chain entries with their deployment payload parsed into the struct ``p``.

    By a generator of one row: a filter on a plain column of it would be moved below and parse the text for each member it asks for.
    """
    return entries.select("*", F.explode(F.array(F.from_json("payload_json", DEPLOYMENT_PAYLOAD))).alias("p"))


def is_projectable() -> Column:
    """Entry (with ``p``) that an observer of the data store can also have seen."""
    data_change = (F.col("p.category") == "admin_access") & F.col("p.action").isin("write", "delete")
    ddl = (F.col("p.category") == "schema") & (F.col("p.action") == "schema_change")
    return F.coalesce(
        (F.col("payload_type") == TYPE_DEPLOYMENT)
        & (data_change | ddl)
        & F.col("p.details")["query_fingerprint"].isNotNull(),
        F.lit(False),
    )


def project_to_observed(
    entries: DataFrame, salt: str, fingerprint: Column | None = None, plain_only: bool = False
) -> DataFrame:
    """Deployment entries in the shape an observer writes; others are dropped."""
    rows = parse_deployment(entries).filter(is_projectable())
    rows = rows.select(
        *entries.columns,
        F.col("p.action").alias("action"),
        F.col("p.resource").alias("resource"),
        F.col("p.actor_id").alias("actor"),
        F.col("p.details")["query_fingerprint"].alias("fingerprint"),
    )
    shared = F.col("fingerprint") if fingerprint is None else fingerprint
    members = observed_members(salt, F.col("actor"), shared)
    out = rows.select("chain_id", "index", "timestamp", *[members[n].alias(n) for n in members])
    return with_canonical(out, {"observed_json": {n: F.col(n) for n in members}}, plain_only)


def observe_change(
    changes: DataFrame, salt: str, fingerprint: Column | None = None, plain_only: bool = False
) -> DataFrame:
    """Attributed change rows (seq, timestamp, action, resource, actor, scope) as observer payloads."""
    shared = F.sha2("scope", 256) if fingerprint is None else fingerprint
    members = observed_members(salt, F.col("actor"), shared)
    kept = changes.filter(F.col("action").isin(OBSERVABLE_ACTIONS))
    return with_canonical(kept, {"payload_json": members}, plain_only).select(
        F.col("seq").alias("event_id"),
        F.lit(0).alias("position"),
        F.lit(DEPLOYMENT_CHAIN).alias("chain_id"),
        "timestamp",
        F.lit(TYPE_OBSERVED).alias("payload_type"),
        "payload_json",
    )


def payload_well_formed(payloads: DataFrame) -> DataFrame:
    """Why a payload must be refused, or null: null member, size, id order."""
    ids = F.from_json("payload_json", "affected_user_ids ARRAY<STRING>")["affected_user_ids"]
    # Only texts that contain the word can hold a null; the others stay in the JVM.
    suspect = F.when(F.col("payload_json").contains("null"), F.col("payload_json"))
    return payloads.select(
        "*",
        F.when(F.octet_length("payload_json") > MAX_PAYLOAD_BYTES, "too_large")
        .when(canonicalize(suspect)["error"].isNotNull(), canonicalize(suspect)["error"])
        .when(ids.isNotNull() & (ids != F.array_sort(F.array_distinct(ids))), "ids_not_sorted")
        .alias("refusal"),
    )


def assemble_org_view(deployment: DataFrame, user: DataFrame) -> DataFrame:
    """Deployment entries next to the user-chain entries of the same session and second."""
    d = parse_deployment(deployment).select(
        F.col("index").alias("deployment_index"),
        "timestamp",
        F.col("p.session_id").alias("session_id"),
        F.col("p.actor_id").alias("actor_id"),
        F.col("p.action").alias("action"),
    )
    u = user.select(
        "timestamp",
        F.get_json_object("payload_json", "$.session_id").alias("session_id"),
        F.col("chain_id").alias("user_chain"),
        F.col("index").alias("user_index"),
    )
    return d.join(u, ["session_id", "timestamp"], "left")


def attach_sidecar(entries: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Unhashed metadata by (chain_id, entry_index), under its own column."""
    side = sidecar.select("chain_id", F.col("entry_index").alias("index"), "sidecar")
    return entries.join(side, ["chain_id", "index"], "left")
