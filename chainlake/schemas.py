"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

# Ids, sizes and enum spellings that stored hashes depend on.
DEPLOYMENT_CHAIN = "_deployment"
ZERO_HASH = "0" * 64
ENTRY_VERSION = 1
TYPE_ACCESS, TYPE_DEPLOYMENT, TYPE_OBSERVED = 1, 2, 3
MAX_PAYLOAD_BYTES = 1_048_576
CATEGORIES = [
    "admin_access",
    "admin_lifecycle",
    "config",
    "deploy",
    "schema",
    "system",
    "approved_access",
    "egress",
    "user_erasure_requested",
    "retention_sweep",
    "verification_failure",
    "nightly_verification",
    "replica_reshuffle",
]
WITNESSABLE_CATEGORIES = ["admin_access", "schema"]
DATA_ACTIONS = ["read", "write", "delete", "export", "schema_change"]
OBSERVABLE_ACTIONS = ["read", "write", "delete", "schema_change"]

ACCESS_EVENT = (
    "event_id BIGINT, protocol STRING, admin_id STRING, action STRING, resource STRING, "
    "scope STRING, query_fingerprint STRING, affected_users ARRAY<STRING>, timestamp BIGINT, "
    "session_id STRING, metadata MAP<STRING,STRING>"
)
SYSTEM_EVENT = (
    "event_id BIGINT, actor_id STRING, actor_type STRING, category STRING, action STRING, "
    "resource STRING, scope STRING, details MAP<STRING,STRING>, artifact_hash STRING, "
    "timestamp BIGINT, session_id STRING, source_ip STRING"
)
CHAIN_ENTRY = (
    "chain_id STRING, version INT, index BIGINT, timestamp BIGINT, prev_hash STRING, "
    "payload_type INT, payload_json STRING, entry_hash STRING"
)
CHAIN_ENTRY_COLUMNS = [part.split()[0] for part in CHAIN_ENTRY.split(", ")]
QUERY_LOG = (
    "event_id BIGINT, ts_ms BIGINT, source_ip STRING, credential STRING, protocol STRING, "
    "session_id STRING, statement STRING"
)
OBJECT_LOG = (
    "event_id BIGINT, ts_ms BIGINT, method STRING, path STRING, query STRING, "
    "headers MAP<STRING,STRING>"
)
ACCESS_PAYLOAD = (
    "action STRING, actor_id STRING, actor_label STRING, actor_type STRING, "
    "affected_user_ids ARRAY<STRING>, correlation_id STRING, protocol STRING, "
    "query_fingerprint STRING, query_shape STRING, resource STRING, "
    "scope STRUCT<bytes: BIGINT, rows: BIGINT>, session_id STRING, source_ip STRING"
)
DEPLOYMENT_PAYLOAD = (
    "action STRING, actor_id STRING, actor_type STRING, category STRING, "
    "details MAP<STRING,STRING>, resource STRING, scope MAP<STRING,STRING>, "
    "session_id STRING, source_ip STRING"
)
OBSERVED_PAYLOAD = (
    "action STRING, actor_id_hash STRING, query_fingerprint STRING, resource STRING"
)
