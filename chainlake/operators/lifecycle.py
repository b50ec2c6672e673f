"""Retention, erasure and the tombstones they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.operators.chain import build_chains
from chainlake.operators.events import system_to_deployment
from chainlake.schemas import DEPLOYMENT_CHAIN


def retention_candidates(meta: DataFrame, now_s: int, days: int = 365) -> DataFrame:
    """User chains (chain_id, created_at, entry_count) created strictly before the cut-off."""
    return meta.filter(
        (F.col("chain_id") != DEPLOYMENT_CHAIN)
        & (F.col("created_at") >= 0)
        & (F.col("created_at") < now_s - days * 86_400)
    )


def without_chains(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries of all chains but the removed ones.

    The removed ids are unique; when the entries side has one huge chain, adaptive
    execution splits that partition of the join.
    """
    return entries.join(removed.select("chain_id").distinct(), "chain_id", "left_anti")


apply_retention = without_chains


def exclude_erased(entries: DataFrame, erased: DataFrame) -> DataFrame:
    """Entries without those of erased chains; a chain that started again after its erasure stays.

    ``erased``: chain_id, erased_at (seconds).
    """
    last = erased.groupBy("chain_id").agg(F.max("erased_at").alias("__erased_at"))
    kept = F.col("__erased_at").isNull() | (F.col("timestamp") > F.col("__erased_at"))
    return entries.join(last, "chain_id", "left").filter(kept).select(*entries.columns)


def retention_tombstones(
    candidates: DataFrame, now_s: int, days: int = 365, failed: DataFrame | None = None
) -> DataFrame:
    """One system event per removed chain; none where the delete failed."""
    rows = candidates if failed is None else without_chains(candidates, failed)
    return rows.select(
        F.xxhash64("chain_id").bitwiseAND(F.lit((1 << 62) - 1)).alias("event_id"),
        F.lit("system:retention-reaper").alias("actor_id"),
        F.lit("system").alias("actor_type"),
        F.lit("retention_sweep").alias("category"),
        F.lit("delete").alias("action"),
        F.lit("chain").alias("resource"),
        F.concat(F.lit("retention sweep removed chain "), "chain_id").alias("scope"),
        F.create_map(
            F.lit("chain_id"),
            F.col("chain_id"),
            F.lit("entry_count"),
            F.col("entry_count").cast("string"),
            F.lit("created_at"),
            F.col("created_at").cast("string"),
            F.lit("retention_days"),
            F.lit(str(days)),
        ).alias("details"),
        F.lit(None).cast("string").alias("artifact_hash"),
        F.lit(now_s * 1000).cast("bigint").alias("timestamp"),
        F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("source_ip"),
    )


def erasure_tombstones(requests: DataFrame) -> DataFrame:
    """System event per erasure request (request_id, chain_id, requested_at s, source_ip, session_id)."""
    return requests.select(
        F.col("request_id").alias("event_id"),
        F.col("chain_id").alias("actor_id"),
        F.lit("system").alias("actor_type"),
        F.lit("user_erasure_requested").alias("category"),
        F.lit("delete").alias("action"),
        F.lit("user_chain").alias("resource"),
        F.concat(F.lit("user_chain erasure for "), "chain_id").alias("scope"),
        F.create_map(
            F.lit("user_id_hash"),
            F.col("chain_id"),
            F.lit("source_ip"),
            F.col("source_ip"),
            F.lit("requested_at"),
            F.col("requested_at").cast("string"),
            F.lit("requested_by"),
            F.lit("data_subject"),
        ).alias("details"),
        F.lit(None).cast("string").alias("artifact_hash"),
        (F.col("requested_at") * 1000).alias("timestamp"),
        "session_id",
        "source_ip",
    )


def admit_erasures(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``status``: 200 for the first request of an existing chain, else 404.

    ``existing`` lists the chains that still have entries.
    """
    first = requests.groupBy("chain_id").agg(F.min("request_id").alias("__first"))
    known = existing.select("chain_id").distinct().withColumn("__known", F.lit(True))
    # Few requests meet many chains: both joins are keyed by the requests' chain ids.
    return (
        requests.join(first, "chain_id", "left")
        .join(known, "chain_id", "left")
        .withColumn(
            "status",
            F.when(F.col("__known") & (F.col("request_id") == F.col("__first")), 200).otherwise(404),
        )
        .drop("__first", "__known")
    )


def append_tombstones(tombstones: DataFrame, heads: DataFrame, plain_only: bool = False) -> DataFrame:
    """Chain entries that put the tombstones at the end of the deployment chain."""
    return build_chains(system_to_deployment(tombstones, plain_only), heads)


def erasure_receipts(requests: DataFrame, tombstone_entries: DataFrame) -> DataFrame:
    """Tombstone hash and index for each admitted request."""
    rows = tombstone_entries.select(
        F.get_json_object("payload_json", "$.details.user_id_hash").alias("chain_id"),
        F.get_json_object("payload_json", "$.details.requested_at").cast("bigint").alias("requested_at"),
        F.col("index").alias("tombstone_index"),
        F.col("entry_hash").alias("tombstone_hash"),
    )
    admitted = requests.filter("status = 200").select("request_id", "chain_id", "requested_at")
    # A chain may have been erased before: the time of the request tells its tombstones apart.
    return admitted.join(rows, ["chain_id", "requested_at"]).drop("requested_at")


def erasures(tombstone_entries: DataFrame) -> DataFrame:
    """(chain_id, erased_at) of each committed erasure tombstone; other entries are ignored."""
    return tombstone_entries.filter(
        F.get_json_object("payload_json", "$.category") == "user_erasure_requested"
    ).select(
        F.get_json_object("payload_json", "$.details.user_id_hash").alias("chain_id"),
        F.col("timestamp").alias("erased_at"),
    )


def pending_deletes(entries: DataFrame, tombstone_entries: DataFrame) -> DataFrame:
    """Chains with a committed tombstone whose entries are still there; re-run their delete.

    A chain whose first entry is later than its last tombstone has started again and is not named.
    """
    erased = erasures(tombstone_entries).groupBy("chain_id").agg(F.max("erased_at").alias("erased_at"))
    started = entries.groupBy("chain_id").agg(F.min_by("timestamp", "index").alias("started"))
    return started.join(erased, "chain_id").filter("started <= erased_at").select("chain_id")
