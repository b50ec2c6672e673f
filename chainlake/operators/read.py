"""Reading chains: ids, heads, ranges, pages, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.operators.chain import verify_chains
from chainlake.schemas import CATEGORIES, DEPLOYMENT_CHAIN, ZERO_HASH

MAX_PAGE = 500


def list_chains(entries: DataFrame) -> DataFrame:
    """User chain ids: exactly 64 hex digits."""
    return entries.select("chain_id").distinct().filter(F.col("chain_id").rlike("^[0-9A-Fa-f]{64}$"))


def read_range(entries: DataFrame, chain_id: str, start: int, limit: int) -> DataFrame:
    """Entries ``start`` up to ``start + limit``; the filter reaches the file scan."""
    return entries.filter(
        (F.col("chain_id") == chain_id) & (F.col("index") >= start) & (F.col("index") < start + limit)
    ).orderBy("index")


def read_entry(entries: DataFrame, chain_id: str, index: int) -> DataFrame:
    return entries.filter((F.col("chain_id") == chain_id) & (F.col("index") == index))


def chain_heads(entries: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Head, entry count and last timestamp per chain; chains without entries have the zero head."""
    heads = entries.groupBy("chain_id").agg(
        F.count("*").alias("entry_count"),
        F.max_by("entry_hash", "index").alias("head"),
        F.max_by("timestamp", "index").alias("last_timestamp"),
    )
    if chains is None:
        return heads
    return chains.select("chain_id").join(heads, "chain_id", "left").select(
        "chain_id",
        F.coalesce("entry_count", F.lit(0)).alias("entry_count"),
        F.coalesce("head", F.lit(ZERO_HASH)).alias("head"),
        "last_timestamp",
    )


def chain_meta(entries: DataFrame) -> DataFrame:
    """Creation time (timestamp of the first entry) and entry count per chain."""
    return entries.groupBy("chain_id").agg(
        F.min_by("timestamp", "index").alias("created_at"), F.count("*").alias("entry_count")
    )


def page(entries: DataFrame, chain_id: str, cursor: int = 0, limit: int = 100) -> DataFrame:
    """One page of a chain; each row repeats next_cursor (null at the end), head_hash and total."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1..{MAX_PAGE}")
    chain = entries.filter(F.col("chain_id") == chain_id)
    head = chain_heads(chain).select(
        "chain_id", F.col("head").alias("head_hash"), F.col("entry_count").alias("total")
    )
    rows = read_range(entries, chain_id, cursor, limit)
    return rows.join(F.broadcast(head), "chain_id").withColumn(
        "next_cursor", F.when(F.col("total") > cursor + limit, F.lit(cursor + limit))
    )


def page_by_number(entries: DataFrame, chain_id: str, number: int, limit: int) -> DataFrame:
    return read_range(entries, chain_id, number * limit, limit)


def category_counts(deployment: DataFrame) -> DataFrame:
    """Entries per category, every known category present."""
    spark = deployment.sparkSession
    known = spark.createDataFrame([(c,) for c in CATEGORIES], "category STRING")
    counts = (
        deployment.select(F.get_json_object("payload_json", "$.category").alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("n"))
    )
    return known.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def category_counts_wide(deployment: DataFrame) -> DataFrame:
    """The counts of ``category_counts`` as one row with a column per category."""
    category = F.get_json_object("payload_json", "$.category")
    return deployment.select(category.alias("c")).agg(
        *[F.count_if(F.col("c") == name).alias(name) for name in CATEGORIES]
    )


def status(entries: DataFrame) -> DataFrame:
    """Number of user chains and of entries in all chains."""
    per_chain = entries.groupBy("chain_id").agg(F.count("*").alias("n"))
    return per_chain.agg(
        F.count_if(F.col("chain_id") != DEPLOYMENT_CHAIN).alias("user_chains"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
    )


def verify_all(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed and failed counts, ids and errors of the failing chains)."""
    verdicts = verify_chains(entries)
    counts = verdicts.agg(
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed")
    )
    return counts, verdicts.filter(~F.col("ok")).select("chain_id", "valid_prefix", "error")


def access_timeline(entries: DataFrame) -> DataFrame:
    """User-chain entries with their day and action badge; sort by chain, newest first, to show."""
    action = F.get_json_object("payload_json", "$.action")
    badge = (
        F.when(action == "read", "green")
        .when(action == "write", "amber")
        .when(action == "delete", "red")
        .when(action == "export", "purple")
        .otherwise("grey")
    )
    return entries.filter(F.col("chain_id") != DEPLOYMENT_CHAIN).select(
        "chain_id",
        "index",
        "timestamp",
        F.to_date(F.timestamp_seconds("timestamp")).alias("day"),
        F.get_json_object("payload_json", "$.actor_id").alias("actor_id"),
        action.alias("action"),
        F.get_json_object("payload_json", "$.resource").alias("resource"),
        badge.alias("badge"),
    )


def digest_entries(
    entries: DataFrame, now_s: int, window_s: int = 86_400, excluded_shapes: DataFrame | None = None
) -> DataFrame:
    """The entries a digest lists: those of the window, without excluded query shapes."""
    rows = entries.filter((F.col("timestamp") > now_s - window_s) & (F.col("timestamp") <= now_s))
    if excluded_shapes is not None:
        shape = F.get_json_object("payload_json", "$.query_fingerprint")
        rows = rows.withColumn("query_fingerprint", shape).join(
            excluded_shapes.select("query_fingerprint").distinct(), "query_fingerprint", "left_anti"
        )
    return access_timeline(rows)


def digest(
    entries: DataFrame, now_s: int, window_s: int = 86_400, excluded_shapes: DataFrame | None = None
) -> DataFrame:
    """Accesses per user chain in the window, by action; the list itself is ``digest_entries``."""
    return (
        digest_entries(entries, now_s, window_s, excluded_shapes)
        .groupBy("chain_id")
        .agg(
            F.count("*").alias("accesses"),
            *[F.count_if(F.col("action") == a).alias(f"{a}s") for a in ("read", "write", "delete", "export")],
            F.max("timestamp").alias("last_access"),
        )
    )


def unread(entries: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Entries after each user's last visit (chain_id, since); no visit counts them all.

    Entries are first counted per chain and second, so the join moves counts, not entries.
    """
    per_second = (
        entries.filter(F.col("chain_id") != DEPLOYMENT_CHAIN)
        .groupBy("chain_id", "timestamp")
        .agg(F.count("*").alias("n"))
    )
    joined = per_second.join(last_seen.select("chain_id", "since"), "chain_id", "left")
    new = F.col("since").isNull() | (F.col("timestamp") > F.col("since"))
    return joined.groupBy("chain_id").agg(
        F.coalesce(F.sum(F.when(new, F.col("n"))), F.lit(0)).alias("unread")
    )


def integrity_card(entries: DataFrame) -> DataFrame:
    """Per chain: entries, first and last time, and whether it verifies."""
    spans = entries.groupBy("chain_id").agg(
        F.min("timestamp").alias("first_access"), F.max("timestamp").alias("last_access")
    )
    verdicts = verify_chains(entries).select("chain_id", "entries", F.col("ok").alias("verified"))
    return spans.join(verdicts, "chain_id")


def export_rows(entries: DataFrame) -> DataFrame:
    """Columns of the CSV export; deployment rows have no fingerprint, observed rows a hashed actor."""
    field = lambda name: F.get_json_object("payload_json", f"$.{name}")
    return entries.select(
        "index",
        "timestamp",
        F.coalesce(field("actor_id"), field("actor_id_hash")).alias("actor_id"),
        field("action").alias("action"),
        field("resource").alias("resource"),
        F.when(F.col("payload_type") == 2, "").otherwise(field("query_fingerprint")).alias("query_fingerprint"),
        "entry_hash",
    )
