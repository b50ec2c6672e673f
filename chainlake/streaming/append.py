"""Streams that append to chains, and the comparison ticks that follow them.

Chains are appended to a store of runs (``sources/chain_store.py``), whose manifest names the last batch: a batch that
runs again after a failure starts anew, one that is committed is left as it is. What the comparison writes goes into
partitions named by the tick, so a tick that runs again replaces its own output. One streaming query owns a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.operators.compare import process2
from chainlake.operators.events import access_payloads, longest_chain, system_to_deployment
from chainlake.schemas import CHAIN_ENTRY, CHAIN_ENTRY_COLUMNS
from chainlake.session import new_path
from chainlake.sources import chain_store
from chainlake.sources.chain_store import overwrite_partitions as _overwrite, read_or_empty as _read

RETENTION_DAYS = 7
_CURSORS = "cursor_prx BIGINT, cursor_obs BIGINT, divergent BOOLEAN, entries_verified BIGINT, tail_depth BIGINT, tick_id BIGINT"


def current_heads(spark: SparkSession, path: str) -> DataFrame:
    """Latest head of each chain."""
    return chain_store.heads(spark, path)


def appended_entries(spark: SparkSession, path: str) -> DataFrame:
    return chain_store.entries(spark, path)


def mixed_events(access: DataFrame, system: DataFrame) -> DataFrame:
    """Access and system events as one table or stream: (event_id, timestamp, access, system).

    One of the two structs of a row is null. Ids are offsets of one arrival order, so they
    are unique over both kinds.
    """
    one, two = F.struct(*access.columns), F.struct(*system.columns)
    return access.select(
        "event_id", "timestamp", one.alias("access"), F.lit(None).cast(system.schema).alias("system")
    ).unionByName(
        system.select("event_id", "timestamp", F.lit(None).cast(access.schema).alias("access"), two.alias("system"))
    )


def _payloads(events: DataFrame, salt: str) -> tuple[DataFrame, int]:
    """Payload rows of a batch and the number of rows of its largest chain."""
    if "system" not in events.columns:
        return access_payloads(events, salt), longest_chain(events)
    access = events.filter("access IS NOT NULL").select("access.*")
    system = events.filter("system IS NOT NULL").select("system.*")
    rows = access_payloads(access, salt).unionByName(system_to_deployment(system))
    return rows, longest_chain(access) + system.count()


def append_batch(events: DataFrame, batch_id: int, path: str, salt: str) -> None:
    """Append one micro-batch of access events or ``mixed_events``; redelivered ids are ignored.

    System events go to the deployment chain. Ids are remembered by day for the transit
    retention, which is how long the source can redeliver, so the look-up reads a bounded
    number of days. Only heads of chains that the batch touches enter the linking. Half-done erasures and sweeps
    of the store are completed first, and buckets of many runs are compacted.
    """
    spark = events.sparkSession
    chain_store.compact(spark, path)
    day = F.floor(F.col("timestamp") / 86_400_000).cast("bigint")
    batch = events.dropDuplicates(["event_id"]).withColumn("__day", day)
    oldest = batch.agg(F.min("__day")).first()[0]
    if oldest is None:
        return
    seen = (
        _read(spark, f"{path}/ids", "event_id BIGINT, batch_id BIGINT, day BIGINT")
        .filter((F.col("day") >= oldest - RETENTION_DAYS) & (F.col("batch_id") != batch_id))
        .select("event_id")
    )
    # Used by the jobs below. Stored compressed and deleted at the end: a cache would spill more, and a lost executor
    # would read its part of the source again.
    kept = new_path(spark, "fresh")
    fresh = batch.join(seen, "event_id", "left_anti")
    fresh.write.option("compression", "zstd").parquet(kept)
    fresh = spark.read.schema(fresh.schema).parquet(kept)
    try:
        # Ids first: a batch that breaks off before its commit ignores its own ids when it runs again.
        ids = fresh.select("event_id", F.lit(batch_id).cast("bigint").alias("batch_id"), F.col("__day").alias("day"))
        _overwrite(ids, f"{path}/ids", "day", "batch_id")
        payloads, longest = _payloads(fresh.drop("__day"), salt)
        chain_store.append(payloads, path, longest=longest, batch=batch_id)
    finally:
        chain_store.delete(spark, kept)


def stream_chain_append(events: DataFrame, path: str, salt: str, checkpoint: str, **trigger):
    """Start the query that appends a stream of access or mixed events to the chains below ``path``."""
    return (
        events.writeStream.foreachBatch(lambda df, i: append_batch(df, i, path, salt))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def with_retention(events: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """Declare how late an event may arrive; stateful operators forget what is older."""
    return events.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark(
        "event_time", f"{days} days"
    )


def without_redelivery(events: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """Each event id of a stream once, as long as it is redelivered within the transit retention."""
    once = with_retention(events, days).dropDuplicatesWithinWatermark(["event_id"])
    return once.select(*events.columns)


def cursor_state(spark: SparkSession, path: str, before: int) -> tuple[int, int]:
    """Cursors after the last tick before ``before``; (0, 0) at the start."""
    row = (
        _read(spark, path, _CURSORS)
        .filter(F.col("tick_id") < before)
        .agg(F.max_by(F.struct("cursor_prx", "cursor_obs"), "tick_id").alias("c"))
        .first()
    )
    return (row["c"][0], row["c"][1]) if row["c"] is not None else (0, 0)


def process2_tick(
    proxy: DataFrame, observer: DataFrame, salt: str, path: str, tick_id: int, limit: int | None = None
) -> DataFrame:
    """One comparison tick: continue from the stored cursors and store the new ones.

    The part of either side that is not compared yet stays for a later tick; time never
    decides anything.
    """
    spark = proxy.sparkSession
    prx, obs = cursor_state(spark, path, tick_id)
    outcome = process2(proxy, observer, salt, prx, obs, limit)
    row = outcome.select(
        "cursor_prx", "cursor_obs", "divergent", "entries_verified", "tail_depth",
        F.lit(tick_id).cast("bigint").alias("tick_id"),
    )
    _overwrite(row, path, "tick_id")
    return _read(spark, path, _CURSORS).filter(F.col("tick_id") == tick_id)


_TAIL = CHAIN_ENTRY + ", side STRING, tick_id BIGINT"


def compare_batch(batch: DataFrame, tick_id: int, salt: str, path: str) -> None:
    """One tick over new entries of both sides (``side`` is "proxy" or "observer") and the tail kept from before.

    Each entry is written once, below the tick it came with. A tick reads back only the ticks that still hold
    entries at or after a cursor; the number of the first of them is stored with the cursors.
    """
    spark = batch.sparkSession
    _overwrite(
        batch.select(*CHAIN_ENTRY_COLUMNS, "side", F.lit(tick_id).cast("bigint").alias("tick_id")), f"{path}/tail", "side", "tick_id"
    )
    before = _read(spark, f"{path}/cursors", _STREAM_CURSORS).filter(F.col("tick_id") < tick_id)
    last = before.agg(F.max_by(F.struct("cursor_prx", "cursor_obs", "tail_from"), "tick_id").alias("c")).first()["c"]
    prx, obs, start = last or (0, 0, 0)
    tail = _read(spark, f"{path}/tail", _TAIL).filter((F.col("tick_id") >= start) & (F.col("tick_id") <= tick_id))
    sides = [tail.filter(F.col("side") == s).select(*CHAIN_ENTRY_COLUMNS) for s in ("proxy", "observer")]
    outcome = process2(*sides, salt, prx, obs)
    # An entry stays while it is at or after the cursor of its side, so the oldest tick of such an entry is kept.
    ends = tail.groupBy("side", "tick_id").agg(F.max("index").alias("last"))
    behind = F.when(F.col("side") == "proxy", F.col("cursor_prx")).otherwise(F.col("cursor_obs"))
    held = ends.crossJoin(F.broadcast(outcome.select("cursor_prx", "cursor_obs"))).filter(F.col("last") >= behind)
    first = held.agg(F.coalesce(F.min("tick_id"), F.lit(tick_id + 1)).alias("tail_from"))
    row = outcome.crossJoin(first).select(*_STREAM_COLUMNS, F.lit(tick_id).cast("bigint").alias("tick_id"))
    _overwrite(row, f"{path}/cursors", "tick_id")


_STREAM_CURSORS = (
    "cursor_prx BIGINT, cursor_obs BIGINT, divergent BOOLEAN, entries_verified BIGINT, tail_depth BIGINT, "
    "proxy_payload STRING, observed_payload STRING, canon_error_side STRING, tail_from BIGINT, tick_id BIGINT"
)
_STREAM_COLUMNS = [c.split()[0] for c in _STREAM_CURSORS.split(", ")][:-1]


def stream_process2(proxy: DataFrame, observer: DataFrame, salt: str, path: str, checkpoint: str, **trigger):
    """Start the query that compares two streams of chain entries as they arrive; one tick a micro-batch.

    The sides may be apart by any number of entries; nothing but order pairs them. A divergence keeps both cursors where it is, so
    it is reported again by every later tick. Ticks are read by ``compare_ticks``.
    """
    rows = [
        side.select(*CHAIN_ENTRY_COLUMNS, F.lit(name).alias("side"))
        for name, side in (("proxy", proxy), ("observer", observer))
    ]
    return (
        rows[0].unionByName(rows[1])
        .writeStream.foreachBatch(lambda df, i: compare_batch(df, i, salt, path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compare_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Outcome of every tick: cursors after it, pairs verified in it, entries still waiting, diverging payloads."""
    return _read(spark, f"{path}/cursors", _STREAM_CURSORS)


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what its source holds now and read what it wrote.

    Operators with processing-time timers ask for another batch for ever, so a bounded
    run must not start batches without data.
    """
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)
    return spark.read.schema(stream.schema).parquet(out)
