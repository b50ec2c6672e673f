"""Chains at rest as a table of runs: append, compaction, retention and erasure that survive a crash.

Entries and heads lie in Parquet partitions (bucket, run); the bucket is a hash of the chain id. A manifest names the live
runs of each bucket. It is replaced in one step, the last one of a run, so what a broken run left is never read. A rewrite
of some buckets (compaction or removal of chains) replaces the earlier runs of those buckets
only. Heads have the same layout, so a batch reads the heads of its own chains' buckets, not those of all batches.

A store has one writer at a time. Erasure commits its tombstones first and then removes the entries; retention removes
entries first and then writes its tombstones. ``recover`` completes whichever half is missing; every writer
calls it first. Empty batches write nothing but the manifest.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.operators import lifecycle
from chainlake.operators.chain import build_chains
from chainlake.operators.events import system_to_deployment
from chainlake.schemas import CHAIN_ENTRY, CHAIN_ENTRY_COLUMNS, DEPLOYMENT_CHAIN
from chainlake.session import materialize

#: Chosen once for a store: a rewrite reads whole buckets.
BUCKETS = 64
#: Runs of a bucket after which ``compact`` rewrites it.
COMPACT_RUNS = 16

_LAYOUT = ", bucket INT, run BIGINT"
_HEAD = "chain_id STRING, entry_count BIGINT, head STRING, last_timestamp BIGINT, created_at BIGINT"
_REMOVED = "chain_id STRING, entry_count BIGINT, created_at BIGINT, at BIGINT, days INT, run BIGINT"
_MANIFEST = "kind STRING, bucket INT, run BIGINT, version BIGINT"
HEAD_COLUMNS = [c.split()[0] for c in _HEAD.split(", ")]


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table; a folder that isn't there yet is an empty one, anything else an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that ``df`` has rows of."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*partitions)
        .parquet(path)
    )


def bucket_of_chain(chain_id: str = "chain_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(chain_id), F.lit(buckets)).cast("int")


@dataclass
class State:
    """What a store holds: live runs of each bucket, open erasures and sweeps, the last batch of a stream."""

    version: int = -1
    live: dict[int, list[int]] = field(default_factory=dict)
    open: list[tuple[str, int]] = field(default_factory=list)
    batch: int = -1

    def rows(self) -> list[tuple]:
        live = [("live", b, run, self.version) for b, runs in sorted(self.live.items()) for run in runs]
        return live + [(kind, None, run, self.version) for kind, run in self.open] + [("batch", None, self.batch, self.version)]


def state(spark: SparkSession, path: str) -> State:
    """The newest manifest; its rows are bounded by ``BUCKETS`` times the runs that ``compact`` leaves."""
    table = read_or_empty(spark, f"{path}/manifest", _MANIFEST)
    newest = table.agg(F.max("version")).first()[0]
    if newest is None:
        return State()
    out = State(newest)
    for r in table.filter(F.col("version") == newest).orderBy("run").collect():
        if r["kind"] == "live":
            out.live.setdefault(r["bucket"], []).append(r["run"])
        elif r["kind"] == "batch":
            out.batch = r["run"]
        else:
            out.open.append((r["kind"], r["run"]))
    return out


def _new_run(now: State) -> int:
    """A number that no run had before, also none that was broken off."""
    return max(now.version + 1, time.time_ns() // 1000)


def _commit(spark: SparkSession, path: str, now: State, run: int) -> None:
    now.version = run
    overwrite_partitions(spark.createDataFrame(now.rows(), _MANIFEST).coalesce(1), f"{path}/manifest", "version")


def _visible(table: DataFrame, now: State, buckets: Iterable[int] | None) -> DataFrame:
    """Rows of live runs, by conditions on partition columns only."""
    # Buckets of the same history share a condition.
    alike: dict[tuple, list[int]] = {}
    for b, runs in now.live.items():
        if buckets is None or b in buckets:
            alike.setdefault(tuple(runs), []).append(b)
    keep = F.lit(False)
    for runs, members in alike.items():
        keep = keep | (F.col("bucket").isin(members) & F.col("run").isin(list(runs)))
    return table.filter(keep)


def entries(spark: SparkSession, path: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """Committed entries of all chains, or of those in ``buckets``."""
    table = read_or_empty(spark, f"{path}/entries", CHAIN_ENTRY + _LAYOUT)
    return _visible(table, state(spark, path), buckets).select(*CHAIN_ENTRY_COLUMNS)


def heads(spark: SparkSession, path: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """Latest head of each chain."""
    table = _visible(read_or_empty(spark, f"{path}/heads", _HEAD + _LAYOUT), state(spark, path), buckets)
    latest = F.max_by(F.struct(*HEAD_COLUMNS[1:]), "run").alias("h")
    return table.groupBy("chain_id").agg(latest).select("chain_id", "h.*")


def touched_buckets(rows: DataFrame) -> list[int]:
    """Buckets of the chains of ``rows``: at most ``BUCKETS`` numbers."""
    return [r["b"] for r in rows.select(bucket_of_chain().alias("b")).distinct().collect()]


def append(
    payloads: DataFrame, path: str, longest: int | None = None, batch: int | None = None,
    opens: tuple[str, int] | None = None, closes: tuple[str, int] | None = None,
) -> int:
    """Link payload rows behind the stored chains as a new run; its number, or -1 where ``batch`` is stored already.

    The commit also opens or closes a piece of work that ``recover`` would complete.
    """
    spark = payloads.sparkSession
    now = state(spark, path)
    if batch is not None and batch <= now.batch:
        return -1
    run = opens[1] if opens else _new_run(now)
    buckets = touched_buckets(payloads)
    touched = payloads.select("chain_id").distinct()
    known = heads(spark, path, buckets).join(touched, "chain_id", "left_semi")
    _write_entries(build_chains(payloads, known, longest=longest), path, run)
    new = _run_of(spark, path, run).groupBy("chain_id").agg(
        (F.max("index") + 1).alias("entry_count"),
        F.max_by("entry_hash", "index").alias("head"),
        F.max_by("timestamp", "index").alias("last_timestamp"),
        F.min_by("timestamp", "index").alias("first"),
    )
    created = F.coalesce("created_at", "first").alias("created_at")
    new = new.join(known.select("chain_id", "created_at"), "chain_id", "left")
    _write_heads(new.select(*HEAD_COLUMNS[:-1], created), path, run)
    for b in buckets:
        now.live.setdefault(b, []).append(run)
    now.batch = now.batch if batch is None else batch
    now.open = [o for o in now.open if o != closes] + ([opens] if opens else [])
    _commit(spark, path, now, run)
    return run


def _run_of(spark: SparkSession, path: str, run: int) -> DataFrame:
    return read_or_empty(spark, f"{path}/entries", CHAIN_ENTRY + _LAYOUT).filter(F.col("run") == run)


def _place(rows: DataFrame, run: int) -> DataFrame:
    return rows.withColumn("bucket", bucket_of_chain()).withColumn("run", F.lit(run).cast("bigint"))


def _write_entries(rows: DataFrame, path: str, run: int) -> None:
    overwrite_partitions(_place(rows.select(*CHAIN_ENTRY_COLUMNS), run), f"{path}/entries", "bucket", "run")


def _write_heads(rows: DataFrame, path: str, run: int) -> None:
    overwrite_partitions(_place(rows.select(*HEAD_COLUMNS), run), f"{path}/heads", "bucket", "run")


def _rewrite(spark: SparkSession, path: str, run: int, buckets: list[int], removed: DataFrame | None = None,
             opens: tuple[str, int] | None = None, closes: tuple[str, int] | None = None) -> None:
    """Write the live rows of ``buckets`` without the ``removed`` chains as one run that replaces the earlier ones."""
    now = state(spark, path)
    kept, tops = entries(spark, path, buckets), heads(spark, path, buckets)
    if removed is not None:
        kept, tops = lifecycle.without_chains(kept, removed), lifecycle.without_chains(tops, removed)
    # Ranges of (bucket, chain, index) spread a huge chain over tasks and keep each file clustered.
    keys = ["bucket", "chain_id", "index"]
    placed = _place(kept, run).repartitionByRange(*keys).sortWithinPartitions(*keys)
    overwrite_partitions(placed, f"{path}/entries", "bucket", "run")
    _write_heads(tops, path, run)
    for b in buckets:
        now.live[b] = [run]
    now.open = [o for o in now.open if o != closes] + ([opens] if opens else [])
    _commit(spark, path, now, run)


def compact(spark: SparkSession, path: str, runs: int = COMPACT_RUNS) -> list[int]:
    """Rewrite the buckets that more than ``runs`` runs lie in; the buckets that were rewritten."""
    recover(spark, path)
    now = state(spark, path)
    full = sorted(b for b, held in now.live.items() if len(held) > runs)
    if full:
        _rewrite(spark, path, _new_run(now), full)
    return full


def delete(spark: SparkSession, folder: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def vacuum(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Delete the (bucket, run) folders that a rewrite replaced or that a broken run left, and old manifests.

    Readers of an older state and the one writer must have ended.
    """
    now = state(spark, path)
    gone = set()
    for table, schema in (("entries", CHAIN_ENTRY), ("heads", _HEAD)):
        for r in read_or_empty(spark, f"{path}/{table}", schema + _LAYOUT).select("bucket", "run").distinct().collect():
            if r["run"] not in now.live.get(r["bucket"], []):
                delete(spark, f"{path}/{table}/bucket={r['bucket']}/run={r['run']}")
                gone.add((r["bucket"], r["run"]))
    old = read_or_empty(spark, f"{path}/manifest", _MANIFEST).filter(F.col("version") < now.version)
    for r in old.select("version").distinct().collect():
        delete(spark, f"{path}/manifest/version={r['version']}")
    return sorted(gone)


def _intend(rows: DataFrame, path: str, run: int) -> DataFrame:
    """Store the chains that a run is about to remove; it counts only once the run is committed."""
    placed = rows.select("chain_id", "entry_count", "created_at", "at", "days", F.lit(run).cast("bigint").alias("run"))
    overwrite_partitions(placed, f"{path}/removed", "run")
    return _intended(rows.sparkSession, path, run)


def _intended(spark: SparkSession, path: str, run: int) -> DataFrame:
    return read_or_empty(spark, f"{path}/removed", _REMOVED).filter(F.col("run") == run)


def erase(requests: DataFrame, path: str, finish: bool = True) -> DataFrame:
    """Erase the chains that requests (request_id, chain_id, requested_at s, source_ip, session_id) name.

    One row per request: request_id, chain_id, status (200 or 404), tombstone_index, tombstone_hash, deleted. With
    ``finish`` off, or after a crash, the tombstones are committed and the entries still there: ``deleted`` is
    false and ``recover`` removes them.
    """
    spark = requests.sparkSession
    recover(spark, path)
    run = _new_run(state(spark, path))
    buckets = touched_buckets(requests)
    known = heads(spark, path, buckets).filter(F.col("chain_id") != DEPLOYMENT_CHAIN)
    admitted = materialize(lifecycle.admit_erasures(requests, known), "erasure")
    accepted = admitted.filter("status = 200")
    gone = known.join(accepted.select("chain_id", F.col("requested_at").alias("at")), "chain_id")
    _intend(gone.withColumn("days", F.lit(None).cast("int")), path, run)
    append(system_to_deployment(lifecycle.erasure_tombstones(accepted)), path, opens=("erase", run))
    # Receipts before the removal: it may rewrite the bucket of the deployment chain and so move the tombstones.
    tombstones = _run_of(spark, path, run).filter(F.col("chain_id") == DEPLOYMENT_CHAIN)
    receipts = lifecycle.erasure_receipts(admitted, tombstones).drop("chain_id")
    rows = materialize(admitted.join(receipts, "request_id", "left"), "receipts")
    if finish:
        recover(spark, path)
    left = heads(spark, path, buckets).select("chain_id", F.lit(True).alias("__there"))
    deleted = (F.col("status") == 200) & F.col("__there").isNull()
    return rows.join(left, "chain_id", "left").select(
        "request_id", "chain_id", "status", "tombstone_index", "tombstone_hash", deleted.alias("deleted")
    )


def sweep(spark: SparkSession, path: str, now_s: int, days: int = 365, finish: bool = True) -> int:
    """Remove the user chains created more than ``days`` before ``now_s``; the number of removed chains.

    Candidates come from the heads, and only their buckets are rewritten. With ``finish`` off, or after a crash,
    the tombstones are missing and ``recover`` writes them.
    """
    recover(spark, path)
    run = _new_run(state(spark, path))
    old = lifecycle.retention_candidates(heads(spark, path), now_s, days)
    removed = _intend(old.withColumn("at", F.lit(now_s).cast("bigint")).withColumn("days", F.lit(days)), path, run)
    buckets = touched_buckets(removed)
    if buckets:
        _rewrite(spark, path, run, buckets, removed, opens=("sweep", run))
        if finish:
            recover(spark, path)
    return removed.count()


def recover(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Complete committed erasures and sweeps whose second half is missing; what was done, as (kind, run)."""
    work = state(spark, path).open
    for kind, run in work:
        chains = _intended(spark, path, run)
        if kind == "erase":
            _rewrite(spark, path, _new_run(state(spark, path)), touched_buckets(chains), chains, closes=(kind, run))
        else:
            first = chains.select("at", "days").first()
            tombstones = lifecycle.retention_tombstones(chains, first["at"], first["days"])
            append(system_to_deployment(tombstones), path, closes=(kind, run))
    return work
