"""Operational analytics: sessions, batches, health, failures, acknowledgements, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions.text import truncate_reason
from chainlake.operators.fold import SEGMENT_ROWS, ordered_fold
from chainlake.operators.scan import BUCKET_ROWS, Running, bucket_of, dense_ordinal, longest_key, running
from chainlake.session import materialize

# Windows and thresholds.
RECENT_ERROR_MS = 30_000
STALE_OK_MS = 60_000
IDLE_UPTIME_S = 30
BATCH_THRESHOLD = 1000
BATCH_CHECKPOINT = 2500
MIN_TTL_S = 3_600
TTL_RANGE_S = 10_800
LAG_MARGIN_MS = 5_000


def session_summary(ops: DataFrame, ends: DataFrame | None = None, now_ms: int | None = None) -> DataFrame:
    """Per session: operations, rows, start, duration and state.

    ``ends`` (session_id, ended_at, verified) closes sessions; the others are active and
    last until ``now_ms``, or their last operation when that is not given.
    """
    s = ops.groupBy("session_id").agg(
        F.count("*").alias("op_count"),
        F.coalesce(F.sum("affected_rows"), F.lit(0)).alias("affected_rows"),
        F.min("ts_ms").alias("started_at"),
        F.max("ts_ms").alias("__last"),
    )
    if ends is None:
        s = s.select("*", F.lit(None).cast("bigint").alias("ended_at"), F.lit(None).cast("boolean").alias("verified"))
    else:
        s = s.join(ends.select("session_id", "ended_at", "verified"), "session_id", "left")
    end = F.col("__last") if now_ms is None else F.lit(now_ms)
    return s.select(
        "session_id",
        "op_count",
        "affected_rows",
        "started_at",
        (F.coalesce("ended_at", end) - F.col("started_at")).alias("duration_ms"),
        F.when(F.col("ended_at").isNull(), "active")
        .when(F.col("verified").isNull(), "ended")
        .otherwise("verified")
        .alias("state"),
    )


def session_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if(F.col("state") == "active").alias("active"),
        F.count_if(F.col("state") != "active").alias("ended"),
    )


def sessionize(
    ops: DataFrame, key: str = "admin_id", gap_ms: int = 1_800_000, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Sessions for operations without a session id: a pause over ``gap_ms`` starts a new one.

    ``seq`` is the unique arrival position and agrees with ``ts_ms`` order.
    """
    bucket = bucket_of(F.col("seq"), bucket_rows)
    longest = longest_key(ops, [key])
    previous = {"__prev": Running("last", F.col("ts_ms"), inclusive=False)}
    timed = running(ops, [key], ["seq"], bucket, previous, longest, bucket_rows)
    starts = F.col("__prev").isNull() | (F.col("ts_ms") - F.col("__prev") > gap_ms)
    sessions = {"__session": Running("sum", F.when(starts, 1).otherwise(0))}
    numbered = running(timed, [key], ["seq"], bucket, sessions, longest, bucket_rows)
    return numbered.groupBy(key, F.col("__session").alias("session_number")).agg(
        F.count("*").alias("op_count"),
        F.min("ts_ms").alias("started_at"),
        F.max("ts_ms").alias("ended_at"),
    )


def summarize_batch(ops: DataFrame, threshold: int = BATCH_THRESHOLD) -> DataFrame:
    """One row per large operation (template, affected_rows, before_state, after_state)."""
    return ops.filter(F.col("affected_rows") >= threshold).select(
        *[c for c in ops.columns if c not in ("before_state", "after_state")],
        F.sha2("before_state", 256).alias("checksum_before"),
        F.sha2("after_state", 256).alias("checksum_after"),
    )


def batch_checkpoints(
    rows: DataFrame, key: str, order: str, digest: str, every: int = BATCH_CHECKPOINT, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Digest of every ``every`` consecutive rows of a large operation."""
    numbered = dense_ordinal(
        rows.select(key, order, digest),
        [key],
        [order],
        bucket_of(F.col(order), bucket_rows),
        "__n",
        bucket_rows=bucket_rows,
    )
    pairs = F.array_sort(F.collect_list(F.struct("__n", digest)))
    return (
        numbered.withColumn("checkpoint", F.floor(F.col("__n") / every).cast("bigint"))
        .groupBy(key, "checkpoint")
        .agg(
            F.count("*").alias("row_count"),
            F.sha2(F.array_join(F.transform(pairs, lambda p: p[digest]), ""), 256).alias("digest"),
        )
    )


def subsystem_health(
    stamps: DataFrame, now_ms: int, uptime_s: int, configured: DataFrame | None = None
) -> DataFrame:
    """Status per subsystem from its success and failure stamps (subsystem, kind, ts_ms, reason)."""
    bad = F.when(F.col("kind") == "err", F.col("ts_ms"))
    s = stamps.groupBy("subsystem").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "ok", F.col("ts_ms"))), F.lit(0)).alias("ok_ms"),
        F.coalesce(F.max(bad), F.lit(0)).alias("err_ms"),
        F.max_by("reason", F.struct(bad, F.col("reason"))).alias("__reason"),
    )
    s = s.withColumn("__configured", F.lit(True))
    if configured is not None:
        s = configured.select("subsystem", F.col("configured").alias("__set")).join(s, "subsystem", "left")
        s = s.withColumn("__configured", F.col("__set"))
    ok, err = F.coalesce("ok_ms", F.lit(0)), F.coalesce("err_ms", F.lit(0))
    status = (
        F.when(~F.col("__configured"), "not_configured")
        .when((err > 0) & (F.lit(now_ms) - err < RECENT_ERROR_MS) & (ok < err), "down")
        .when((ok == 0) & F.lit(uptime_s > IDLE_UPTIME_S), "idle")
        .when((ok > 0) & (F.lit(now_ms) - ok > STALE_OK_MS), "stale")
        .otherwise("ok")
    )
    return s.select(
        "subsystem",
        ok.alias("ok_ms"),
        err.alias("err_ms"),
        F.when(err > 0, truncate_reason(F.col("__reason"))).alias("reason"),
        status.alias("status"),
    )


def health_rollup(health: DataFrame) -> DataFrame:
    """One overall status of all subsystem and capacity rows."""
    return health.agg(
        F.when(F.coalesce(F.bool_or(F.col("status").isin("down", "exhausted")), F.lit(False)), "unhealthy")
        .when(
            F.coalesce(F.bool_or(F.col("status").isin("stale", "idle", "degraded")), F.lit(False)), "degraded"
        )
        .otherwise("ok")
        .alias("status")
    )


def failure_severity(failures: DataFrame) -> DataFrame:
    """Add ``severity`` to failures (kind, acked, total, streak, quorum_holds)."""
    below = F.col("acked") < F.floor(F.col("total") / 2) + 1
    commit = F.when(F.coalesce(below, F.lit(False)) | (F.col("streak") >= 10), "critical").otherwise("error")
    return failures.withColumn(
        "severity",
        F.when(F.col("kind").isin("chain_corruption", "verification_divergence"), "critical")
        .when(F.col("kind") == "replica_unreachable", F.when(F.col("quorum_holds"), "warning").otherwise("critical"))
        .otherwise(commit),
    )


def quorum_ack(writes: DataFrame, replica_count: int, threshold: int | None = None) -> DataFrame:
    """Per entry of a write log (chain_id, index, replica_id, ok): acknowledged and durable?"""
    needed = threshold or replica_count // 2 + 1
    return (
        writes.groupBy("chain_id", "index")
        .agg(F.countDistinct(F.when(F.col("ok"), F.col("replica_id"))).alias("acked"))
        .withColumn("durable", F.col("acked") >= needed)
    )


def verification_report(process1: DataFrame, process2: DataFrame) -> DataFrame:
    """One row that sums up both processes of a verification run."""
    return process1.unionByName(process2, allowMissingColumns=True).agg(
        F.max("user_chains_checked").alias("user_chains_checked"),
        F.max("user_chains_divergent").alias("user_chains_divergent"),
        F.max("head_divergences").alias("head_divergences"),
        F.coalesce(F.bool_or("divergent"), F.lit(False)).alias("observer_divergent"),
        F.max("entries_verified").alias("observer_entries_verified"),
        F.max("tail_depth").alias("observer_tail_depth"),
        (F.max("head_divergences") == 0).alias("clean"),
    )


def system_event(
    rows: DataFrame,
    actor_id: str,
    category: str,
    action: str,
    resource: Column,
    scope: Column,
    details: dict[str, Column],
    event_id: Column,
    timestamp: Column,
) -> DataFrame:
    """Summary, failure or notice rows in the ``SYSTEM_EVENT`` shape."""
    members = [part for name, value in details.items() for part in (F.lit(name), value.cast("string"))]
    return rows.select(
        event_id.cast("bigint").alias("event_id"),
        F.lit(actor_id).alias("actor_id"),
        F.lit("system").alias("actor_type"),
        F.lit(category).alias("category"),
        F.lit(action).alias("action"),
        resource.alias("resource"),
        scope.alias("scope"),
        F.map_filter(F.create_map(*members), lambda k, v: v.isNotNull()).alias("details"),
        F.lit(None).cast("string").alias("artifact_hash"),
        timestamp.cast("bigint").alias("timestamp"),
        F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("source_ip"),
    )


def replication_gate(sessions: DataFrame, now_ms: int) -> DataFrame:
    """Ended sessions (ended_at, max_lag_ms) old enough to compare with their replica."""
    ready = F.col("ended_at") + F.col("max_lag_ms") + LAG_MARGIN_MS
    return sessions.withColumn("ready_at", ready).filter(F.lit(now_ms) >= F.col("ready_at"))


def assignment_from_seed(seed: Column, replicas: Column) -> Column:
    """Struct (verifier_ordinal, ttl_secs) that a recorded hex seed determines.

    The ordinals 1 .. replicas - 1 are shuffled from the back; each swap takes its place
    from the first eight bytes of the state, which is then hashed. Both fields are null
    where nobody is left to verify or the seed is not 32 bytes of hex.
    """
    whole = F.lower(seed)
    usable = whole.rlike("^[0-9a-f]{64}$") & (replicas >= 2)
    count = F.when(usable, replicas).otherwise(2).cast("int")

    def number(hex_text: Column) -> Column:
        return F.conv(hex_text, 16, 10).cast("decimal(20,0)")

    def swap(acc: Column, i: Column) -> Column:
        j = (number(F.substring(acc["state"], 1, 16)) % (i + 1)).cast("int")
        order = F.transform(
            acc["order"],
            lambda x, k: F.when(k == i, F.get(acc["order"], j)).when(k == j, F.get(acc["order"], i)).otherwise(x),
        )
        return F.struct(order.alias("order"), F.sha2(F.unhex(acc["state"]), 256).alias("state"))

    # Places to swap, last first; with one candidate there is none.
    places = F.filter(F.sequence(F.greatest(count - 2, F.lit(0)), F.lit(0), F.lit(-1)), lambda i: i > 0)
    start = F.struct(F.sequence(F.lit(1), count - 1).alias("order"), whole.alias("state"))
    first = F.aggregate(places, start, swap, lambda acc: F.get(acc["order"], F.lit(0)))
    ttl = number(F.substring(whole, 49, 16)) % TTL_RANGE_S + MIN_TTL_S
    return F.struct(
        F.when(usable, first).cast("bigint").alias("verifier_ordinal"),
        F.when(usable, ttl).cast("bigint").alias("ttl_secs"),
    )


def audit_assignments(sessions: DataFrame) -> DataFrame:
    """Recorded assignments (session_id, seed, replica_count, verifier_ordinal, ttl_secs) re-derived."""
    derived = sessions.withColumn("__d", assignment_from_seed(F.col("seed"), F.col("replica_count")))
    same = (F.col("__d.verifier_ordinal") == F.col("verifier_ordinal")) & (
        F.col("__d.ttl_secs") == F.col("ttl_secs")
    )
    return derived.select(
        "session_id",
        F.col("__d.verifier_ordinal").alias("expected_ordinal"),
        F.col("__d.ttl_secs").alias("expected_ttl"),
        same.alias("matches"),
    )


def tick_step(last: int, lo: int, hi: int, period_ms: int, debounce_ms: int) -> tuple[int, int | None, int | None, int]:
    """(timer runs due before ``lo``, up to two runs that the requests cause, the last run).

    After a run the scheduler pauses for ``debounce_ms`` and then waits for the timer or a
    request; requests made meanwhile share one run right after the pause. All requests lie between the
    first and the last one, ``lo`` and ``hi``, which are less than a pause apart (or equal): the run for the
    first one leaves at most one more, after the pause, wherever the others lie.
    """
    cycle = period_ms + debounce_ms
    timers = max(0, lo - last) // cycle
    last += timers * cycle
    runs = []
    if lo > last:
        last = max(lo, last + debounce_ms)
        runs.append(last)
    if hi > last:
        last += debounce_ms
        runs.append(last)
    first, second = (*runs, None, None)[:2]
    return timers, first, second, last


def ticks(
    session_ends: DataFrame,
    start_ms: int,
    end_ms: int,
    period_ms: int = 14_400_000,
    debounce_ms: int = 60_000,
    segment_rows: int = SEGMENT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Verification runs (run_at, trigger) that a timer and session ends (ended_at) cause.

    The scheduler starts at ``start_ms``. First and last end of each slot of one pause stand for all
    ends in it, so there is one row a pause at most, however many sessions end. Where ends are two pauses
    or more apart, but less than a pause and a period, a run happens exactly at the later one, whatever was
    before: there the time line is cut, and the parts are folded side by side.
    """
    pause, cycle = max(debounce_ms, 1), period_ms + debounce_ms

    def step(state, lo, hi, cut, stop):
        if state is None and cut:
            last, timers, first = lo, 0, lo
            second = last + debounce_ms if hi > lo else None
            new = lo if second is None else second
        else:
            last = start_ms if state is None else int(state)
            if stop:
                timers, first, second = max(0, lo - last) // cycle, None, None
                new = last + timers * cycle
            else:
                timers, first, second, new = tick_step(last, lo, hi, period_ms, debounce_ms)
        return str(new), (last, timers, first, second, str(new))

    stop = session_ends.sparkSession.createDataFrame([(end_ms, end_ms, True)], "lo BIGINT, hi BIGINT, stop BOOLEAN")
    at = F.col("ended_at").cast("bigint")
    slots = (
        session_ends.filter(at.between(start_ms, end_ms))
        .groupBy(F.floor(at / pause).alias("slot"))
        .agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
        .select("lo", "hi", F.lit(False).alias("stop"))
        .unionByName(stop)
    )
    slots = materialize(slots, "slots")
    n = slots.count()
    bucket = F.floor(F.col("lo") / (pause * bucket_rows))
    order = ["lo", "stop"]
    gaps = running(slots, [], order, bucket, {"__before": Running("max", F.col("hi"), inclusive=False)}, n, bucket_rows)
    gap = F.col("lo") - F.col("__before")
    cut = F.coalesce(~F.col("stop") & (gap >= 2 * debounce_ms) & (gap < cycle) & (gap > 0), F.lit(False))
    parts = running(
        gaps.withColumn("cut", cut), [], order, bucket,
        {"part": Running("sum", F.col("cut").cast("bigint")), "__upto": Running("sum", F.lit(1).cast("bigint"))}, n, bucket_rows,
    )
    rows = materialize(parts.withColumn("__i", F.col("__upto") - 1).drop("__before", "__upto"), "slots")
    folded = ordered_fold(
        rows,
        "part",
        "__i",
        step,
        ["lo", "hi", "cut", "stop"],
        [
            T.StructField("__last", T.LongType()),
            T.StructField("__timers", T.LongType()),
            T.StructField("__first", T.LongType()),
            T.StructField("__second", T.LongType()),
            T.StructField("__tick_state", T.StringType()),
        ],
        None,
        longest_key(rows, ["part"]),
        segment_rows,
    )
    timer_runs = folded.filter("__timers > 0").select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1).cast("bigint"), F.col("__timers")),
                lambda k: F.col("__last") + k * (period_ms + debounce_ms),
            )
        ).alias("run_at"),
        F.lit("periodic").alias("trigger"),
    )
    end_runs = folded.select(F.explode(F.array_compact(F.array("__first", "__second"))).alias("run_at"), F.lit("session_end").alias("trigger"))
    return timer_runs.unionByName(end_runs).filter(F.col("run_at") <= end_ms)
