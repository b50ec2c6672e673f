"""Per-key time behaviour: streaks, connection counts, rate limits, replayed tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.operators.fold import SEGMENT_ROWS, ordered_fold
from chainlake.operators.scan import BUCKET_ROWS, Running, bucket_of, dense_ordinal, longest_key, running

ALERT_FAILURES = 3
STUCK_MS = 300_000


def failure_streaks(
    outcomes: DataFrame, now_ms: int | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Runs of consecutive failures per chain (chain_id, seq, ts_ms, ok, quorum_failure).

    A success ends a run. ``open`` marks the run still going on; ``alert`` a quorum
    failure at three or more; ``stuck`` an open run of 300 s or more at ``now_ms``.
    """
    bucket = bucket_of(F.col("seq"), bucket_rows)
    numbered = running(
        outcomes,
        ["chain_id"],
        ["seq"],
        bucket,
        {
            "__island": Running("sum", F.when(F.col("ok"), 1).otherwise(0)),
            "__run": Running("sum", F.when(F.col("ok"), 0).otherwise(1)),
        },
        bucket_rows=bucket_rows,
    )
    # Failures before an island's success are counted off to number failures within a run.
    islands = numbered.groupBy("chain_id", "__island").agg(
        F.count_if(~F.col("ok")).alias("failures"),
        F.min(F.when(~F.col("ok"), F.col("ts_ms"))).alias("first_failure_ms"),
        F.max(F.when(~F.col("ok"), F.col("ts_ms"))).alias("last_failure_ms"),
        F.max(F.when(~F.col("ok") & F.col("quorum_failure"), F.col("__run"))).alias("__last_quorum"),
        F.min(F.when(~F.col("ok"), F.col("__run"))).alias("__first_run"),
    )
    last = outcomes.groupBy("chain_id").agg(
        F.count_if("ok").alias("__last_island"), F.max("ts_ms").alias("__last_ms")
    )
    end = F.col("__last_ms") if now_ms is None else F.lit(now_ms)
    runs = islands.filter("failures > 0").join(last, "chain_id")
    is_open = F.col("__island") == F.col("__last_island")
    alert = F.col("__last_quorum") - F.col("__first_run") + 1 >= ALERT_FAILURES
    return runs.select(
        "chain_id",
        F.col("__island").alias("successes_before"),
        "failures",
        "first_failure_ms",
        "last_failure_ms",
        is_open.alias("open"),
        F.coalesce(alert, F.lit(False)).alias("alert"),
        (is_open & (end - F.col("first_failure_ms") >= STUCK_MS)).alias("stuck"),
    )


def connection_count(
    connections: DataFrame, window_ms: int = 60_000, order: str = "event_id"
) -> DataFrame:
    """Add ``connections``: how many the source IP opened in the trailing window, itself included.

    Connections (event_id, ts_ms, source_ip) count from ``t > ts - window``; of equal
    timestamps the ones earlier in ``order`` count. Each millisecond of an IP collapses
    to one row, which takes part in its own window-sized bucket and in the next one.
    """
    per_ms = connections.groupBy("source_ip", "ts_ms").agg(F.count("*").alias("__n"))
    bucket = F.floor(F.col("ts_ms") / window_ms)
    spread = per_ms.select(
        "source_ip", "ts_ms", "__n", F.explode(F.array(bucket, bucket + 1)).alias("__bucket")
    )
    trailing = (
        Window.partitionBy("source_ip", "__bucket").orderBy("ts_ms").rangeBetween(-(window_ms - 1), -1)
    )
    before = (
        spread.withColumn("__before", F.coalesce(F.sum("__n").over(trailing), F.lit(0)))
        .filter(F.col("__bucket") == F.floor(F.col("ts_ms") / window_ms))
        .select("source_ip", "ts_ms", "__before")
    )
    same = Window.partitionBy("source_ip", "ts_ms").orderBy(order)
    ranked = connections.withColumn("__rank", F.row_number().over(same))
    return ranked.join(before, ["source_ip", "ts_ms"]).select(
        *connections.columns, (F.col("__before") + F.col("__rank")).alias("connections")
    )


def behaviour_anomaly(connections: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Connections that are the only one of their IP in the trailing window."""
    return connection_count(connections, window_ms).filter("connections = 1").drop("connections")


def _by_arrival(
    df: DataFrame, key: str, order: str, bucket_rows: int
) -> tuple[DataFrame, int]:
    """Rows with a key, numbered per key in arrival order, and the size of the largest key."""
    keyed = df.filter(F.col(key).isNotNull())
    longest = longest_key(keyed, [key])
    bucket = bucket_of(F.col(order), bucket_rows)
    return dense_ordinal(keyed, [key], [order], bucket, "__i", longest, bucket_rows), longest


def bucket_step(state, now_ms: int, rate: float, burst: float):
    """Refill and take one token; state is (tokens, last_ms) or None for a full bucket."""
    tokens, last = state or (burst, now_ms)
    tokens = min(burst, tokens + (now_ms - last) / 1000.0 * rate)
    allowed = tokens >= 1.0
    return (tokens - 1.0 if allowed else tokens, now_ms), allowed


def token_bucket(
    requests: DataFrame,
    key: str,
    rate: float,
    burst: float,
    order: str = "event_id",
    bucket_rows: int = BUCKET_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add ``allowed`` for a token bucket per ``key``; requests are (event_id, ts_ms, key).

    Refill with a ceiling is no plain window, so it runs as an ordered fold. Requests
    without a key are always allowed.
    """

    def step(state, ts_ms):
        parsed = None
        if state is not None:
            tokens, last = state.split(" ")
            parsed = (float(tokens), int(last))
        (tokens, last), allowed = bucket_step(parsed, ts_ms, rate, burst)
        state = f"{tokens!r} {last}"
        return state, (allowed, state)

    rows, longest = _by_arrival(requests, key, order, bucket_rows)
    folded = ordered_fold(
        rows,
        key,
        "__i",
        step,
        ["ts_ms"],
        [T.StructField("allowed", T.BooleanType()), T.StructField("__bucket_state", T.StringType())],
        None,
        longest,
        segment_rows,
    ).drop("__i", "__bucket_state")
    keyless = requests.filter(F.col(key).isNull()).withColumn("allowed", F.lit(True))
    return folded.unionByName(keyless)


def replay_step(stored_exp, seen_at: int, exp: int):
    """Verdict for one token presentation and the expiry to remember."""
    if exp <= seen_at:
        return stored_exp, "expired"
    if stored_exp is not None and stored_exp > seen_at:
        return stored_exp, "replayed"
    return exp, "fresh"


def reject_replayed(
    tokens: DataFrame,
    order: str = "event_id",
    bucket_rows: int = BUCKET_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add ``verdict`` (fresh, replayed, expired) to token uses (event_id, jti, seen_at, exp).

    A token id stays taken until the expiry of its last fresh use; there is no cap on
    how many ids are remembered. Uses without an id have the verdict missing_jti.
    """

    def step(state, seen_at, exp):
        stored, verdict = replay_step(None if state is None else int(state), seen_at, exp)
        state = None if stored is None else str(stored)
        return state, (verdict, state)

    rows, longest = _by_arrival(tokens, "jti", order, bucket_rows)
    folded = ordered_fold(
        rows,
        "jti",
        "__i",
        step,
        ["seen_at", "exp"],
        [T.StructField("verdict", T.StringType()), T.StructField("__stored_exp", T.StringType())],
        None,
        longest,
        segment_rows,
    ).drop("__i", "__stored_exp")
    keyless = tokens.filter(F.col("jti").isNull()).withColumn("verdict", F.lit("missing_jti"))
    return folded.unionByName(keyless)
