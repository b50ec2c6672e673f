"""Keyed stream operators with their state in the state store.

Rows of a key arrive grouped per micro-batch; each processor orders them by arrival
position first. Memory is bounded by the trigger's batch size, which the source limits
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chainlake.operators.limits import ALERT_FAILURES, STUCK_MS, bucket_step, replay_step

#: Rows of a key that are sorted in memory, and rows that are handed on together.
HELD_ROWS = 200_000
PIECE_ROWS = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """These operators need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ordered(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


class _Processor(StatefulProcessor):
    def close(self) -> None:
        pass


class TokenBucket(_Processor):
    """State: tokens and time of the last request; dropped after ``ttl_ms`` idle."""

    def __init__(self, rate: float, burst: float, ttl_ms: int):
        self.rate, self.burst, self.ttl_ms = rate, burst, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens DOUBLE, last_ms BIGINT", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:
            for pdf in rows:
                yield pd.DataFrame({"event_id": pdf["event_id"], "allowed": True})
            return
        pdf = _ordered(rows, "event_id")
        state = tuple(self.bucket.get()) if self.bucket.exists() else None
        allowed = []
        for ts in pdf["ts_ms"]:
            state, ok = bucket_step(state, int(ts), self.rate, self.burst)
            allowed.append(ok)
        self.bucket.update((float(state[0]), int(state[1])))
        yield pd.DataFrame({"event_id": pdf["event_id"], "allowed": allowed})


def stream_rate_limit(
    requests: DataFrame, key: str, rate: float, burst: float, ttl_ms: int = 300_000
) -> DataFrame:
    """(event_id, allowed) of a stream of requests (event_id, ts_ms, key)."""
    return (
        requests.select("event_id", "ts_ms", key)
        .groupBy(key)
        .transformWithStateInPandas(
            TokenBucket(rate, burst, ttl_ms),
            "event_id BIGINT, allowed BOOLEAN",
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )


class ReplayedTokens(_Processor):
    """State: expiry of the last fresh use. A live stream clears it when it passes."""

    def __init__(self, live: bool):
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.exp = handle.getValueState("exp", "exp BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:
            for pdf in rows:
                yield pd.DataFrame({"event_id": pdf["event_id"], "verdict": "missing_jti"})
            return
        pdf = _ordered(rows, "event_id")
        before = self.exp.get()[0] if self.exp.exists() else None
        stored, verdicts = before, []
        for seen_at, exp in zip(pdf["seen_at"], pdf["exp"]):
            stored, verdict = replay_step(stored, int(seen_at), int(exp))
            verdicts.append(verdict)
        if stored is not None and stored != before:
            self.exp.update((stored,))
            if self.live:
                self.handle.registerTimer(stored * 1000)
        yield pd.DataFrame({"event_id": pdf["event_id"], "verdict": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.exp.exists() and self.exp.get()[0] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.exp.clear()
        return iter([])


def stream_jti_dedup(tokens: DataFrame, live: bool = True) -> DataFrame:
    """(event_id, verdict) of a stream of token uses (event_id, jti, seen_at, exp)."""
    return (
        tokens.select("event_id", "jti", "seen_at", "exp")
        .groupBy("jti")
        .transformWithStateInPandas(
            ReplayedTokens(live),
            "event_id BIGINT, verdict STRING",
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )


class FailureStreak(_Processor):
    """State: failures in a row and when they began; a timer reports a stuck chain."""

    def __init__(self, live: bool):
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", "failures BIGINT, first_ms BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows, "seq")
        count, first = tuple(self.streak.get()) if self.streak.exists() else (0, 0)
        out = []
        for seq, ts, ok, quorum in zip(pdf["seq"], pdf["ts_ms"], pdf["ok"], pdf["quorum_failure"]):
            if ok:
                count, first = 0, 0
                continue
            first = first if count else int(ts)
            count += 1
            out.append((key[0], seq, count, first, bool(quorum and count >= ALERT_FAILURES), False))
        if count:
            self.streak.update((count, first))
            if self.live:
                self.handle.registerTimer(first + STUCK_MS)
        elif self.streak.exists():
            self.streak.clear()
        yield pd.DataFrame(out, columns=["chain_id", "seq", "failures", "first_failure_ms", "alert", "stuck"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.streak.exists():
            return
        count, first = self.streak.get()
        if first + STUCK_MS <= expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame(
                [(key[0], None, count, first, False, True)],
                columns=["chain_id", "seq", "failures", "first_failure_ms", "alert", "stuck"],
            )


def stream_failure_streaks(outcomes: DataFrame, live: bool = True) -> DataFrame:
    """One row per failed commit with its place in the run, and one when a chain is stuck."""
    return (
        outcomes.select("chain_id", "seq", "ts_ms", "ok", "quorum_failure")
        .groupBy("chain_id")
        .transformWithStateInPandas(
            FailureStreak(live),
            "chain_id STRING, seq BIGINT, failures BIGINT, first_failure_ms BIGINT, alert BOOLEAN, stuck BOOLEAN",
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )


class RecentConnections(_Processor):
    """State: connection times of the trailing window."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "ts_ms BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows, "event_id")
        recent = [t[0] for t in self.times.get()]
        counts = []
        for ts in pdf["ts_ms"]:
            recent = [t for t in recent if t > ts - self.window_ms] + [int(ts)]
            counts.append(len(recent))
        self.times.put([(t,) for t in recent])
        yield pd.DataFrame({"event_id": pdf["event_id"], "source_ip": key[0], "connections": counts})


def stream_behaviour(connections: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Trailing connection count per event; one is the anomaly."""
    return (
        connections.select("event_id", "ts_ms", "source_ip")
        .groupBy("source_ip")
        .transformWithStateInPandas(
            RecentConnections(window_ms),
            "event_id BIGINT, source_ip STRING, connections BIGINT",
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )


def _in_order(rows: Iterator[pd.DataFrame], order: str, held: int | None = None) -> Iterator[pd.DataFrame]:
    """The rows of a key sorted by ``order``, in pieces, holding about ``held`` rows at a time.

    More rows than that are sorted in runs that wait in files of the task, and the runs are merged piece by piece.
    """
    held = held or HELD_ROWS
    with tempfile.TemporaryDirectory() as folder:
        runs: list[str] = []
        waiting, size, schema = [], 0, None

        def settle() -> pa.Table:
            nonlocal waiting, size
            table = pa.concat_tables(waiting).sort_by(order)
            waiting, size = [], 0
            return table

        for pdf in rows:
            if not len(pdf):
                continue
            table = pa.Table.from_pandas(pdf, schema=schema, preserve_index=False)
            if schema is None:
                # A column may hold nulls only at first.
                schema = pa.schema([f.with_type(pa.string()) if pa.types.is_null(f.type) else f for f in table.schema]).remove_metadata()
                table = pa.Table.from_pandas(pdf, schema=schema, preserve_index=False)
            waiting.append(table)
            size += len(table)
            if size >= held:
                runs.append(os.path.join(folder, str(len(runs))))
                with pa.OSFile(runs[-1], "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
                    writer.write_table(settle(), max_chunksize=PIECE_ROWS)
        last = [settle()] if waiting else []
        if not runs:
            yield from (piece.to_pandas() for table in last for piece in _pieces(table))
            return
        yield from (table.to_pandas() for table in _merged([_read_run(r) for r in runs] + [iter(_pieces(t)) for t in last], order))


def _pieces(table: pa.Table) -> list[pa.Table]:
    return [table.slice(i, PIECE_ROWS) for i in range(0, len(table), PIECE_ROWS)]


def _read_run(path: str) -> Iterator[pa.Table]:
    with pa.OSFile(path) as source, pa.ipc.open_file(source) as reader:
        for i in range(reader.num_record_batches):
            yield pa.Table.from_batches([reader.get_batch(i)])


def _merged(runs: list[Iterator[pa.Table]], order: str) -> Iterator[pa.Table]:
    """Merge sorted runs: what is not above the least last value of the pieces at hand is complete."""
    heads = {i: piece for i, run in enumerate(runs) if (piece := next(run, None)) is not None}
    while heads:
        bound = min(piece.column(order)[-1].as_py() for piece in heads.values())
        ready = []
        for i, piece in list(heads.items()):
            n = pc.sum(pc.less_equal(piece.column(order), bound)).as_py() or 0
            ready.append(piece.slice(0, n))
            rest = piece.slice(n)
            if not len(rest):
                rest = next(runs[i], None)
            if rest is None:
                del heads[i]
            else:
                heads[i] = rest
        yield pa.concat_tables(ready).sort_by(order)


class LastActor(_Processor):
    """State: actor of the latest marker. A source may be all rows of a batch, so they are met piece by piece."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.actor = handle.getValueState("actor", "actor STRING")

    def handleInputRows(self, key, rows, timerValues):
        before = actor = self.actor.get()[0] if self.actor.exists() else None
        for pdf in _in_order(rows, "seq"):
            seen = [actor] + pdf["marker_actor"].where(pdf["marker_actor"].notna(), None).tolist()
            filled = pd.Series(seen, dtype="object").ffill()
            actor = filled.iloc[-1]
            pdf = pdf.assign(actor=filled.iloc[1:].values)
            pdf["actor"] = pdf["actor"].where(pdf["actor"].notna(), "observer:" + pdf["source"])
            plain = pdf[pdf["marker_actor"].isna()]
            yield plain[["seq", "source", "action", "resource", "scope", "timestamp", "actor"]]
        if actor is not None and actor != before:
            self.actor.update((actor,))


def stream_attribute_actor(changes: DataFrame, by: str | None = None) -> DataFrame:
    """Changes of a stream with the actor of the latest marker of their source (or ``by``)."""
    names = ["seq", "source", "action", "resource", "scope", "timestamp", "marker_actor"]
    slot = F.concat_ws("|", "source", *([by] if by else []))
    return (
        changes.select(*names, slot.alias("slot"))
        .groupBy("slot")
        .transformWithStateInPandas(
            LastActor(),
            "seq BIGINT, source STRING, action STRING, resource STRING, scope STRING, timestamp BIGINT, actor STRING",
            outputMode="Append",
            timeMode="None",
        )
    )
