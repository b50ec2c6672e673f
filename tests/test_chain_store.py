"""The store of runs: replays, crashes between the steps, compaction, erasure and retention."""

import pytest
from pyspark.sql import functions as F

from chainlake.operators.chain import build_chains, verify_chains
from chainlake.sources import chain_store as store
from chainlake.streaming import append

PAYLOAD = "event_id long, position int, chain_id string, timestamp long, payload_type int, payload_json string"
REQUEST = "request_id long, chain_id string, requested_at long, source_ip string, session_id string"


def payloads(spark, first, count, chains=("u1", "u2", "u3"), at=1_000):
    rows = []
    for i in range(first, first + count):
        rows.append((i, 0, "_deployment", at + i, 2, '{"e":%d}' % i))
        rows.append((i, 1, chains[i % len(chains)], at + i, 1, '{"u":%d}' % i))
    return spark.createDataFrame(rows, PAYLOAD)


def contents(spark, path):
    return sorted(map(tuple, store.entries(spark, path).select("chain_id", "index", "entry_hash").collect()))


def all_valid(spark, path):
    assert verify_chains(store.entries(spark, path)).filter("NOT ok").count() == 0
    top = store.entries(spark, path).groupBy("chain_id").agg(
        F.count("*").alias("entry_count"), F.max_by("entry_hash", "index").alias("head")
    )
    assert store.heads(spark, path).select("chain_id", "entry_count", "head").exceptAll(top).count() == 0
    return {r["chain_id"]: r["entry_count"] for r in top.collect()}


def test_runs_equal_one_build(spark, tmp_path):
    path = str(tmp_path)
    for batch in range(3):
        part = payloads(spark, batch * 10, 10)
        assert store.append(part, path, batch=batch) > 0
        assert store.append(part, path, batch=batch) == -1
    want = build_chains(payloads(spark, 0, 30)).select("chain_id", "index", "entry_hash").collect()
    assert contents(spark, path) == sorted(map(tuple, want))
    assert store.entries(spark, str(tmp_path / "none")).count() == 0


def test_a_broken_run_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    store.append(payloads(spark, 0, 9), path)
    before = contents(spark, path)
    for step in ("_write_heads", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(store, step, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                store.append(payloads(spark, 9, 9, chains=("u7",)), path)
            with pytest.raises(OSError):
                store._rewrite(spark, path, store._new_run(store.state(spark, path)), list(store.state(spark, path).live))
        assert contents(spark, path) == before
    store.append(payloads(spark, 9, 3), path)
    assert all_valid(spark, path) == {"_deployment": 12, "u1": 4, "u2": 4, "u3": 4}
    assert len(store.vacuum(spark, path)) > 0
    assert all_valid(spark, path) == {"_deployment": 12, "u1": 4, "u2": 4, "u3": 4}


def test_compaction_keeps_entries_and_bounds_runs(spark, tmp_path):
    path = str(tmp_path)
    for batch in range(4):
        store.append(payloads(spark, batch * 3, 3), path)
    before = contents(spark, path)
    assert store.compact(spark, path, runs=3) and store.compact(spark, path, runs=3) == []
    assert contents(spark, path) == before
    assert all(len(runs) == 1 for runs in store.state(spark, path).live.values())
    store.vacuum(spark, path)
    assert contents(spark, path) == before and all_valid(spark, path)


def test_erasure_that_stops_between_its_phases(spark, tmp_path):
    path = str(tmp_path)
    store.append(payloads(spark, 0, 9), path)
    ask = [(1, "u1", 5_000, "10.0.0.1", None), (2, "u1", 5_001, None, None), (3, "nobody", 5_000, None, None),
           (4, "_deployment", 5_000, None, None), (5, None, 5_000, None, None)]
    out = {r["request_id"]: r for r in store.erase(spark.createDataFrame(ask, REQUEST), path, finish=False).collect()}
    assert {k: v["status"] for k, v in out.items()} == {1: 200, 2: 404, 3: 404, 4: 404, 5: 404}
    assert out[1]["tombstone_index"] == 9 and not out[1]["deleted"] and out[2]["tombstone_hash"] is None
    assert all_valid(spark, path)["u1"] == 3
    assert [kind for kind, _ in store.recover(spark, path)] == ["erase"]
    assert store.recover(spark, path) == []
    assert all_valid(spark, path) == {"_deployment": 10, "u2": 3, "u3": 3}
    store.vacuum(spark, path)
    assert spark.read.parquet(f"{path}/entries").filter("chain_id = 'u1'").count() == 0
    # The user comes back: the chain starts again at index 0.
    store.append(payloads(spark, 20, 3), path)
    assert all_valid(spark, path) == {"_deployment": 13, "u1": 1, "u2": 4, "u3": 4}


def test_erasure_of_nothing(spark, tmp_path):
    path = str(tmp_path)
    store.append(payloads(spark, 0, 3), path)
    assert store.erase(spark.createDataFrame([], REQUEST), path).count() == 0
    none = store.erase(spark.createDataFrame([(1, "nobody", 5, None, None)], REQUEST), path).collect()
    assert [(r["status"], r["deleted"]) for r in none] == [(404, False)]
    assert all_valid(spark, path)["_deployment"] == 3


def test_sweep_that_stops_between_its_phases(spark, tmp_path):
    path = str(tmp_path)
    store.append(payloads(spark, 0, 2, chains=("old", "older")), path)
    store.append(payloads(spark, 2, 2, chains=("new",), at=900_000), path)
    assert store.sweep(spark, path, 900_000, days=1, finish=False) == 2
    assert all_valid(spark, path) == {"_deployment": 4, "new": 2}
    # A stream's next batch completes the sweep before it appends.
    assert store.compact(spark, path) == []
    assert all_valid(spark, path) == {"_deployment": 6, "new": 2}
    assert store.sweep(spark, path, 900_000, days=1) == 0


def test_batch_reads_heads_of_its_buckets_only(spark, tmp_path):
    path = str(tmp_path)
    store.append(payloads(spark, 0, 40, chains=tuple(f"u{i}" for i in range(40))), path)
    buckets = store.touched_buckets(payloads(spark, 0, 1))
    plan = store.heads(spark, path, buckets)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert len(buckets) == 2 and "bucket" in filters and all(str(b) in filters for b in buckets)


def test_compared_streams_in_any_pace(spark, sf_dir, tmp_path):
    """Sides that are apart by many entries, a divergence, and a tick that runs again."""
    from chainlake.operators.compare import process2
    from chainlake.plans import fixtures as fx, observer

    proxy = fx.chains(spark, sf_dir).filter("chain_id = '_deployment'")
    obs = observer.observer_chain(spark, sf_dir).select(*proxy.columns)
    tag = lambda df, side: df.withColumn("side", F.lit(side))
    n = obs.count()
    parts = [
        tag(obs.filter(F.col("index") < 50), "observer"),
        tag(proxy, "proxy").unionByName(tag(obs.filter(F.col("index").between(50, 59)), "observer")),
        tag(obs.filter(F.col("index") >= 60), "observer"),
    ]
    path = str(tmp_path / "even")
    for tick, part in enumerate(parts):
        append.compare_batch(part, tick, fx.SALT, path)
        append.compare_batch(part, tick, fx.SALT, path)
    rows = append.compare_ticks(spark, path).orderBy("tick_id").collect()
    assert [r["entries_verified"] for r in rows] == [0, 60, n - 60]
    assert rows[-1]["cursor_obs"] == n and rows[-1]["tail_depth"] == 0 and rows[-1]["tail_from"] == 3
    bad = obs.withColumn("payload_json", F.when(F.col("index") == 7, '{"x":1}').otherwise(F.col("payload_json")))
    path = str(tmp_path / "bad")
    append.compare_batch(tag(bad.filter("index < 5"), "observer").unionByName(tag(proxy, "proxy")), 0, fx.SALT, path)
    append.compare_batch(tag(bad.filter("index >= 5"), "observer"), 1, fx.SALT, path)
    got = append.compare_ticks(spark, path).filter("tick_id = 1").first()
    want = process2(proxy, bad, fx.SALT).first()
    assert got["divergent"] and (got["cursor_prx"], got["cursor_obs"]) == (want["cursor_prx"], 7)
