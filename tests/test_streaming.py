"""Streams over several micro-batches against the batch operators."""

import pytest
from pyspark.sql import functions as F

from chainlake.operators import limits
from chainlake.operators.chain import verify_chains
from chainlake.plans import fixtures as fx, operations
from chainlake.sources.chain_log import export_csv, export_json
from chainlake.streaming import append, stateful


@pytest.fixture(scope="module")
def split_events(spark, sf_dir, tmp_path_factory):
    """The events table as four files that arrive one after the other."""
    path = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for part in range(4):
        events.filter(F.floor(F.col("event_id") / 250) == part).coalesce(1).write.mode("append").parquet(path)
    return path, events.schema


def stream_of(spark, split_events):
    path, schema = split_events
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_rate_limit_over_batches(spark, sf_dir, split_events):
    stateful.use_state_store(spark)
    shaped = stream_of(spark, split_events).select(
        "event_id",
        F.floor(fx.event_ms() / 16).alias("ts_ms"),
        fx.caller_ip().alias("source_ip"),
    )
    out = append.run_to_table(stateful.stream_rate_limit(shaped, "source_ip", 0.00002, 2.0), "t-rate")
    want = limits.token_bucket(operations.connections(spark, sf_dir), "source_ip", 0.00002, 2.0)
    want = {r["event_id"]: r["allowed"] for r in want.collect()}
    assert {r["event_id"]: r["allowed"] for r in out.collect()} == want


def test_chain_append_over_batches_and_redelivery(spark, sf_dir, split_events, tmp_path):
    path, _ = split_events
    out = str(tmp_path / "chains")
    events = fx.access_events(spark, sf_dir).cache()
    for batch in range(3):
        low, high = batch * 400, batch * 400 + 450
        part = events.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
        append.append_batch(part, batch, out, fx.SALT)
        append.append_batch(part, batch, out, fx.SALT)
    got = append.appended_entries(spark, out)
    want = fx.chains(spark, sf_dir)
    assert verify_chains(got).filter("NOT ok").count() == 0
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_mixed_events_over_batches_and_redelivery(spark, sf_dir, tmp_path):
    from chainlake.plans.events import system_events

    access = fx.access_events(spark, sf_dir).filter("event_id < 300").withColumn("event_id", F.col("event_id") * 2)
    system = system_events(spark, sf_dir).filter("event_id < 200").withColumn("event_id", F.col("event_id") * 2 + 1)
    rows, out = append.mixed_events(access, system).cache(), str(tmp_path / "chains")
    for batch, (low, high) in enumerate([(0, 250), (200, 600), (500, 600)]):
        part = rows.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
        append.append_batch(part, batch, out, fx.SALT)
        append.append_batch(part, batch, out, fx.SALT)
    got = append.appended_entries(spark, out)
    assert verify_chains(got).filter("NOT ok").count() == 0
    assert got.filter("chain_id = '_deployment'").count() == rows.count()
    assert got.filter("chain_id = '_deployment' AND payload_json LIKE '%schema_change%scope\":{\"desc%'").count() == system.count()


def test_cursor_is_kept_when_a_tick_runs_again(spark, sf_dir, tmp_path):
    from chainlake.plans.observer import observer_chain

    proxy = fx.chains(spark, sf_dir).filter("chain_id = '_deployment'")
    obs = observer_chain(spark, sf_dir)
    path = str(tmp_path / "cursors")
    first = append.process2_tick(proxy, obs.filter("index < 50"), fx.SALT, path, 0).collect()
    again = append.process2_tick(proxy, obs.filter("index < 50"), fx.SALT, path, 0).collect()
    assert first == again and first[0]["entries_verified"] == 50
    assert append.cursor_state(spark, path, 1) == (first[0]["cursor_prx"], 50)


def test_exports_can_be_read_back(spark, sf_dir, tmp_path):
    entries = fx.chains(spark, sf_dir)
    export_json(entries, str(tmp_path / "json"))
    export_csv(entries.withColumn("payload_json", F.replace("payload_json", F.lit("users"), F.lit('a,\\"b'))), str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "json")).count() == entries.count()
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == entries.count()
    assert back.filter("resource = 'a,\"b'").count() > 0


def test_no_user_id_in_the_deployment_chain(spark, sf_dir):
    deployment = fx.chains(spark, sf_dir).filter("chain_id = '_deployment'")
    assert deployment.filter(F.col("payload_json").contains("affected_user_ids")).count() == 0
    assert deployment.filter(~F.col("payload_json").contains('"scope":{}')).count() == 0
