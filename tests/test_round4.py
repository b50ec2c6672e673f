"""Queries that failed by time, disk or memory on tables of 6 GB."""

import json

import pytest
from pyspark.sql import functions as F

from chainlake.functions import canon
from chainlake.operators import chain, compare, events


def _payloads(spark, n=240):
    rows = [(i, 0, "long" if i % 3 else "other", 100 + i, 1, f'{{"a":{i}}}' if i % 50 else None) for i in range(n)]
    rows += [(i, 1, f"short{i % 30}", 100 + i, 1, f'{{"b":{i}}}') for i in range(n)] + [(7, 2, None, 1, 1, "{}")]
    return spark.createDataFrame(
        rows, "event_id long, position int, chain_id string, timestamp long, payload_type int, payload_json string"
    )


def test_rounds_of_long_chains_hand_on_heads_only(spark, monkeypatch):
    """Each round linked, wrote and read back whole entries, one after the other."""
    written = []
    write = chain.materialize
    monkeypatch.setattr(chain, "materialize", lambda df, name, *by: (written.append((name, set(df.columns))), write(df, name, *by))[1])
    payloads = _payloads(spark)
    first = payloads.filter("event_id < 100")
    sort = lambda built: sorted(map(tuple, built.collect()), key=repr)
    heads = chain.build_chains(first).groupBy("chain_id").agg(
        (F.max("index") + 1).alias("entry_count"), F.max_by("entry_hash", "index").alias("head")
    )
    later = payloads.filter("event_id >= 100")
    assert sort(chain.build_chains(payloads, bucket_rows=20, segment_rows=20)) == sort(chain.build_chains(payloads))
    assert sort(chain.build_chains(later, heads, bucket_rows=20, segment_rows=20)) == sort(chain.build_chains(later, heads))
    assert all("payload_json" not in columns for _, columns in written)


def test_payload_texts_are_made_once(spark, sf_dir):
    """A filter on the text was moved below it and made it, with its pass through Python, a second time."""
    from chainlake.plans import fixtures as fx

    payloads = events.access_payloads(fx.access_events(spark, sf_dir), fx.SALT)
    plan = chain.build_chains(payloads, longest=100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("canonicalize(") == 1


def test_comparison_parses_each_payload_once(spark, sf_dir):
    from chainlake.plans import fixtures as fx
    from chainlake.plans import observer

    proxy = fx.deployment_chain(spark, sf_dir)
    assert proxy.exceptAll(fx.chains(spark, sf_dir).filter("chain_id = '_deployment'")).isEmpty()
    out = compare.process2(proxy, observer.observer_chain(spark, sf_dir), fx.SALT, bucket_rows=50)
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert not out.first()["divergent"]


@pytest.mark.parametrize("text", [
    '{"b":1,"a":[true,false,{"é":"é"}]}', '{"a":null}', '{"a":"null"}', "[1.0, 1e21, -0, 0.5]", '"\\u00e9"', '{"a":1,"a":2}',
    "NaN", "[1,]", "", '{"\\ud83d\\ude00":1,"\\uffee":2}', "[100000000000000000000000000]", '{"Z":"/","a":"<b>","_":""}',
])
def test_short_way_to_canonical_text(text):
    def result(f):
        try:
            return f()
        except ValueError as exc:
            return type(exc), str(exc)

    assert result(lambda: canon.canonical_json(text, canon.simple_codec())) == result(lambda: canon.canonical_text(json.loads(text)))


class _Handle:
    """State of one key, as the store keeps it."""

    def __init__(self):
        self.value, self.updates = None, 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.updates = value, self.updates + 1


@pytest.mark.parametrize("held", [40, 100_000])
def test_actor_stream_holds_pieces_of_a_source(monkeypatch, held):
    """All rows of a source were one pandas frame, and so was what they gave."""
    import random

    import pandas as pd

    from chainlake.streaming import stateful

    monkeypatch.setattr(stateful, "HELD_ROWS", held)
    monkeypatch.setattr(stateful, "PIECE_ROWS", 10)
    order = list(range(1000))
    random.Random(1).shuffle(order)
    marker = {i: f"m{i}" for i in range(50, 1000, 90)}
    rows = [(i, "pg", "write", "r", None if i < 990 else "s", i, marker.get(i)) for i in order]
    names = ["seq", "source", "action", "resource", "scope", "timestamp", "marker_actor"]
    chunks = (pd.DataFrame(rows[i : i + 25], columns=names) for i in range(0, 1000, 25))
    handle, actors = _Handle(), stateful.LastActor()
    actors.init(handle)
    handle.value = ("early",)
    out = list(actors.handleInputRows(("pg",), chunks, None))
    want, actor = [], "early"
    for i in range(1000):
        actor = marker.get(i, actor)
        if i not in marker:
            want.append((i, actor))
    got = pd.concat(out, ignore_index=True)
    assert list(zip(got["seq"], got["actor"])) == want
    assert got["scope"][got["seq"] >= 990].tolist() == ["s"] * 10 and got["scope"][got["seq"] < 990].isna().all()
    assert handle.value == (marker[950],) and len(out) > 5 and max(map(len, out)) < 400


def test_truncation_shuffles_no_payloads(spark, sf_dir):
    """Each of its readings sent all entries with their payloads through a shuffle or two."""
    from chainlake.plans import fixtures as fx

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        rows = fx.tampered_chains(spark, sf_dir)
        kept = chain.truncate_to_valid(rows)
        text = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text
        verdicts = chain.verify_chains(kept, check_type=False)
        assert verdicts.filter("NOT ok").isEmpty()
        valid = chain.last_valid(rows).filter("valid_prefix > 0").select("chain_id", "valid_prefix")
        assert verdicts.select("chain_id", "entries").exceptAll(valid).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_batches_are_not_cached(spark, sf_dir, tmp_path, monkeypatch):
    """The events of a batch were cached, which spills them whole; what is stored instead goes at the end."""
    import glob

    from pyspark.sql.classic.dataframe import DataFrame

    from chainlake.plans import fixtures as fx
    from chainlake.session import shared_dir
    from chainlake.streaming import append

    def refuse(*_):
        raise AssertionError("a batch was cached")

    monkeypatch.setattr(DataFrame, "persist", refuse)
    rows = fx.access_events(spark, sf_dir).filter("event_id < 50")
    for _ in range(2):
        append.append_batch(rows.unionByName(rows), 0, str(tmp_path), fx.SALT)
    assert append.appended_entries(spark, str(tmp_path)).filter("chain_id = '_deployment'").count() == 50
    assert not glob.glob(f"{shared_dir(spark).removeprefix('file://')}/chainlake/*/fresh-*")
