"""Chains: building in pieces, and the tamper cases."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainlake.functions.crypto import row_entry_hash
from chainlake.operators import chain, linking, read
from chainlake.schemas import CHAIN_ENTRY, ZERO_HASH


def payload_rows(spark, sizes):
    rows = [
        (c, i * 10 + n, 0, 1_700_000_000 + i, 1, f'{{"i":"{i}","é":"{c}"}}')
        for n, (c, size) in enumerate(sizes.items())
        for i in range(size)
    ]
    return spark.createDataFrame(
        rows, "chain_id STRING, event_id BIGINT, position INT, timestamp BIGINT, payload_type INT, payload_json STRING"
    )


def by_hand(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["event_id"], r["position"])):
        c = out.setdefault(r["chain_id"], [])
        prev = c[-1][2] if c else ZERO_HASH
        p = r["payload_json"].encode()
        e = (
            b"\x01" + len(c).to_bytes(8, "big") + r["timestamp"].to_bytes(8, "big", signed=True) + bytes.fromhex(prev)
            + bytes([r["payload_type"]]) + len(p).to_bytes(4, "big") + p
        )
        c.append((len(c), prev, hashlib.sha256(e).hexdigest()))
    return out


SIZES = {"a": 57, "b": 3, "c": 1, "d": 20}


@pytest.fixture(scope="module")
def built(spark):
    return chain.build_chains(payload_rows(spark, SIZES)).cache()


@pytest.mark.parametrize("bucket_rows,segment_rows", [(1000, 1000), (7, 1000), (1000, 5), (4, 3)])
def test_build_matches_a_loop(spark, bucket_rows, segment_rows):
    rows = payload_rows(spark, SIZES)
    want = by_hand(rows.collect())
    got = {}
    for r in chain.build_chains(rows, bucket_rows=bucket_rows, segment_rows=segment_rows).collect():
        got.setdefault(r["chain_id"], []).append((r["index"], r["prev_hash"], r["entry_hash"]))
    assert {c: sorted(v) for c, v in got.items()} == want


@pytest.mark.parametrize("segment_rows", [1000, 4])
def test_build_in_two_batches_equals_one(spark, built, segment_rows):
    rows = payload_rows(spark, SIZES)
    first = chain.build_chains(rows.filter("event_id < 100")).cache()
    second = chain.build_chains(
        rows.filter("event_id >= 100"), read.chain_heads(first), bucket_rows=5, segment_rows=segment_rows
    )
    both = first.unionByName(second)
    assert both.exceptAll(built).count() == 0 and built.exceptAll(both).count() == 0


def test_empty_input_builds_nothing(spark):
    assert chain.build_chains(payload_rows(spark, {"a": 1}).filter("false")).count() == 0


def verdict(df, **kwargs):
    rows = {r["chain_id"]: r for r in chain.verify_chains(df, **kwargs).collect()}
    return {c: (r["error"], r["valid_prefix"]) for c, r in rows.items()}


def edit(df, cond, **columns):
    for name, value in columns.items():
        df = df.withColumn(name, F.when(F.expr(cond), F.lit(value)).otherwise(F.col(name)))
    return df


TAMPER = [
    ("chain_id = 'a' AND index = 2", {"prev_hash": "ff" * 32}, ("broken_chain", 2)),
    ("chain_id = 'a' AND index = 0", {"prev_hash": "ff" * 32}, ("invalid_first", 0)),
    ("chain_id = 'a' AND index = 1", {"entry_hash": "aa" * 32}, ("tampered_entry", 1)),
    ("chain_id = 'a' AND index = 1", {"payload_json": '{"i":"x"}'}, ("tampered_entry", 1)),
    ("chain_id = 'a' AND index = 1", {"timestamp": 5}, ("tampered_entry", 1)),
    ("chain_id = 'a' AND index = 1", {"payload_type": 9}, ("payload_type", 1)),
    ("chain_id = 'a' AND index = 1", {"index": 99}, ("index", 1)),
    ("chain_id = 'a' AND index = 1", {"version": 2}, ("version", 1)),
    ("chain_id = 'a' AND index = 1", {"entry_hash": None}, ("tampered_entry", 1)),
]


@pytest.mark.parametrize("cond,columns,want", TAMPER)
def test_tampering_is_found_at_its_entry(spark, built, cond, columns, want):
    got = verdict(edit(built, cond, **columns))
    assert got.pop("a") == want
    assert all(error is None for error, _ in got.values())


def test_untouched_and_empty(spark, built):
    assert verdict(built) == {c: (None, n) for c, n in SIZES.items()}
    assert verdict(built.filter("false")) == {}


def test_repeated_missing_and_late_start(spark, built):
    twice = built.unionByName(built.filter("chain_id = 'a' AND index = 4"))
    assert verdict(twice)["a"] == ("index", 5)
    assert verdict(built.filter("NOT (chain_id = 'a' AND index = 4)"))["a"] == ("index", 4)
    assert verdict(built.filter("NOT (chain_id = 'a' AND index = 0)"))["a"] == ("index", 0)


def test_rewritten_history_is_found(spark, built):
    """Entries re-linked after an edit verify on their own; the expected head does not match."""
    rows = payload_rows(spark, SIZES)
    forged = chain.build_chains(edit(rows, "chain_id = 'd' AND event_id < 30", payload_json=F.lit("{}")))
    heads = read.chain_heads(built).select("chain_id", F.col("head").alias("expected_head"))
    assert verdict(forged)["d"] == (None, 20)
    assert verdict(forged, expected_heads=heads)["d"] == ("head_mismatch", 20)
    assert verdict(forged, expected_heads=heads)["a"] == (None, 57)


def test_expected_heads_of_empty_and_malformed(spark, built):
    heads = spark.createDataFrame(
        [("z", ZERO_HASH), ("y", "ab" * 32), ("c", "nonsense")], "chain_id STRING, expected_head STRING"
    )
    got = verdict(built, expected_heads=heads)
    assert got["z"] == (None, 0) and got["y"] == ("head_mismatch", 0) and got["c"] == ("head_mismatch", 1)


def test_observed_type_by_profile(spark):
    rows = payload_rows(spark, {"o": 2}).withColumn("payload_type", F.lit(3))
    built = chain.build_chains(rows).cache()
    assert verdict(built)["o"] == (None, 2)
    assert verdict(built, profile="two_types")["o"] == ("payload_type", 0)


def test_oversize_payload_fails(spark):
    large = F.repeat(F.lit("x"), 1_048_577)
    rows = payload_rows(spark, {"o": 1})
    assert chain.build_chains(rows.withColumn("payload_json", large)).count() == 0
    # An entry that was stored all the same fails, though its hash is right.
    stored = chain.build_chains(rows).withColumn("payload_json", large)
    assert verdict(stored.withColumn("entry_hash", row_entry_hash()))["o"] == ("tampered_entry", 0)


def test_last_valid_prefix(spark, built):
    bad = edit(built, "chain_id = 'd' AND index = 5", payload_json=F.lit("{}"))
    kept = chain.truncate_to_valid(bad)
    assert {r[0]: r[1] for r in kept.groupBy("chain_id").count().collect()} == {**SIZES, "d": 5}


def test_incremental_needs_the_right_head(spark, built):
    trusted = read.chain_heads(built.filter("index < 10"))
    new = built.filter("index >= 10")
    assert verdict(new, trusted=trusted)["a"] == (None, 47)
    wrong = trusted.withColumn("head", F.lit("ab" * 32))
    assert verdict(new, trusted=wrong)["a"] == ("broken_chain", 0)
    assert verdict(new.filter("index > 10"), trusted=trusted)["a"] == ("index", 0)


def test_page_limits(spark, built):
    for limit in (0, 501):
        with pytest.raises(ValueError):
            read.page(built, "a", 0, limit)
    last = read.page(built, "a", 50, 100).collect()
    assert len(last) == 7 and last[0]["next_cursor"] is None and last[0]["total"] == 57


def test_schema_of_entries(built):
    assert built.schema.simpleString() == f"struct<{CHAIN_ENTRY.replace(' STRING', ':string').replace(' INT', ':int').replace(' BIGINT', ':bigint').replace(', ', ',')}>"


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_linking_does_not_depend_on_batches(size):
    rng = random.Random(size)
    rows = [
        {"chain_id": c, "event_id": i, "position": 0, "timestamp": rng.randrange(-5, 2**40), "payload_type": rng.randrange(1, 256),
         "payload_json": "é" * rng.randrange(4) + str(i)}
        for c in (None, "a", "b", "c") for i in range(rng.randrange(1, 25))
    ]
    want = by_hand(rows)
    # The entries of b from the fourth on follow a stored head; c has a head but no state.
    seeded = []
    for r in rows:
        i = r["event_id"]
        if r["chain_id"] == "b" and i < 3:
            if i == min(2, len(want["b"]) - 1):
                seeded.append({"chain_id": "b", "__seed": True, "__state": f"{i + 1}|{want['b'][i][2]}"})
            continue
        if r["chain_id"] == "c" and i == 0:
            seeded.append({"chain_id": "c", "__seed": True, "__state": None})
        seeded.append({**r, "__seed": False, "__state": None})
    schema = pa.schema(
        [("chain_id", pa.string()), ("event_id", pa.int64()), ("position", pa.int32()), ("timestamp", pa.int64()), ("payload_type", pa.int32()),
         ("payload_json", pa.string()), ("__state", pa.string()), ("__seed", pa.bool_())]
    )
    table = pa.Table.from_pylist(seeded, schema)
    got = {}
    for batch in linking.link_batches(iter(table.to_batches(size))):
        for r in batch.to_pylist():
            got.setdefault(r["chain_id"], []).append((r["index"], r["prev_hash"], r["entry_hash"]))
    assert got == {c: w for c, w in ((c, w[3:] if c == "b" else w) for c, w in want.items()) if w}
    for column in ("timestamp", "payload_type", "payload_json"):
        with pytest.raises(ValueError, match=column):
            list(linking.link_batches(iter(pa.Table.from_pylist([{**seeded[0], column: None}], schema).to_batches())))
