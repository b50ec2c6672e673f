"""Cases that earlier versions got wrong."""

import json
import time

import pytest
from pyspark.sql import functions as F

from chainlake.operators import chain, compare, fingerprint, lifecycle, limits, ops, resolve
from chainlake.plans import fixtures as fx
from chainlake.sources import logs
from chainlake.sources.chain_log import read_chain_log
from chainlake.streaming import append


def payload_rows(spark, payloads):
    rows = [(i, 0, "c", 100 + i, 1, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(
        rows, "event_id long, position int, chain_id string, timestamp long, payload_type int, payload_json string"
    )


def test_truncated_chains_verify(spark, sf_dir):
    kept = chain.truncate_to_valid(fx.tampered_chains(spark, sf_dir)).cache()
    assert kept.groupBy("chain_id", "index").count().filter("count > 1").count() == 0
    assert chain.last_valid(kept).filter("needs_recovery").count() == 0
    assert chain.truncate_to_valid(kept).count() == kept.count()


def test_refused_payloads(spark):
    rows = payload_rows(spark, ['{"a":1}', None, '{"a":"' + "x" * 1_100_000 + '"}', '{"a":2}'])
    built = chain.build_chains(rows)
    assert [r["index"] for r in built.orderBy("index").collect()] == [0, 1]
    assert chain.verify_chains(built).first().ok
    reasons = {r.event_id: r.reason for r in chain.refused_payloads(rows).select("event_id", "reason").collect()}
    assert reasons == {1: "null_payload", 2: "payload_too_large"}


def test_log_with_object_payloads_in_stored_order(spark, tmp_path):
    members = {"resource": "users", "action": "read", "actor_id": "a", "scope": {"rows": 2, "bytes": 1}}
    text = json.dumps(members, sort_keys=True, separators=(",", ":"))
    folder = tmp_path / "chain1"
    folder.mkdir()
    lines = []
    for r in chain.build_chains(payload_rows(spark, [text, text])).orderBy("index").collect():
        line = {k: r[k] for k in ("version", "index", "timestamp", "prev_hash", "payload_type", "entry_hash")}
        lines.append(json.dumps(line | {"payload": members if r["index"] else text}))
    (folder / "log.jsonl").write_text("\n".join(lines))
    assert chain.verify_chains(read_chain_log(spark, str(tmp_path))).first().ok


@pytest.mark.parametrize(
    "key, pattern, expected",
    [
        ("users/u/f.jpg", r"users/(?<user_id>[^/]+)", "users/{user_id}/*"),
        ("users/s", r"users/(?<user_id>[^/]+)", "users/{user_id}"),
        ("x/users/x/1", r"users/(?<user_id>\w+)/", "x/users/{user_id}/*"),
        ("a/(1)/1/b", r"\((\d)\)/(?<user_id>\d)", "a/(1)/{user_id}/*"),
        ("top/users/9/z", r"(?:users/((?<user_id>\d+)))", "top/users/{user_id}/*"),
        ("users/s/f.jpg", r"^(?:users|members)/(?P<user_id>[^/]+)/.*$", "users/{user_id}/*"),
        ("members/m/f", r"(?:users/|(?:members/))(?<user_id>[^/]+)", "members/{user_id}/*"),
        ("aa/a/a-a/x", r"(a|b)/(?<user_id>\w+)-\2/x|never", "aa/a/{user_id}/*"),
        ("k/b/b/b", r"(?P<first>\w)/(?P<user_id>\w)/(?P=first)", "k/b/{user_id}/*"),
    ],
)
def test_object_shape_by_group_position(spark, key, pattern, expected):
    rows = spark.createDataFrame([("GET", "b", key)], "method string, bucket string, key string")
    assert resolve.fingerprint_requests(rows, [("*", pattern)]).first().normalized == f"GET /b/{expected}"


def test_uses_without_an_id_keep_a_verdict(spark):
    rows = spark.createDataFrame(
        [(1, None, 10, 20), (2, "a", 10, 20), (3, "a", 11, 20), (4, None, 12, 20)], "event_id long, jti string, seen_at long, exp long"
    )
    found = {r.event_id: r.verdict for r in limits.reject_replayed(rows).collect()}
    assert found == {1: "missing_jti", 2: "fresh", 3: "replayed", 4: "missing_jti"}


def test_one_replica_has_no_verifier(spark):
    rows = spark.createDataFrame(
        [(1, "ab" * 32, 1, 1, 60), (2, "ab" * 32, 3, 1, 60), (3, None, 3, 1, 60), (4, "no hex", 3, 1, 60), (5, "ab" * 32, None, 1, 60)],
        "session_id long, seed string, replica_count long, verifier_ordinal long, ttl_secs long",
    )
    found = {r.session_id: r.expected_ordinal for r in ops.audit_assignments(rows).collect()}
    assert found.pop(2) in (1, 2) and set(found.values()) == {None}


def test_only_a_missing_folder_is_an_empty_table(spark, tmp_path):
    assert append.current_heads(spark, str(tmp_path)).count() == 0
    (tmp_path / "manifest").mkdir()
    spark.range(3).select(F.col("id").cast("string").alias("version")).write.mode("overwrite").parquet(str(tmp_path / "manifest"))
    with pytest.raises(Exception):
        append.current_heads(spark, str(tmp_path)).collect()


def test_chain_started_again_after_its_erasure(spark):
    columns = "chain_id string, index long, timestamp long, payload_json string"
    stone = json.dumps({"category": "user_erasure_requested", "details": {"user_id_hash": "a", "requested_at": "50"}})
    other = stone.replace('"a"', '"b"')
    tombstones = spark.createDataFrame([("_deployment", 7, 50, stone), ("_deployment", 8, 50, other)], columns)
    entries = spark.createDataFrame([("a", 0, 60, "{}"), ("a", 1, 55, "{}"), ("b", 0, 10, "{}"), ("c", 0, 1, "{}")], columns)
    assert [r.chain_id for r in lifecycle.pending_deletes(entries, tombstones).collect()] == ["b"]
    kept = lifecycle.exclude_erased(entries, lifecycle.erasures(tombstones)).select("chain_id", "index").collect()
    assert sorted(map(tuple, kept)) == [("a", 0), ("a", 1), ("c", 0)]


def test_observed_members_in_any_order(spark, sf_dir):
    from chainlake.plans.observer import observer_chain

    proxy = fx.chains(spark, sf_dir).filter("chain_id = '_deployment'")
    seen = observer_chain(spark, sf_dir)
    turned = F.regexp_replace("payload_json", r'^\{("action":"[^"]*"),(.*)\}$', r"{$2, $1}")
    row = compare.process2(proxy, seen.withColumn("payload_json", turned), fx.SALT).first()
    assert not row.divergent and row.entries_verified == seen.count()
    broken = F.when(F.col("index") == 3, "{").otherwise(turned)
    row = compare.process2(proxy, seen.withColumn("payload_json", broken), fx.SALT).first()
    assert row.divergent and row.entries_verified == 3 and row.canon_error_side == "observer"


def test_predicates_that_are_not_listed_are_named(spark):
    rows = [(1, "t", "a = 1", []), (2, "t", "b = 1", []), (3, "t", None, []), (4, "t", "b = 1", ["7"])]
    df = spark.createDataFrame(rows, "event_id long, table_name string, raw_where string, affected_users array<string>")
    assert [r.event_id for r in resolve.unlisted_predicates(df, {"a = 1": "a = 1"}).orderBy("event_id").collect()] == [2, 3]
    assert resolve.unlisted_predicates(df, {}).count() == 3


_TAIL = " FROM users WHERE id = 7"
_LONG = 125_000


@pytest.mark.parametrize(
    "text, shape",
    [
        ("SELECT a /* " + "* a " * (2 * _LONG) + "*/" + _TAIL, "select a from users where id = ?"),
        ("SELECT a /* " + "/* x */ " * _LONG + "*/" + _TAIL, "select a from users where id = ?"),
        ("SELECT a, E'" + "\\'" * (4 * _LONG) + "'" + _TAIL, "select a, ? from users where id = ?"),
        ("SELECT a, $t$" + "$ $$ $u$ " * _LONG + "$t$" + _TAIL, "select a, ? from users where id = ?"),
        ("SELECT a" + " " * (8 * _LONG) + _TAIL + " ; " * _LONG, "select a from users where id = ?"),
        ("SELECT a /* " + "/* " * _LONG + _TAIL, None),
        ("SELECT a " + "$a$ $b$ " * _LONG + _TAIL + " $", None),
    ],
    ids=["stars", "nested", "escapes", "dollars", "blanks", "open comments", "open dollars"],
)
def test_long_statements_take_no_stack_and_little_time(spark, tmp_path, text, shape):
    # From a file, since a plan with the text in it is folded by an interpreter.
    spark.createDataFrame([(text,)], "statement string").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    start = time.time()
    row = fingerprint.analyze_queries(fingerprint.fingerprint_queries(log)).first()
    assert time.time() - start < 60
    assert row.query_shape == (text.lower() if shape is None else shape)
    assert [t.name for t in row.tables] == ([] if shape is None else ["users"])


@pytest.mark.parametrize(
    "text, shape, users",
    [
        (r"SELECT a FROM users WHERE n = E'it\'s' AND id = 7", "select a from users where n = ? and id = ?", ["7"]),
        ("SELECT a FROM users WHERE n = $$it's$$ AND id = 7", "select a from users where n = ? and id = ?", ["7"]),
        ("SELECT a FROM users WHERE n = $q$ $$ ' $q$ AND id = $1", "select a from users where n = ? and id = $1", None),
        ("SELECT /* a /* b */ c */ a FROM users WHERE id = 7", "select a from users where id = ?", ["7"]),
        ("SELECT a FROM users WHERE id = 7 /* open /* */", None, []),
        ("SELECT a FROM users WHERE n = 'C:\\' AND id = 7", "select a from users where n = ? and id = ?", ["7"]),
        ("SELECT f(a, g(b, c)), d FROM users WHERE id IN (7, 8)", "select f(a, g(b, c)), d from users where id in (?, ?)", ["7", "8"]),
    ],
)
def test_quotes_and_comments_of_every_kind(spark, text, shape, users):
    log = spark.createDataFrame([(text,)], "statement string")
    row = resolve.resolve_users_sql(
        fingerprint.analyze_queries(fingerprint.fingerprint_queries(log)), [("users", ["id"])]
    ).first()
    assert row.query_shape == (text.lower() if shape is None else shape)
    assert users is None or row.affected_users == users
    assert shape is not None or row.action is None


def test_attribution_classes_join_to_the_policy(spark):
    events = spark.createDataFrame(
        [(1, "t", "read", False, "k > 1", []), (2, "t", "read", True, "k > 1", []), (3, "t", "write", False, "k > 2", []),
         (4, "u", "read", False, "other", []), (5, "t", "read", False, "k > 1", ["7"])],
        "event_id long, table_name string, action string, is_aggregation boolean, raw_where string, affected_users array<string>",
    )
    snapshot = spark.createDataFrame([("t", 1, 1), ("t", 2, 2), ("t", 3, 3), ("t", 3, 3), ("u", 9, None)], "table_name string, user_id long, k int")
    predicates = {"k > 1": "k > 1", "k > 2": "k > 2"}
    pairs = lambda df: sorted((r.event_id, r.user_id) for r in df.collect())
    want = {
        "strict": [(1, 2), (1, 3), (2, 2), (2, 3), (3, 3)],
        "conservative": [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (4, 9)],
        "aggregation_aware": [(1, 1), (1, 2), (1, 3), (4, 9)],
    }
    for policy, rows in want.items():
        links, members = resolve.attribution_classes(events, snapshot, policy, predicates)
        keys = [c for c in links.columns if c != "event_id"]
        assert pairs(resolve.resolution_policy(events, snapshot, policy, predicates)) == rows
        assert pairs(links.join(members, keys)) == rows
        assert sum(r.events for r in members.collect()) == len(rows)


def test_log_sources_read_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"event_id": 1, "ts_ms": 5, "source_ip": "10.0.0.1", "credential": "c", "protocol": "postgres", "session_id": "s", "statement": "SELECT 1"}
    (tmp_path / "in" / "a.json").write_text(json.dumps(line) + "\nno json\n")
    rows = logs.read_query_log(spark, str(tmp_path / "in")).filter("statement IS NOT NULL").collect()
    assert [r.statement for r in rows] == ["SELECT 1"]
    assert logs.read_query_log(spark, str(tmp_path / "in"), stream=True).isStreaming
    assert logs.read_object_log(spark, str(tmp_path / "in")).columns == [f.name for f in logs.read_object_log(spark, str(tmp_path / "in"), stream=True).schema]


def test_access_stream_divides_good_and_bad_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"event_id": 7, "action": "read", "timestamp": 1_700_000_000_000}
    (tmp_path / "in" / "a.txt").write_text("\n".join([json.dumps(good), json.dumps({"event_id": 8}), "{broken", ""]))
    events, letters = logs.access_stream(spark, str(tmp_path / "in"))
    for name, df in (("events", events.select("event_id", "action")), ("letters", letters)):
        run = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
        run.trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "events")).collect()] == [(7, "read")]
    assert {r.raw for r in spark.read.parquet(str(tmp_path / "letters")).collect()} >= {json.dumps({"event_id": 8}), "{broken"}
