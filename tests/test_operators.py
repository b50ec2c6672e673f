"""Operators against brute force, with keys cut into small buckets and segments."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chainlake.operators import chain, changes, fingerprint, identity, limits, ops, ranges, resolve, scan
from chainlake.operators.scan import Running, bucket_of, running


def numbers(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [
        (None if rng.random() < 0.1 else "hot" if rng.random() < 0.6 else rng.choice("abc"), i,
         rng.choice([None, rng.randint(0, 50)]))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "k STRING, seq BIGINT, v BIGINT")


@pytest.mark.parametrize("bucket_rows", [5, 37, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_matches_a_loop(spark, bucket_rows, inclusive):
    rows, df = numbers(spark)
    got = running(
        df,
        ["k"],
        ["seq"],
        bucket_of(F.col("seq"), bucket_rows),
        {kind: Running(kind, F.col("v"), inclusive) for kind in ("sum", "max", "last")},
        bucket_rows=bucket_rows,
    )
    state, want = {}, {}
    for k, seq, v in rows:
        s = state.get(k, (None, None, None))
        if not inclusive:
            want[seq] = s
        if v is not None:
            s = (v if s[0] is None else s[0] + v, v if s[1] is None else max(s[1], v), v)
            state[k] = s
        if inclusive:
            want[seq] = s
    assert {r["seq"]: (r["sum"], r["max"], r["last"]) for r in got.collect()} == want


def test_running_without_keys(spark):
    _, df = numbers(spark)
    got = running(df, [], ["seq"], bucket_of(F.col("seq"), 7), {"n": Running("sum", F.lit(1))}, bucket_rows=7)
    assert all(r["n"] == r["seq"] + 1 for r in got.collect())


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_merge_ranges_matches_a_loop(spark, bucket_rows):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), f := rng.randint(0, 300), f + rng.randint(0, 6), rng.randint(0, 9)) for _ in range(120)]
    df = spark.createDataFrame(rows, "chain_id STRING, from_index BIGINT, to_index BIGINT, at BIGINT")
    want = set()
    for chain in "xy":
        current = None
        for _, f, t, at in sorted(r for r in rows if r[0] == chain):
            if current and f <= current[1] + 1:
                current = [current[0], max(current[1], t), max(current[2], at)]
            else:
                if current:
                    want.add((chain, *current))
                current = [f, t, at]
        want.add((chain, *current))
    got = ranges.merge_ranges(df, bucket_rows=bucket_rows).select("chain_id", "from_index", "to_index", "at")
    assert {tuple(r) for r in got.collect()} == want


def test_adjacent_ranges_merge_and_gaps_do_not(spark):
    df = spark.createDataFrame(
        [("a", 0, 5, 1), ("a", 6, 10, 2), ("b", 0, 5, 1), ("b", 8, 10, 2)],
        "chain_id STRING, from_index BIGINT, to_index BIGINT, at BIGINT",
    )
    got = {tuple(r) for r in ranges.merge_ranges(df).select("chain_id", "from_index", "to_index", "at").collect()}
    assert got == {("a", 0, 10, 2), ("b", 0, 5, 1), ("b", 8, 10, 2)}


@pytest.mark.parametrize("segment_rows", [4, 1000])
def test_token_bucket_matches_a_loop(spark, segment_rows):
    rng = random.Random(3)
    t, rows = 0, []
    for i in range(150):
        t += rng.choice([0, 5, 40, 400])
        rows.append((i, t, rng.choice(["hot", "hot", "b", None])))
    df = spark.createDataFrame(rows, "event_id BIGINT, ts_ms BIGINT, ip STRING")
    state, want = {}, {}
    for i, ts, ip in rows:
        if ip is None:
            want[i] = True
            continue
        tokens, last = state.get(ip, (3.0, ts))
        tokens = min(3.0, tokens + (ts - last) / 1000.0 * 10.0)
        want[i] = tokens >= 1
        state[ip] = (tokens - 1 if tokens >= 1 else tokens, ts)
    got = limits.token_bucket(df, "ip", 10.0, 3.0, bucket_rows=segment_rows, segment_rows=segment_rows)
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == want
    assert set(want.values()) == {True, False}


def test_replayed_tokens(spark):
    rows = [(1, "j", 10, 20), (2, "j", 15, 20), (3, "j", 20, 40), (4, "k", 5, 5), (5, "j", 39, 50), (6, "k", 6, 9)]
    df = spark.createDataFrame(rows, "event_id BIGINT, jti STRING, seen_at BIGINT, exp BIGINT")
    for segment in (1, 100):
        got = limits.reject_replayed(df, bucket_rows=segment, segment_rows=segment).collect()
        assert {r["event_id"]: r["verdict"] for r in got} == {
            1: "fresh", 2: "replayed", 3: "fresh", 4: "expired", 5: "replayed", 6: "fresh"
        }


def test_marker_text(spark):
    head = "table public.audit_marker: INSERT: id[bigint]:1 actor_id[text]:"
    cases = {
        head + "'alice' at[timestamp]:'x'": "alice",
        head + "'alice''s admin' s[uuid]:'y'": "alice's admin",
        head + "'open": None,
        head + "'open''": None,
        head + "'a'''": "a'",
        "table public.users: INSERT: actor_id[text]:'alice'": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "data STRING")
    got = {r["data"]: r["a"] for r in df.select("data", changes.parse_marker(F.col("data")).alias("a")).collect()}
    assert got == cases


def test_identity_matrix(spark):
    config = identity.IdentityConfig(
        app_sources=("10.0.0.1/32",), app_credentials={"postgres": ("app",), "s3": ("KEY",)}
    )
    rows = [
        ("10.0.0.1", "app", "postgres", "app", "app"),
        ("10.0.0.1", "dba", "postgres", "suspicious", "app source 10.0.0.1 used non-app credential 'dba'"),
        ("10.0.0.2", "app", "postgres", "admin", "stolen:app"),
        ("10.0.0.2", "dba", "postgres", "admin", "dba"),
        ("10.0.0.2", "app", "mongodb", "admin", "app"),
        ("10.0.0.1", "KEY", "s3", "app", "KEY"),
        (None, None, "s3", "admin", "unknown"),
    ]
    df = spark.createDataFrame(rows, "source_ip STRING, credential STRING, protocol STRING, c STRING, w STRING")
    for r in identity.classify_identity(df, config).collect():
        assert (r["caller_class"], r["caller"]) == (r["c"], r["w"])


SHAPES = [
    ("SELECT name, email FROM users WHERE id = 42 AND status = 'active'",
     "select name, email from users where id = ? and status = ?"),
    ("SELECT * FROM t WHERE a=$1 AND b IS NULL AND c<>-1.5e3", "select * from t where a = $1 and b is null and c <> -?"),
    ("SELECT 'it''s', E'\\\\x', true FROM t1", "select ?, ?, ? from t1"),
    ("select 1 ;  select 2;", "select ?; select ?"),
    ("SELECT 'broken FROM t", "select 'broken from t"),
    ("SELECT a -- note 1\n FROM t /* x 2 */ WHERE b = 3", "select a from t where b = ?"),
]


def test_query_shapes(spark):
    df = spark.createDataFrame(SHAPES, "statement STRING, want STRING")
    for r in fingerprint.fingerprint_queries(df).collect():
        assert r["query_shape"] == r["want"]
        assert r["query_fingerprint"] == hashlib.sha256(r["want"].encode()).hexdigest()


def test_statement_analysis(spark):
    cases = {
        "INSERT INTO public.users (id, email) VALUES (1, 'a')": ("write", ["public.users"], ["id", "email"], [], None),
        "SELECT x.* FROM (SELECT 1) AS x, b": ("read", ["(subquery)", "b"], ["x.*"], [], None),
        "SELECT a FROM t UNION SELECT b FROM u": ("read", [], [], [], None),
        "CREATE TABLE t2 (id int, name varchar(10), PRIMARY KEY (id))":
            ("schema_change", ["t2"], ["id", "name"], [], None),
        "DROP TABLE IF EXISTS a, b CASCADE": ("schema_change", ["a", "b"], [], [], None),
        "UPDATE t SET a = 1, b = 'x,y' WHERE c IS NOT NULL AND d NOT IN ('p', 'q')":
            ("write", ["t"], ["a", "b"], [("c", "IS NOT NULL", None), ("d", "IN", "('p', 'q')")],
             "c IS NOT NULL AND d NOT IN ('p', 'q')"),
        "SELECT a FROM t WHERE b = c AND x = -5": ("read", ["t"], ["a"], [("b", "=", None), ("x", "=", "-5")], "b = c AND x = -5"),
        "EXPLAIN x": (None, [], [], [], None),
        'SELECT "a b", t."c" FROM "s"."t" WHERE "id" = 42': ("read", ["s.t"], ["a b", "c"], [("id", "=", "42")], '"id" = 42'),
        "WITH RECURSIVE a AS NOT MATERIALIZED (SELECT f(g(1)) FROM b UNION SELECT ')') SELECT x FROM users WHERE id = 42":
            ("read", ["users"], ["x"], [("id", "=", "42")], "id = 42"),
        "WITH a AS (SELECT 1) DELETE FROM users WHERE id = 1": ("read", [], [], [], None),
        "SELECT x FROM t WHERE id = 7 /* it's */ -- don't\n": ("read", ["t"], ["x"], [("id", "=", "7")], "id = 7"),
        "INSERT INTO t (a) VALUES ('open": (None, [], [], [], None),
        "SELECT a FROM t WHERE b = 'it''s -- \"x' AND c = '/*'":
            ("read", ["t"], ["a"], [("b", "=", "'it''s -- \"x'"), ("c", "=", "'/*'")], "b = 'it''s -- \"x' AND c = '/*'"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "statement STRING")
    for r in fingerprint.analyze_queries(df).collect():
        got = (r["action"], [t["name"] for t in r["tables"]], r["columns"],
               [(f["column"], f["operator"], f["value"]) for f in r["filters"]], r["raw_where"])
        assert got == cases[r["statement"]], r["statement"]


def test_object_users_and_excluded_prefix(spark):
    df = spark.createDataFrame(
        [("uploads", "users/7/a.jpg"), ("other", "users/7/a.jpg"), ("uploads", "system/users/7/x")], "bucket STRING, key STRING"
    )
    patterns = [("uploads", "users/(?P<user_id>[^/]+)/.*"), ("*", "(?P<user_id>[0-9]+)"), ("*", "(bad")]
    got = [r["affected_users"] for r in resolve.resolve_users_object(df, patterns, ["system/"]).collect()]
    assert got == [["7"], ["7"], []]


def test_assignments_match_a_loop(spark):
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest(), 2 + i % 7) for i in range(40)]
    want = {}
    for i, seed, n in rows:
        state, order = bytes.fromhex(seed), list(range(1, n))
        ttl = 3600 + int.from_bytes(state[24:], "big") % 10800
        for k in reversed(range(1, len(order))):
            j = int.from_bytes(state[:8], "big") % (k + 1)
            order[k], order[j] = order[j], order[k]
            state = hashlib.sha256(state).digest()
        want[i] = (order[0], ttl)
    df = spark.createDataFrame(rows, "session_id BIGINT, seed STRING, replica_count BIGINT").withColumns(
        {"verifier_ordinal": F.lit(1), "ttl_secs": F.lit(1)}
    )
    got = {r["session_id"]: (r["expected_ordinal"], r["expected_ttl"]) for r in ops.audit_assignments(df).collect()}
    assert got == want


def test_session_end_bursts_share_a_run(spark):
    ends = spark.createDataFrame([(100,), (101,), (160_050,), (200_000,)], "ended_at BIGINT")
    for segment_rows in (1, 100):
        got = ops.ticks(ends, 0, 1_000_000, period_ms=400_000, debounce_ms=60_000, segment_rows=segment_rows)
        assert sorted((r["run_at"], r["trigger"]) for r in got.collect()) == [
            (60_000, "session_end"), (160_050, "session_end"), (220_050, "session_end"), (680_050, "periodic"),
        ]


@pytest.mark.parametrize("kind", ["one day", "hashes"])
def test_buckets_by_rank_hold_bunched_and_sparse_orders(spark, kind):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        at = 5 if kind == "one day" else rng.getrandbits(62)
        rows.append(("a" if i % 3 else "b", at, f"{i:04}", rng.randrange(100)))
    df = spark.createDataFrame(rows, "k STRING, at BIGINT, id STRING, v BIGINT")
    for keys in ([], ["k"]):
        total, want = {}, {}
        for k, at, name, v in sorted(rows, key=lambda r: (r[1], r[2])):
            total[k if keys else 0] = want[name] = total.get(k if keys else 0, 0) + v
        got = scan.running(df, keys, ["at", "id"], None, {"s": scan.Running("sum", F.col("v"))}, bucket_rows=50)
        assert {r["id"]: r["s"] for r in got.collect()} == want
        sizes = [r["count"] for r in scan.by_rank(df, keys, ["at", "id"], 50).groupBy("__bucket").count().collect()]
        assert max(sizes) <= 50 and len(sizes) >= 12


def test_chains_of_hashed_offsets_are_built_in_few_buckets(spark):
    rng = random.Random(4)
    rows = [("c", rng.getrandbits(62), 0, i, 1, f'{{"i":"{i}"}}') for i in range(120)]
    df = spark.createDataFrame(
        rows, "chain_id STRING, event_id BIGINT, position INT, timestamp BIGINT, payload_type INT, payload_json STRING"
    )
    want = [r[5] for r in sorted(rows, key=lambda r: r[1])]
    built = chain.build_chains(df, bucket_rows=20).orderBy("index")
    assert [r["payload_json"] for r in built.collect()] == want


def serial_ticks(ends, start, end, period, debounce):
    out, last = [], start
    while True:
        after = [e for e in ends if e > last]
        due = last + period + debounce
        if after and min(after) < due:
            last, trigger = max(min(after), last + debounce), "session_end"
        else:
            last, trigger = due, "periodic"
        if last > end and not (after and min(after) <= end):
            return sorted(r for r in out if r[0] <= end)
        out.append((last, trigger))


@pytest.mark.parametrize("period, debounce, spread", [(400, 60, 90), (400, 60, 700), (100, 0, 50), (70, 60, 200), (900, 50, 45)])
def test_ticks_in_parts_equal_the_serial_scheduler(spark, period, debounce, spread):
    rng = random.Random(period + spread)
    at, ends = 0, []
    for _ in range(250):
        at += rng.choice([0, 1, rng.randrange(spread), rng.randrange(spread), 2 * debounce, period + debounce, debounce])
        ends.append(at)
    table = spark.createDataFrame([(e,) for e in ends], "ended_at BIGINT")
    want = serial_ticks(ends, 0, at + 1500, period, debounce)
    for segment_rows, bucket_rows in ((1000, 1000), (7, 3)):
        got = ops.ticks(table, 0, at + 1500, period, debounce, segment_rows, bucket_rows)
        assert sorted((r["run_at"], r["trigger"]) for r in got.collect()) == want


def test_settings_file(tmp_path):
    from chainlake.sources.config import settings_from

    s = settings_from(
        {"proxy": {
            "identity": {"mode": "source+credential", "app_sources": [{"ip": "10.0.0.1"}, {"hostname": "h"}],
                         "app_credentials": {"postgres": [{"username": "app"}], "s3": [{"access_key": "K"}]}},
            "schema": {"user_tables": [{"table": "users", "user_id_column": "id", "sensitive_columns": ["email"]}],
                       "user_collections": [{"collection": "m", "user_id_field": ["a", "b"]}],
                       "excluded_tables": ["t"]},
            "s3": {"user_data_patterns": [{"bucket": "u", "key_pattern": "x"}], "excluded_prefixes": ["logs/"]},
        }}
    )
    assert s.identity.mode == "source_credential" and s.identity.app_credentials == {"postgres": ("app",), "s3": ("K",)}
    assert s.user_tables == [("users", ["id"])] and s.user_collections == [("m", ["a", "b"])]
    assert s.sensitive_columns == {"users": ["email"]} and s.key_patterns == [("u", "x")]
