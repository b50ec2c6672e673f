"""Queries that took too long, or answered otherwise than their SQL, on larger tables."""

import pytest
from pyspark.sql import functions as F

from chainlake.operators import fingerprint, resolve


def test_statement_filters_do_not_repeat_the_analysis(spark):
    statements = [
        "SELECT email FROM users WHERE id = 1", "SELECT name FROM users", "SELECT * FROM payments",
        "SELECT a FROM payments, other", "SHOW timezone", "SELECT 'open FROM users",
    ]
    # Not local rows, which the optimizer would analyse itself.
    statement = F.get(F.array(*[F.lit(t) for t in statements]), F.col("id").cast("int"))
    log = spark.range(len(statements)).select(F.col("id").alias("event_id"), statement.alias("statement"))
    parsed = fingerprint.analyze_queries(log)
    kept = resolve.excluded_tables(parsed, ["payments"])
    hits = resolve.sensitive_access(parsed, {"users": ["email"], "payments": ["card"]})
    assert sorted(r.event_id for r in kept.collect()) == [0, 1, 3, 4, 5]
    assert sorted(r.event_id for r in hits.collect()) == [0, 2]
    assert kept.columns == hits.columns == parsed.columns
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(")
    for df in (kept, hits):
        assert count(df.select("event_id")) <= count(parsed)


@pytest.mark.parametrize("policy", ["conservative", "aggregation_aware", "strict"])
def test_attributions_are_counted_without_a_row_for_each(spark, policy):
    """A million statements and a million users of two tables: 10^11 pairs and more."""
    n = 1_000_000
    name = F.when(F.col("id") % 2 == 0, "t").otherwise("u")
    events = spark.range(n).select(
        F.col("id").alias("event_id"), name.alias("table_name"), F.lit("read").alias("action"),
        (F.col("id") % 4 == 0).alias("is_aggregation"), F.lit("k > 0").alias("raw_where"),
        F.array().cast("array<string>").alias("affected_users"),
    )
    snapshot = spark.range(n).select(name.alias("table_name"), F.col("id").alias("user_id"), (F.col("id") % 2).alias("k"))
    rows = {tuple(r) for r in resolve.attribution_counts(events, snapshot, policy, {"k > 0": "k > 0"}).collect()}
    half = n // 2
    want = {
        "conservative": {("t", half * half, half), ("u", half * half, half)},
        "aggregation_aware": {("t", half * half // 2, half // 2), ("u", half * half, half)},
        "strict": {("u", half * half, half)},
    }
    assert rows == want[policy]


@pytest.mark.parametrize("policy", ["conservative", "aggregation_aware", "strict"])
def test_attribution_counts_are_those_of_the_rows(spark, policy):
    rows = [(i, "tuv"[i % 3], ["read", "write"][i % 2], i % 4 == 0, f"k > {i % 2}", ["7"] if i % 5 == 0 else []) for i in range(60)]
    events = spark.createDataFrame(
        rows, "event_id long, table_name string, action string, is_aggregation boolean, raw_where string, affected_users array<string>"
    )
    members = [("t", i % 9, i % 3) for i in range(12)] + [("u", 1, 0), ("u", 2, 2)]
    snapshot = spark.createDataFrame(members, "table_name string, user_id long, k int")
    predicates = {"k > 0": "k > 0", "k > 1": "k > 1"}
    pairs = resolve.resolution_policy(events, snapshot, policy, predicates).join(events, "event_id")
    want = pairs.groupBy("table_name").agg(F.count("*"), F.countDistinct("event_id"))
    got = resolve.attribution_counts(events, snapshot, policy, predicates)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["merge_ranges", "merge_ranges_large_keys"])
def test_sql_of_merged_ranges_leaves_no_ties(spark, tmp_path, name):
    """Repeated intervals: the windows of the SQL had no total order and cut islands at chance."""
    import duckdb

    from chainlake.plans import load

    con = duckdb.connect()
    con.execute(
        "CREATE TABLE lineitem AS SELECT i // 2 % 400 + 5000 * (i % 3) AS l_orderkey, i % 7 AS l_suppkey,"
        " CAST(i % 4 + 1 AS INTEGER) AS l_linenumber FROM range(9000) r(i)"
    )
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    queries, sqls = load()
    steps = sqls[name].rsplit("SELECT", 1)[0]
    assert con.execute(f"{steps} SELECT chain_id, f, t FROM r GROUP BY ALL HAVING count(*) > 1").fetchall() == []
    want = {}
    for chain, f, t, at in con.execute(
        "SELECT CAST(l_suppkey AS VARCHAR), l_orderkey * 7 % 5000, l_orderkey * 7 % 5000 + l_linenumber, l_orderkey FROM lineitem ORDER BY 2"
    ).fetchall():
        islands = want.setdefault(chain, [])
        if islands and f <= islands[-1][1] + 1:
            islands[-1][1:] = max(islands[-1][1], t), max(islands[-1][2], at)
        else:
            islands.append([f, t, at])
    want = sorted((chain, *i) for chain, islands in want.items() for i in islands)
    assert sorted(con.execute(sqls[name]).fetchall()) == want
    got = queries[name](spark, str(tmp_path)).select("chain_id", "from_index", "to_index", "stamp")
    assert sorted(map(tuple, got.collect())) == want


def test_category_counts_link_no_chain(spark, sf_dir, monkeypatch):
    """Counts of payloads had the whole deployment chain hashed, entry after entry."""
    from chainlake.plans import chains as plans
    from chainlake.plans import fixtures as fx

    def refuse(*_):
        raise AssertionError("chains were built")

    monkeypatch.setattr(fx, "chains", refuse)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert sum(plans.category_counts_wide(spark, sf_dir).first()) == events
    assert sum(r.n for r in plans.category_counts(spark, sf_dir).collect()) == events


def test_only_long_chains_are_linked_in_rounds(spark, monkeypatch):
    """Short chains took part in every round; a long chain goes on after a stretch without entries."""
    from chainlake.operators import chain

    rows = [(i, 0, "long" if i < 40 or i >= 80 else "later", 100 + i, 1, f'{{"a":{i}}}') for i in range(140)]
    rows += [(i, 1, f"short{i % 30}", 100 + i, 1, f'{{"b":{i}}}') for i in range(140)]
    df = spark.createDataFrame(
        rows, "event_id long, position int, chain_id string, timestamp long, payload_type int, payload_json string"
    )
    stored = []
    write = chain.materialize

    def materialize(df, name, *partition_by):
        out = write(df, name, *partition_by)
        if name == "fold-in":
            stored.append({r.chain_id for r in out.select("chain_id").distinct().collect()})
        return out

    monkeypatch.setattr(chain, "materialize", materialize)
    sort = lambda built: sorted(tuple(r) for r in built.collect())
    cut = sort(chain.build_chains(df, bucket_rows=20, segment_rows=20))
    assert cut == sort(chain.build_chains(df))
    assert stored == [{"long", "later"}]


def test_damaging_chains_spreads_a_long_one(spark, sf_dir, monkeypatch):
    """A join by chain alone put all entries of the longest chain into one task."""
    from chainlake.plans import fixtures as fx

    fx.chains(spark, sf_dir)
    monkeypatch.setattr(fx, "STRETCH", 50, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = fx.tampered_chains(spark, sf_dir).filter("chain_id = '_deployment'")
        parts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(parts) < sum(parts) / 2


def test_halves_of_a_long_chain_spread_over_tasks(spark):
    from chainlake.plans.chains import with_half

    entries = spark.range(1000).select(F.lit("a").alias("chain_id"), F.col("id").alias("index")).union(
        spark.range(3).select(F.lit("b"), F.col("id"))
    )
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "-1", "false")):
            spark.conf.set(k, v)
        rows = with_half(entries, 10)
        per_task = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        halves = {(r["chain_id"], r["__h"], r["n"]) for r in rows.groupBy("chain_id", "__h").agg(F.count("*").alias("n")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert halves == {("a", 500, 1000), ("b", 1, 3)} and per_task < 600
