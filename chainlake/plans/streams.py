"""Stream operators over the driver tables, checked by the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.operators.chain import verify_chains
from chainlake.operators.changes import doc_change_stream, pg_change_stream
from chainlake.operators.events import access_payloads
from chainlake.operators.scan import beside_rows
from chainlake.plans import chains, events as ev, fixtures as fx, observer, operations
from chainlake.plans.registry import query
from chainlake.session import materialize, new_path
from chainlake.sources import chain_log, chain_store
from chainlake.sources.logs import decode_access
from chainlake.streaming import append, stateful


@query("stream_rate_limit", operations.SQL_TOKEN_IP)
def stream_rate_limit(spark, sf_dir):
    stateful.use_state_store(spark)
    rows = operations.connections(spark, f"stream:{sf_dir}")
    out = stateful.stream_rate_limit(rows, "source_ip", operations.TOKEN_RATE, operations.TOKEN_BURST)
    return append.run_to_table(out, "rate-limit")


@query("stream_jti_dedup", operations.REPLAY_SQL)
def stream_jti_dedup(spark, sf_dir):
    stateful.use_state_store(spark)
    rows = operations.token_uses(spark, f"stream:{sf_dir}")
    return append.run_to_table(stateful.stream_jti_dedup(rows, live=False), "jti")


@query(
    "stream_failure_streaks",
    f"""WITH {operations.STREAKS_SQL} SELECT chain_id, seq, r AS failures,
    min(t) OVER (PARTITION BY chain_id, island) AS first_failure_ms, r >= 3 AND quorum AS alert FROM n""",
)
def stream_failure_streaks(spark, sf_dir):
    stateful.use_state_store(spark)
    rows = operations.outcomes(spark, f"stream:{sf_dir}")
    return append.run_to_table(stateful.stream_failure_streaks(rows, live=False), "streaks").drop("stuck")


@query(
    "stream_behaviour",
    f"{operations.COUNT_SQL} SELECT event_id, source_ip, connections FROM counted",
)
def stream_behaviour(spark, sf_dir):
    stateful.use_state_store(spark)
    rows = operations.connections(spark, f"stream:{sf_dir}")
    return append.run_to_table(stateful.stream_behaviour(rows), "behaviour")


@query(
    "stream_attribute_actor",
    f"SELECT seq, action, resource, actor FROM ({observer.attributed_sql(observer.PG_SQL, 'postgres')})",
)
def stream_attribute_actor(spark, sf_dir):
    stateful.use_state_store(spark)
    rows = pg_change_stream(observer.change_text(spark, f"stream:{sf_dir}"))
    out = append.run_to_table(stateful.stream_attribute_actor(rows), "attribute")
    return out.select("seq", "action", "resource", "actor")


@query(
    "stream_attribute_actor_by_session",
    f"""SELECT seq, actor FROM (SELECT *, coalesce(last_value(marker_actor IGNORE NULLS) OVER (
        PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        'observer:mongodb') AS actor FROM ({observer.DOC_SQL})
      WHERE marker_actor IS NOT NULL OR action IS NOT NULL) WHERE marker_actor IS NULL""",
)
def stream_attribute_actor_by_session(spark, sf_dir):
    stateful.use_state_store(spark)
    rows = doc_change_stream(observer.change_docs(spark, f"stream:{sf_dir}"))
    out = append.run_to_table(stateful.stream_attribute_actor(rows, by="session_id"), "attribute-session")
    return out.select("seq", "actor")


@query("stream_chain_append", chains.HEADS_SQL + "SELECT chain_id, entries, head, true AS ok FROM folded")
def stream_chain_append(spark, sf_dir):
    """Events arrive as a stream, twice; each is appended once and all chains verify."""
    path = new_path(spark, "appended")
    for run in range(2):
        # A second query over the same events with a new batch id is a redelivery.
        events = fx.access_events(spark, f"stream:{sf_dir}")
        if run == 0:
            append.stream_chain_append(events, path, fx.SALT, new_path(spark, "ck")).awaitTermination()
        else:
            redelivered = fx.access_events(spark, sf_dir)
            append.append_batch(redelivered, 1, path, fx.SALT)
    return verify_chains(append.appended_entries(spark, path)).select("chain_id", "entries", "head", "ok")


@query(
    "stream_append_mixed",
    f"""WITH {fx.PAYLOADS_SQL}, arrived AS (
      SELECT chain_id, event_id * 2 AS seq, position, payload_type, payload_json FROM payloads
      UNION ALL SELECT '_deployment', event_id * 2 + 1, 0, 2, payload_json FROM ({ev.SYSTEM_SQL}))
    SELECT chain_id, row_number() OVER (PARTITION BY chain_id ORDER BY seq, position) - 1 AS "index",
      payload_type, payload_json, true AS ok FROM arrived""",
)
def stream_append_mixed(spark, sf_dir):
    """Access and system events of one stream, in turns; system events reach the deployment chain only."""
    path, source = new_path(spark, "mixed"), f"stream:{sf_dir}"
    access = fx.access_events(spark, source).withColumn("event_id", F.col("event_id") * 2)
    system = ev.system_events(spark, source).withColumn("event_id", F.col("event_id") * 2 + 1)
    rows = append.mixed_events(access, system)
    append.stream_chain_append(rows, path, fx.SALT, new_path(spark, "ck")).awaitTermination()
    entries = append.appended_entries(spark, path)
    verdicts = beside_rows(materialize(verify_chains(entries).select("chain_id", "ok"), "verdicts"))
    return entries.join(verdicts, "chain_id").select(
        "chain_id", "index", "payload_type", "payload_json", "ok"
    )


@query("stream_without_redelivery", f"SELECT event_id, timestamp FROM ({fx.ACCESS_SQL})")
def stream_without_redelivery(spark, sf_dir):
    """A stream that delivers every event twice; ids are forgotten after the transit retention."""
    stateful.use_state_store(spark)
    rows = [fx.access_events(spark, f"stream:{sf_dir}").select("event_id", "timestamp") for _ in range(2)]
    return append.run_to_table(append.without_redelivery(rows[0].unionByName(rows[1])), "delivered-once")


@query(
    "stream_process2",
    observer.PROJECTED_SQL
    + """, half AS (SELECT idx FROM proj JOIN sizes ON ordinal = n // 2)
    SELECT 0 AS tick_id, n // 2 AS entries_verified, (SELECT idx FROM half) AS cursor_prx, n // 2 AS cursor_obs FROM sizes
    UNION ALL SELECT 1, n - n // 2, total, n FROM sizes""",
)
def stream_process2(spark, sf_dir):
    """Two ticks: the observer has half of its entries at the first, all at the second."""
    proxy = fx.chains(spark, sf_dir).filter(F.col("chain_id") == "_deployment")
    obs = observer.observer_chain(spark, sf_dir)
    half = obs.agg(F.floor(F.count("*") / 2)).first()[0]
    state = new_path(spark, "cursors")
    first = append.process2_tick(proxy, obs.filter(F.col("index") < half), fx.SALT, state, 0)
    second = append.process2_tick(proxy, obs, fx.SALT, state, 1)
    return first.unionByName(second).select("tick_id", "entries_verified", "cursor_prx", "cursor_obs")


def _arriving(spark, entries, name, parts):
    """A stream of ``entries`` in order of index, one of ``parts`` files a batch."""
    path = new_path(spark, name)
    total = entries.agg(F.max("index")).first()[0] or 0
    part = F.floor(F.col("index") * parts / (total + 1)).cast("int")
    for number in range(parts):
        entries.filter(part == number).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "stream_process2_batches",
    observer.PROJECTED_SQL
    + " SELECT n AS entries_verified, total AS cursor_prx, n AS cursor_obs, 0 AS tail_depth, false AS divergent FROM sizes",
)
def stream_process2_batches(spark, sf_dir):
    """Both sides arrive as streams, the proxy's chain in two batches and the observer's in five."""
    proxy = fx.chains(spark, sf_dir).filter(F.col("chain_id") == "_deployment")
    obs = observer.observer_chain(spark, sf_dir).select(*proxy.columns)
    path = new_path(spark, "compared")
    append.stream_process2(
        _arriving(spark, proxy, "proxy", 2), _arriving(spark, obs, "observer", 5), fx.SALT, path, new_path(spark, "ck")
    ).awaitTermination()
    ticks = append.compare_ticks(spark, path)
    last = F.max_by(F.struct("cursor_prx", "cursor_obs", "tail_depth"), "tick_id").alias("c")
    return ticks.agg(F.sum("entries_verified").alias("entries_verified"), last, F.bool_or("divergent").alias("divergent")).select(
        "entries_verified", "c.*", "divergent"
    )


@query(
    "store_erasure",
    operations._ERASE_SQL
    + """ SELECT chain_id, count(*) + CASE WHEN chain_id = '_deployment' THEN (SELECT count(*) FROM verdict WHERE status = 200)
      ELSE 0 END AS entries, true AS ok FROM payloads GROUP BY chain_id""",
)
def store_erasure(spark, sf_dir):
    """Stored chains are erased in two phases and the erased users come back; every chain verifies at the end."""
    path = new_path(spark, "store")
    payloads = access_payloads(fx.access_events(spark, sf_dir), fx.SALT)
    chain_store.append(payloads, path)
    receipts = chain_store.erase(operations.erasure_requests(spark, sf_dir), path)
    gone = materialize(receipts.filter("deleted").select("chain_id"), "erased")
    chain_store.append(payloads.join(gone, "chain_id", "left_semi"), path)
    chain_store.vacuum(spark, path)
    return verify_chains(chain_store.entries(spark, path)).select("chain_id", "entries", "ok")


@query(
    "store_erasure_receipts",
    operations._ERASE_SQL
    + """ SELECT request_id, chain_id, status, status = 200 AS deleted, CASE WHEN status = 200 THEN
      (SELECT count(*) FROM payloads WHERE chain_id = '_deployment') + row_number() OVER (PARTITION BY status ORDER BY request_id) - 1
      END AS tombstone_index FROM verdict""",
)
def store_erasure_receipts(spark, sf_dir):
    """One answer a request: admitted ones name their tombstone and are deleted, others are refused."""
    path = new_path(spark, "store")
    chain_store.append(access_payloads(fx.access_events(spark, sf_dir), fx.SALT), path)
    return chain_store.erase(operations.erasure_requests(spark, sf_dir), path).drop("tombstone_hash")


@query(
    "store_retention",
    operations._META_SQL
    + """ SELECT chain_id, entry_count + CASE WHEN chain_id = '_deployment' THEN (SELECT count(*) FROM old) ELSE 0 END AS entries,
      true AS ok FROM meta WHERE chain_id NOT IN (SELECT chain_id FROM old)""",
)
def store_retention(spark, sf_dir):
    """A sweep of the stored chains: buckets of old chains are rewritten, tombstones follow."""
    path = new_path(spark, "store")
    chain_store.append(access_payloads(fx.access_events(spark, sf_dir), fx.SALT), path)
    lo, hi = chain_store.heads(spark, path).agg(F.min("created_at"), F.max("created_at")).first()
    chain_store.sweep(spark, path, (lo + hi) // 2 + 86_400, days=1)
    return verify_chains(chain_store.entries(spark, path)).select("chain_id", "entries", "ok")


@query(
    "decode_access",
    """SELECT count(*) FILTER (event_id % 10 != 0) AS decoded, count(*) FILTER (event_id % 10 = 0) AS dead,
    sum(event_id) FILTER (event_id % 10 != 0) AS ids FROM events""",
)
def decode_access_query(spark, sf_dir):
    """Messages as JSON text; one in ten is damaged or lacks a required member."""
    e = fx.access_events(spark, sf_dir)
    text = F.to_json(F.struct(*e.columns))
    damaged = (
        F.when(F.col("event_id") % 20 == 0, F.left(text, F.length(text) - 5))
        .when(F.col("event_id") % 10 == 0, F.replace(text, F.lit('"action"'), F.lit('"other"')))
        .otherwise(text)
    )
    good, bad = decode_access(e.select(damaged.alias("value")))
    rows = good.select("event_id", F.lit(0).alias("dead")).unionByName(
        bad.select(F.lit(None).cast("bigint").alias("event_id"), F.lit(1).alias("dead"))
    )
    return rows.agg(
        F.count_if(F.col("dead") == 0).alias("decoded"),
        F.sum("dead").alias("dead"),
        F.sum("event_id").alias("ids"),
    )


@query(
    "chain_log_roundtrip",
    f"""WITH {fx.PAYLOADS_SQL} SELECT chain_id, idx AS "index", payload_type, payload_json FROM payloads""",
)
def chain_log_roundtrip(spark, sf_dir):
    """Entries written as JSON lines, one folder per chain, and read back."""
    path = new_path(spark, "log")
    entries = fx.chains(spark, sf_dir)
    (
        entries.select("chain_id", *[c for c in entries.columns if c not in ("chain_id", "payload_json")],
                       F.col("payload_json").alias("payload"))
        .repartition("chain_id")
        .sortWithinPartitions("chain_id", "index")
        .write.partitionBy("chain_id")
        .json(path)
    )
    back = chain_log.read_chain_log(spark, path)
    return back.select(
        F.replace("chain_id", F.lit("chain_id=")).alias("chain_id"), "index", "payload_type", "payload_json"
    )


@query(
    "append_entries_replayed",
    f"""WITH {fx.PAYLOADS_SQL} SELECT chain_id, count(*) AS entries FROM payloads GROUP BY chain_id""",
)
def append_entries_replayed(spark, sf_dir):
    """A batch written twice under one id is there once."""
    path = new_path(spark, "append")
    entries = fx.chains(spark, sf_dir)
    for batch_id, rows in ((0, entries.filter("index < 50")), (1, entries.filter("index >= 50"))):
        for _ in range(2):
            chain_log.append_entries(rows, batch_id, path)
    return append._read(spark, path, chain_log.CHAIN_ENTRY).groupBy("chain_id").agg(F.count("*").alias("entries"))


@query(
    "write_chains_layout",
    f"""WITH {fx.PAYLOADS_SQL} SELECT CASE WHEN chain_id = '_deployment' THEN 'deployment' ELSE 'user' END AS chain_class,
    count(*) AS entries, count(DISTINCT chain_id) AS chains FROM payloads GROUP BY 1""",
)
def write_chains_layout(spark, sf_dir):
    """Clustered Parquet by chain class."""
    path = new_path(spark, "chains")
    chain_log.write_chains(fx.chains(spark, sf_dir), path)
    return (
        chain_log.read_chains(spark, path)
        .groupBy("chain_class")
        .agg(F.count("*").alias("entries"), F.countDistinct("chain_id").alias("chains"))
    )
