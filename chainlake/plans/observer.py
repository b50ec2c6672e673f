"""Change streams, actor attribution and the comparison of log and observer."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.operators import changes, compare, events
from chainlake.operators.chain import build_chains
from chainlake.plans import fixtures as fx
from chainlake.plans.registry import query
from chainlake.session import materialize

_PG_OP = {"view": "SELECT", "click": "UPDATE", "purchase": "INSERT", "signup": "TRUNCATE", "error": "DELETE"}
_PG_ACTION = {"view": None, "click": "write", "purchase": "write", "signup": "delete", "error": "delete"}
_PG_LABEL = {"view": None, "click": "update", "purchase": "insert", "signup": "truncate", "error": "delete"}
RESOURCE_SQL = fx._pick_sql(fx._RESOURCES, "event_id")


def change_text(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    resource = fx._pick(fx._RESOURCES, F.col("event_id"))
    marker = F.concat(
        F.lit("table public.audit_marker: INSERT: id[bigint]:"),
        F.col("event_id"),
        F.lit(" actor_id[text]:'admin''s "),
        F.col("user_id") % 7,
        F.when(F.col("event_id") % 12 == 0, F.lit("''")).otherwise(F.lit("' session_id[uuid]:'x'")),
    )
    row = F.concat(
        F.lit("table public."), resource, F.lit(": "), fx.by_action(_PG_OP), F.lit(": id[integer]:"), "user_id"
    )
    data = (
        F.when(F.col("event_id") % 6 == 0, marker)
        .when(F.col("event_id") % 6 == 1, F.concat(F.lit("BEGIN "), "event_id"))
        .otherwise(row)
    )
    return e.select(F.col("event_id").alias("seq"), F.floor(fx.event_ms() / 1000).alias("timestamp"), data.alias("data"))


# Unterminated markers (every 12th) are no markers; they parse as inserts into the
# marker table and are dropped.
PG_SQL = f"""
SELECT event_id AS seq, epoch_us(ts) // 1000000 AS timestamp,
  CASE WHEN event_id % 6 = 0 AND event_id % 12 != 0 THEN 'admin''s ' || (user_id % 7) END AS marker_actor,
  CASE WHEN event_id % 6 > 1 THEN {fx.by_action_sql(_PG_ACTION)} END AS action,
  CASE WHEN event_id % 6 > 1 THEN {RESOURCE_SQL} END AS resource,
  CASE WHEN event_id % 6 > 1 THEN {fx.by_action_sql(_PG_LABEL)} || ':' || {RESOURCE_SQL} END AS scope
FROM events"""
_KEPT = "(marker_actor IS NOT NULL OR action IS NOT NULL)"


@query(
    "pg_change_stream",
    f"""SELECT seq, marker_actor, CASE WHEN marker_actor IS NULL THEN action END AS action,
    CASE WHEN marker_actor IS NULL THEN resource END AS resource,
    CASE WHEN marker_actor IS NULL THEN scope END AS scope FROM ({PG_SQL}) WHERE {_KEPT}""",
)
def pg_change_stream(spark, sf_dir):
    rows = changes.pg_change_stream(change_text(spark, sf_dir))
    plain = F.col("marker_actor").isNull()
    return rows.select("seq", "marker_actor", *[F.when(plain, F.col(c)).alias(c) for c in ("action", "resource", "scope")])


def attributed_sql(source_sql: str, source: str) -> str:
    return f"""
    SELECT * FROM (SELECT *, coalesce(last_value(marker_actor IGNORE NULLS) OVER (
        ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'observer:{source}') AS actor
      FROM ({source_sql}) WHERE {_KEPT})
    WHERE marker_actor IS NULL"""


@query(
    "attribute_actor",
    f"SELECT seq, action, resource, actor FROM ({attributed_sql(PG_SQL, 'postgres')})",
)
def attribute_actor(spark, sf_dir):
    rows = changes.attribute_actor(changes.pg_change_stream(change_text(spark, sf_dir)))
    return rows.select("seq", "action", "resource", "actor")


@query(
    "attribute_actor_large_source",
    f"SELECT seq, action, resource, actor FROM ({attributed_sql(PG_SQL, 'postgres')})",
)
def attribute_actor_large_source(spark, sf_dir):
    """The one source counts as too large for one task and is scanned bucket by bucket."""
    rows = changes.attribute_actor(changes.pg_change_stream(change_text(spark, sf_dir)), bucket_rows=1000)
    return rows.select("seq", "action", "resource", "actor")


def observed_sql(source: str) -> str:
    return f"""SELECT seq AS event_id, timestamp,
      '{{"action":"' || action || '","actor_id_hash":"' || {fx.hmac_sql("actor")} || '","query_fingerprint":"'
      || sha256(scope) || '","resource":"' || resource || '"}}' AS payload_json FROM ({source})"""


@query("observe_change", observed_sql(attributed_sql(PG_SQL, "postgres")))
def observe_change(spark, sf_dir):
    rows = changes.attribute_actor(changes.pg_change_stream(change_text(spark, sf_dir)))
    return events.observe_change(rows, fx.SALT).select("event_id", "timestamp", "payload_json")


_DOC_OP = {"view": "invalidate", "click": "update", "purchase": "insert", "signup": "drop", "error": "delete"}
_DOC_ACTION = {"view": None, "click": "write", "purchase": "write", "signup": "schema_change", "error": "delete"}


def change_docs(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    marker = F.col("event_id") % 8 == 0
    return e.select(
        F.col("event_id").alias("seq"),
        F.floor(fx.event_ms() / 1000).alias("timestamp"),
        F.when(marker, "audit").otherwise("app").alias("db"),
        F.when(marker, "markers")
        .when(F.col("event_id") % 5 == 0, "")
        .otherwise(fx._pick(fx._RESOURCES, F.col("event_id")))
        .alias("coll"),
        F.when(marker, "insert").otherwise(fx.by_action(_DOC_OP)).alias("op"),
        F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("doc_key"),
        F.when(marker, F.concat(F.lit('{"actor_id":"admin'), F.col("user_id") % 7, F.lit('"}'))).alias("full_document"),
        F.concat(F.lit("s"), F.col("user_id") % 3).alias("session_id"),
    )


DOC_SQL = f"""
SELECT seq, timestamp, marker_actor, action, resource, session_id,
  op || ':' || resource || ':key=' || doc_key AS scope FROM (
  SELECT event_id AS seq, epoch_us(ts) // 1000000 AS timestamp, 's' || (user_id % 3) AS session_id,
    CASE WHEN event_id % 8 = 0 THEN 'admin' || (user_id % 7) END AS marker_actor,
    CASE WHEN event_id % 8 != 0 THEN {fx.by_action_sql(_DOC_ACTION)} END AS action,
    {fx.by_action_sql(_DOC_OP)} AS op,
    CASE WHEN event_id % 8 != 0 THEN CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE {RESOURCE_SQL} END END AS resource,
    CASE WHEN event_id % 3 != 0 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS doc_key FROM events)"""


@query("doc_changes_observed", observed_sql(attributed_sql(DOC_SQL, "mongodb")))
def doc_changes_observed(spark, sf_dir):
    rows = changes.attribute_actor(changes.doc_change_stream(change_docs(spark, sf_dir)))
    return events.observe_change(rows, fx.SALT).select("event_id", "timestamp", "payload_json")


@query(
    "attribute_actor_by_session",
    f"""SELECT seq, session_id, actor FROM (SELECT *, coalesce(last_value(marker_actor IGNORE NULLS) OVER (
        PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        'observer:mongodb') AS actor FROM ({DOC_SQL}) WHERE {_KEPT}) WHERE marker_actor IS NULL""",
)
def attribute_actor_by_session(spark, sf_dir):
    rows = changes.doc_change_stream(change_docs(spark, sf_dir))
    return changes.attribute_actor(rows, by="session_id", bucket_rows=500).select("seq", "session_id", "actor")


_NOTICE = {
    "view": "s3:ObjectAccessed:Get",
    "click": "s3:ObjectCreated:Put",
    "purchase": "s3:Replication:Done",
    "signup": "s3:ObjectCreated:Copy",
    "error": "s3:ObjectRemoved:Delete",
}
_NOTICE_ACTION = {"view": "read", "click": "write", "purchase": None, "signup": "write", "error": "delete"}


def notifications(spark, sf_dir):
    e = F.col("event_id")
    header = (
        F.when(e % 4 == 0, "X-Amz-Meta-Audit-Actor")
        .when(e % 4 == 1, "x-amz-meta-audit-actor")
        .when(e % 4 == 2, "X-AMZ-META-AUDIT-ACTOR")
        .otherwise("content-type")
    )
    body = F.concat(
        F.lit('{"EventName":"'),
        fx.by_action(_NOTICE),
        F.lit('","Records":[{"s3":{"bucket":{"name":"uploads"},"object":{"key":"users/'),
        "user_id",
        F.lit('","size":'),
        e,
        F.lit(',"eTag":"t'),
        e,
        F.lit('","userMetadata":{"'),
        header,
        F.lit('":"admin'),
        F.col("user_id") % 7,
        F.lit('"}}}}]}'),
    )
    return fx.table(spark, sf_dir, "events").select(
        e.alias("seq"), F.when(e % 31 == 0, "{broken").otherwise(body).alias("body")
    )


@query(
    "object_event_stream",
    f"""SELECT event_id AS seq, {fx.by_action_sql(_NOTICE_ACTION)} AS action, 'uploads/users/' || user_id AS resource,
      {fx.by_action_sql(_NOTICE)} || ':uploads/users/' || user_id AS scope, event_id AS size, 't' || event_id AS etag,
      CASE WHEN event_id % 4 = 3 THEN 'observer:minio' ELSE 'admin' || (user_id % 7) END AS actor
    FROM events WHERE event_type != 'purchase' AND event_id % 31 != 0""",
)
def object_event_stream(spark, sf_dir):
    rows = changes.object_event_stream(notifications(spark, sf_dir))
    return rows.select("seq", "action", "resource", "scope", "size", "etag", "actor")


def observer_chain(spark, sf_dir):
    """What a faithful observer of the access log's deployment chain would have written."""

    def build(s, d):
        deployment = fx.deployment_chain(s, d)
        # Stored, because the linking counts the rows first and the texts are parsed for it.
        rows = materialize(events.project_to_observed(deployment, fx.SALT), "observed", **fx.STORED)
        return build_chains(
            rows.select(
                F.lit("_deployment").alias("chain_id"),
                F.col("index").alias("event_id"),
                F.lit(0).alias("position"),
                "timestamp",
                F.lit(3).alias("payload_type"),
                F.col("observed_json").alias("payload_json"),
            )
        )

    return fx.shared_table(spark, sf_dir, "observer", build)


PROJECTED_SQL = f"""WITH {fx.PAYLOADS_SQL},
dep AS (SELECT p.idx, a.action FROM payloads p JOIN access a USING (event_id) WHERE p.chain_id = '_deployment'),
proj AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS ordinal FROM dep WHERE action IN ('write', 'delete')),
sizes AS (SELECT count(*) AS n, (SELECT count(*) FROM dep) AS total FROM proj)
"""


@query(
    "process2_tail",
    PROJECTED_SQL
    + """SELECT false AS divergent, n - 5 AS entries_verified, idx AS cursor_prx, n - 5 AS cursor_obs,
      greatest(total - idx, 0) AS tail_depth FROM sizes JOIN proj ON ordinal = n - 5""",
)
def process2_tail(spark, sf_dir):
    """The observer lags by five entries and writes some with other member order; nothing diverges."""
    proxy = fx.deployment_chain(spark, sf_dir)
    obs = observer_chain(spark, sf_dir)
    turned = F.regexp_replace("payload_json", r'^\{("action":"[^"]*"),(.*)\}$', r"{$2, $1}")
    obs = obs.withColumn("payload_json", F.when(F.col("index") % 7 == 0, turned).otherwise(F.col("payload_json")))
    n = obs.agg(F.max("index") + 1).first()[0]
    out = compare.process2(proxy, obs.filter(F.col("index") < n - 5), fx.SALT, bucket_rows=500)
    return out.select("divergent", "entries_verified", "cursor_prx", "cursor_obs", "tail_depth")


@query(
    "process2_divergence",
    PROJECTED_SQL
    + """SELECT true AS divergent, n // 2 AS entries_verified, idx AS cursor_prx, n // 2 AS cursor_obs,
      greatest(total - idx, n - n // 2) AS tail_depth FROM sizes JOIN proj ON ordinal = n // 2""",
)
def process2_divergence(spark, sf_dir):
    """One observed payload altered; both cursors stop at the pair."""
    out = compare.process2(*_altered(spark, sf_dir), fx.SALT)
    return out.select("divergent", "entries_verified", "cursor_prx", "cursor_obs", "tail_depth")


def _altered(spark, sf_dir):
    proxy = fx.deployment_chain(spark, sf_dir)
    obs = observer_chain(spark, sf_dir)
    middle = obs.agg(F.floor(F.count("*") / 2)).first()[0]
    edited = F.replace("payload_json", F.lit('"resource":"'), F.lit('"resource":"x'))
    return proxy, obs.withColumn(
        "payload_json", F.when(F.col("index") == middle, edited).otherwise(F.col("payload_json"))
    )


@query(
    "process2_page",
    PROJECTED_SQL
    + """, page AS (SELECT count(*) AS m FROM proj WHERE idx < 500)
    SELECT false AS divergent, m AS entries_verified, 500 AS cursor_prx, m AS cursor_obs,
      greatest(total - 500, n - m) AS tail_depth FROM sizes, page""",
)
def process2_page(spark, sf_dir):
    """One page of at most 500 entries per side."""
    proxy = fx.deployment_chain(spark, sf_dir)
    out = compare.process2(proxy, observer_chain(spark, sf_dir), fx.SALT, limit=500)
    return out.select("divergent", "entries_verified", "cursor_prx", "cursor_obs", "tail_depth")


@query(
    "verification_failure_rows",
    PROJECTED_SQL
    + f""", bad AS (SELECT a.*, n, proj.idx AS i FROM sizes JOIN proj ON ordinal = n // 2
      JOIN payloads p ON p.idx = proj.idx AND p.chain_id = '_deployment' JOIN access a USING (event_id)),
    texts AS (SELECT *, '{{"action":"' || action || '","actor_id_hash":"' || {fx.hmac_sql("admin_id")}
      || '","query_fingerprint":"' || query_fingerprint || '","resource":"' AS head FROM bad)
    SELECT 'verification_failure' AS category, CAST(i AS VARCHAR) AS cursor_prx, CAST(n // 2 AS VARCHAR) AS cursor_obs,
      lower(hex(encode(head || resource || '"}}'))) AS proxy_payload,
      lower(hex(encode(head || 'x' || resource || '"}}'))) AS observed_payload FROM texts""",
)
def verification_failure_rows(spark, sf_dir):
    rows = compare.verification_failure_rows(compare.process2(*_altered(spark, sf_dir), fx.SALT))
    names = ("cursor_prx", "cursor_obs", "proxy_payload", "observed_payload")
    return rows.select("category", *[F.col("details")[n].alias(n) for n in names])


@query(
    "observer_missing",
    PROJECTED_SQL
    + f""", rows AS (SELECT p.ordinal, '{{"action":"' || a.action || '","actor_id_hash":"' || {fx.hmac_sql("admin_id")}
      || '","query_fingerprint":"' || query_fingerprint || '","resource":"' || resource || '"}}' AS payload
      FROM proj p JOIN payloads q ON q.idx = p.idx AND q.chain_id = '_deployment' JOIN access a USING (event_id))
    SELECT payload FROM rows EXCEPT ALL SELECT payload FROM rows WHERE ordinal % 10 != 3""",
)
def observer_missing(spark, sf_dir):
    """Every tenth observed payload is left out of the log side."""
    obs = observer_chain(spark, sf_dir)
    payloads = obs.select(F.col("payload_json").alias("payload"), "index")
    return compare.observer_missing(payloads.filter("index % 10 != 3"), payloads)
