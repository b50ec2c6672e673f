"""Events to payloads and canonical text."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions.canon import canonicalize, with_canonical
from chainlake.operators import events
from chainlake.operators.ops import system_event
from chainlake.plans import fixtures as fx
from chainlake.plans.registry import query
from chainlake.schemas import CATEGORIES


@query(
    "fan_out",
    f"""WITH {fx.PAYLOADS_SQL} SELECT event_id, position, subject FROM fanned""",
)
def fan_out(spark, sf_dir):
    rows = events.fan_out(fx.access_events(spark, sf_dir))
    return rows.select("event_id", F.col("position").cast("bigint"), "subject")


@query(
    "access_payloads",
    f"""WITH {fx.PAYLOADS_SQL} SELECT event_id, position, chain_id, ts AS timestamp, payload_type, payload_json
    FROM payloads""",
)
def access_payloads(spark, sf_dir):
    rows = events.access_payloads(fx.access_events(spark, sf_dir), fx.SALT)
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query(
    "to_access_payload",
    f"""WITH {fx.PAYLOADS_SQL} SELECT event_id, payload_json FROM payloads WHERE position = 1""",
)
def to_access_payload(spark, sf_dir):
    """One payload per event that touches a user, before fan-out."""
    rows = events.to_access_payload(
        fx.access_events(spark, sf_dir).filter(F.size("affected_users") > 0), fx.SALT
    )
    return rows.select("event_id", "payload_json")


@query(
    "access_to_deployment",
    f"""WITH {fx.PAYLOADS_SQL} SELECT event_id, payload_json FROM payloads WHERE position = 0""",
)
def access_to_deployment(spark, sf_dir):
    return events.access_to_deployment(fx.access_events(spark, sf_dir)).select("event_id", "payload_json")


_USED = [c for c in CATEGORIES if c not in ("egress", "replica_reshuffle")]
_USED_SQL = "list_extract([" + ", ".join(f"'{c}'" for c in _USED) + f"], CAST(event_id % {len(_USED)} AS INT) + 1)"


def system_events(spark, sf_dir):
    """One system event per access event, categories cycling over all names but two."""
    e = fx.table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("op"), F.col("user_id") % 5).alias("actor_id"),
        F.when(F.col("event_id") % 2 == 0, "ci_cd").otherwise("operator").alias("actor_type"),
        F.element_at(F.array(*[F.lit(c) for c in _USED]), (F.col("event_id") % len(_USED)).cast("int") + 1).alias(
            "category"
        ),
        F.lit("schema_change").alias("action"),
        F.col("event_type").alias("resource"),
        F.concat(F.lit("change "), F.col("event_id")).alias("scope"),
        F.map_filter(
            F.create_map(
                F.lit("zone"),
                F.col("user_id").cast("string"),
                F.lit("query_fingerprint"),
                F.when(F.col("event_id") % 3 == 0, F.sha2("event_type", 256)),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("details"),
        F.when(F.col("event_id") % 4 == 0, F.sha2("props", 256)).alias("artifact_hash"),
        fx.event_ms().alias("timestamp"),
        F.when(F.col("event_id") % 5 != 0, fx.session_id()).alias("session_id"),
        F.when(F.col("event_id") % 7 != 0, fx.caller_ip()).alias("source_ip"),
    )


SYSTEM_SQL = f"""
SELECT event_id, {_USED_SQL} AS category, 'op' || (user_id % 5) AS actor_id, event_type AS resource,
  CASE WHEN event_id % 3 = 0 THEN sha256(event_type) END AS fp,
  epoch_us(ts) // 1000000 AS timestamp,
  '{{"action":"schema_change","actor_id":"op' || (user_id % 5) || '","actor_type":"'
  || CASE WHEN event_id % 2 = 0 THEN 'cicd' ELSE 'operator' END || '","category":"' || {_USED_SQL}
  || '","details":{{' || CASE WHEN event_id % 4 = 0 THEN '"artifact_hash":"' || sha256(props) || '",' ELSE '' END
  || CASE WHEN event_id % 3 = 0 THEN '"query_fingerprint":"' || sha256(event_type) || '",' ELSE '' END
  || '"zone":"' || user_id || '"}},"resource":"' || event_type || '","scope":{{"description":"change ' || event_id
  || '"}},' || CASE WHEN event_id % 5 != 0 THEN '"session_id":"' || {fx.SESSION_SQL} || '",' ELSE '' END
  || '"source_ip":"' || CASE WHEN event_id % 7 != 0 THEN '10.0.' || (user_id % 4) || '.' || (user_id % 250)
     ELSE 'unknown' END || '"}}' AS payload_json
FROM events"""


@query("system_to_deployment", f"SELECT event_id, timestamp, payload_json FROM ({SYSTEM_SQL})")
def system_to_deployment(spark, sf_dir):
    rows = events.system_to_deployment(system_events(spark, sf_dir))
    return rows.select("event_id", "timestamp", "payload_json")


@query(
    "project_to_observed",
    f"""WITH {fx.PAYLOADS_SQL}, a AS (
      SELECT event_id, resource, action, admin_id AS actor, query_fingerprint AS fp FROM access
      WHERE action IN ('write', 'delete')),
    s AS (SELECT event_id, resource, 'schema_change' AS action, actor_id AS actor, fp FROM ({SYSTEM_SQL})
      WHERE category = 'schema' AND fp IS NOT NULL),
    u AS (SELECT 'a' AS side, * FROM a UNION ALL SELECT 's', * FROM s)
    SELECT side, event_id, action, resource, {fx.hmac_sql("actor")} AS actor_id_hash, fp AS query_fingerprint,
      '{{"action":"' || action || '","actor_id_hash":"' || {fx.hmac_sql("actor")} || '","query_fingerprint":"' || fp
      || '","resource":"' || resource || '"}}' AS observed_json FROM u""",
)
def project_to_observed(spark, sf_dir):
    """Access and system entries of the deployment chain; most are not observable."""
    a = events.access_to_deployment(fx.access_events(spark, sf_dir)).select(
        F.lit("a").alias("chain_id"), F.col("event_id").alias("index"), "timestamp", "payload_type", "payload_json"
    )
    s = events.system_to_deployment(system_events(spark, sf_dir)).select(
        F.lit("s").alias("chain_id"), F.col("event_id").alias("index"), "timestamp", "payload_type", "payload_json"
    )
    rows = events.project_to_observed(a.unionByName(s), fx.SALT)
    return rows.select(
        F.col("chain_id").alias("side"),
        F.col("index").alias("event_id"),
        "action",
        "resource",
        "actor_id_hash",
        "query_fingerprint",
        "observed_json",
    )


@query(
    "witnessable_categories",
    f"""SELECT category, count(*) AS n, category IN ('admin_access', 'schema') AS witnessable
    FROM ({SYSTEM_SQL}) GROUP BY category""",
)
def witnessable_categories(spark, sf_dir):
    rows = system_events(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    return rows.withColumn("witnessable", events.is_observer_witnessable(F.col("category")))


@query(
    "payload_well_formed",
    f"""WITH {fx.PAYLOADS_SQL}
    SELECT event_id, position, CASE event_id % 5
      WHEN 1 THEN 'null at resource' WHEN 2 THEN 'null at extra.deep' WHEN 3 THEN CASE WHEN event_id % 1000 = 3 THEN 'too_large' END
      WHEN 4 THEN CASE WHEN payload_type = 1 AND len(ids) > 1 THEN 'ids_not_sorted' END END AS refusal
    FROM payloads JOIN (SELECT event_id AS e, ids FROM prepared) ON e = event_id""",
)
def payload_well_formed(spark, sf_dir):
    rows = events.access_payloads(fx.access_events(spark, sf_dir), fx.SALT)
    text, k = F.col("payload_json"), F.col("event_id") % 5
    pad = F.concat(F.left(text, F.length(text) - 1), F.lit(',"pad":"'), F.repeat(F.lit("x"), 1_048_576), F.lit('"}'))
    nested = F.concat(F.left(text, F.length(text) - 1), F.lit(',"extra":{"deep":null}}'))
    unsorted = F.regexp_replace(text, r'"affected_user_ids":\["([0-9a-f]+)","([0-9a-f]+)"', '"affected_user_ids":["$2","$1"')
    damaged = (
        F.when(k == 1, F.regexp_replace(text, '"resource":"[a-z]+"', '"resource":null'))
        .when(k == 2, nested)
        .when(F.col("event_id") % 1000 == 3, pad)
        .when(k == 4, unsorted)
        .otherwise(text)
    )
    checked = events.payload_well_formed(rows.withColumn("payload_json", damaged))
    return checked.select("event_id", F.col("position").cast("bigint"), "refusal")


@query(
    "canonical_documents",
    """WITH d AS (SELECT doc_id, lang, nfc_normalize(text || ' e' || chr(769)) AS t FROM documents)
    SELECT doc_id, '{"lang":"' || lang || '","text":' || CAST(to_json(t) AS VARCHAR) || '}' AS canonical FROM d""",
)
def canonical_documents(spark, sf_dir):
    """Whole texts with a decomposed letter appended; normalised in the canonical form."""
    text = F.concat("text", F.lit(" é"))
    documents = fx.table(spark, sf_dir, "documents")
    members = {"text": text, "lang": F.col("lang")}
    return with_canonical(documents, {"canonical": members}).select("doc_id", "canonical")


@query(
    "canonical_free_form",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'null at a.b[1]' END AS error,
    CASE WHEN doc_id % 4 != 0 THEN '{"a":{"b":[' || doc_id || ',2]},"z":"' || lang || '"}' END AS canonical
    FROM documents""",
)
def canonical_free_form(spark, sf_dir):
    second = F.when(F.col("doc_id") % 4 == 0, "null").otherwise("2.0")
    text = F.concat(
        F.lit('{ "z" : "'), "lang", F.lit('", "a":{"b":['), "doc_id", F.lit(", "), second, F.lit("]}}")
    )
    c = canonicalize(text)
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", c["error"].alias("error"), c["canonical"].alias("canonical")
    )


@query(
    "assemble_org_view",
    f"""WITH {fx.PAYLOADS_SQL}, j AS (SELECT p.*, r.session_id, r.admin_id, r.action AS act FROM payloads p
      JOIN prepared r USING (event_id))
    SELECT d.idx AS deployment_index, d.ts AS timestamp, d.session_id, d.admin_id AS actor_id, d.act AS action,
      u.chain_id AS user_chain, u.idx AS user_index
    FROM j d LEFT JOIN j u ON u.session_id = d.session_id AND u.ts = d.ts AND u.chain_id != '_deployment'
    WHERE d.chain_id = '_deployment'""",
)
def assemble_org_view(spark, sf_dir):
    entries = fx.chains(spark, sf_dir)
    own = F.col("chain_id") == "_deployment"
    return events.assemble_org_view(entries.filter(own), entries.filter(~own))


@query(
    "attach_sidecar",
    f"""WITH {fx.PAYLOADS_SQL}
    SELECT chain_id, idx AS "index", CASE WHEN idx % 3 = 0 THEN 'note ' || idx END AS sidecar FROM payloads""",
)
def attach_sidecar(spark, sf_dir):
    entries = fx.chains(spark, sf_dir)
    side = entries.filter("index % 3 = 0").select(
        "chain_id", F.col("index").alias("entry_index"), F.concat(F.lit("note "), "index").alias("sidecar")
    )
    return events.attach_sidecar(entries, side).select("chain_id", "index", "sidecar")


@query(
    "system_event_rows",
    """SELECT event_id, '{"action":"read","actor_id":"system:verifier","actor_type":"system","category":'
      || '"nightly_verification","details":{"checked":"' || event_id || '","kind":"' || event_type
      || '"},"resource":"chain-heads","scope":{"description":"run"},"source_ip":"unknown"}' AS payload_json
    FROM events""",
)
def system_event_rows(spark, sf_dir):
    rows = system_event(
        fx.table(spark, sf_dir, "events"),
        "system:verifier",
        "nightly_verification",
        "read",
        F.lit("chain-heads"),
        F.lit("run"),
        {"checked": F.col("event_id"), "kind": F.col("event_type")},
        F.col("event_id"),
        fx.event_ms(),
    )
    return events.system_to_deployment(rows).select("event_id", "payload_json")
