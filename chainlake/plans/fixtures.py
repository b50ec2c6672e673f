"""Inputs derived from the driver tables, row for row, so that they grow with them.

Every derivation has a SQL twin (the ``*_SQL`` constants: bodies of common table
expressions) that the checking queries start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions.crypto import hmac_pads

SALT = "test-salt"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; a ``stream:`` prefix on the folder reads it as a file stream."""
    if sf_dir.startswith("stream:"):
        folder = sf_dir.removeprefix("stream:")
        schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
        return (
            spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(folder)
        )
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # The driver tables are one small file each; spread those that the scan cannot split.
    # Large tables come in many splits and are read as they are.
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if _splits(df) < cores else df


def _splits(df: DataFrame) -> int:
    """Scan tasks of a table, from the planned scan."""
    return df.rdd.getNumPartitions()


def hmac_sql(expr: str, salt: str = SALT) -> str:
    """HMAC-SHA-256 hex of a string expression in the checking SQL."""
    inner, outer = (p.hex() for p in hmac_pads(salt))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({expr}))))"


def _session(text: Column) -> Column:
    h = F.md5(text)
    return F.concat_ws(
        "-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def _session_sql(text: str) -> str:
    parts = [f"substr(md5({text}),{a},{n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return " || '-' || ".join(parts)


def event_ms(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


_ACTION = {"view": "read", "click": "write", "purchase": "export", "signup": "schema_change"}


def _action() -> Column:
    c = F.col("event_type")
    out = F.when(c == "view", "read")
    for k, v in list(_ACTION.items())[1:]:
        out = out.when(c == k, v)
    return out.otherwise("delete")


ACTION_SQL = (
    "CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTION.items())
    + " ELSE 'delete' END"
)
_RESOURCES = ["users", "orders", "payments", "messages"]
_PROTOCOLS = ["postgres", "mongodb", "s3"]


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int") + 1)


def _pick_sql(values: list[str], number: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{listed}], CAST({number} % {len(values)} AS INT) + 1)"


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id").cast("string")
    kind = F.col("event_id") % 10
    affected = (
        F.when(kind == 0, F.array().cast("array<string>"))
        .when(kind.isin(1, 2), F.array(uid, (F.col("user_id") + 1).cast("string")))
        .when(kind == 3, F.array(uid, uid))
        .otherwise(F.array(uid))
    )
    ip = F.concat(
        F.lit("10.0."), F.col("user_id") % 4, F.lit("."), F.col("user_id") % 250
    )
    metadata = F.map_filter(
        F.create_map(
            F.lit("source_ip"),
            F.when(F.col("event_id") % 17 != 0, ip),
            F.lit("correlation_id"),
            F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("corr-"), F.col("event_id"))),
        ),
        lambda k, v: v.isNotNull(),
    )
    return e.select(
        "event_id",
        _pick(_PROTOCOLS, F.col("event_id")).alias("protocol"),
        F.concat(F.lit("admin"), F.col("user_id") % 7).alias("admin_id"),
        _action().alias("action"),
        _pick(_RESOURCES, F.col("event_id")).alias("resource"),
        F.concat(F.lit("columns: *; filter: user_id = "), uid).alias("scope"),
        F.sha2(F.concat_ws("|", "event_type", F.col("event_id") % 4), 256).alias("query_fingerprint"),
        affected.alias("affected_users"),
        event_ms().alias("timestamp"),
        _session(F.concat_ws("|", uid, F.date_format("ts", "yyyy-MM-dd"))).alias("session_id"),
        metadata.alias("metadata"),
    )


ACCESS_SQL = f"""
SELECT event_id,
  {_pick_sql(_PROTOCOLS, "event_id")} AS protocol,
  'admin' || (user_id % 7) AS admin_id,
  {ACTION_SQL} AS action,
  {_pick_sql(_RESOURCES, "event_id")} AS resource,
  sha256(event_type || '|' || (event_id % 4)) AS query_fingerprint,
  CASE WHEN event_id % 10 = 0 THEN CAST([] AS VARCHAR[])
       WHEN event_id % 10 IN (1, 2) THEN [CAST(user_id AS VARCHAR), CAST(user_id + 1 AS VARCHAR)]
       WHEN event_id % 10 = 3 THEN [CAST(user_id AS VARCHAR), CAST(user_id AS VARCHAR)]
       ELSE [CAST(user_id AS VARCHAR)] END AS affected_users,
  epoch_us(ts) // 1000 AS timestamp,
  {_session_sql("user_id || '|' || strftime(ts, '%Y-%m-%d')")} AS session_id,
  CASE WHEN event_id % 17 != 0 THEN '10.0.' || (user_id % 4) || '.' || (user_id % 250) END AS source_ip,
  CASE WHEN event_id % 5 = 0 THEN 'corr-' || event_id END AS correlation_id
FROM events"""


_IDS_SQL = f"list_sort(list_distinct(list_transform(affected_users, lambda u: {hmac_sql('u')})))"

# Fan-out with payloads: chain_id, event_id, position, ts (s), payload_type, payload_json, idx.
PAYLOADS_SQL = f"""
access AS ({ACCESS_SQL}),
prepared AS (
  SELECT *, timestamp // 1000 AS ts,
    {_IDS_SQL} AS ids,
    '"source_ip":"' || coalesce(source_ip, 'unknown') || '"' AS ip_member
  FROM access),
fanned AS (
  SELECT *, unnest(list_concat(['_deployment'], affected_users)) AS subject,
    unnest(range(len(affected_users) + 1)) AS position
  FROM prepared),
payloads AS (
  SELECT event_id, position, ts,
    CASE WHEN subject = '_deployment' THEN subject ELSE {hmac_sql("subject")} END AS chain_id,
    CASE WHEN subject = '_deployment' THEN 2 ELSE 1 END AS payload_type,
    CASE WHEN subject = '_deployment' THEN
      '{{"action":"' || action || '","actor_id":"' || admin_id || '","actor_type":"admin","category":"admin_access",'
      || '"details":{{"affected_user_count":' || len(affected_users) || ',"query_fingerprint":"'
      || query_fingerprint || '"}},"resource":"' || resource || '","scope":{{}},"session_id":"' || session_id
      || '",' || ip_member || '}}'
    ELSE
      '{{"action":"' || action || '","actor_id":"' || admin_id || '","actor_label":"' || admin_id
      || '","actor_type":"admin","affected_user_ids":["' || array_to_string(ids, '","') || '"],'
      || CASE WHEN correlation_id IS NULL THEN '' ELSE '"correlation_id":"' || correlation_id || '",' END
      || '"protocol":"' || protocol || '","query_fingerprint":"' || query_fingerprint || '","resource":"'
      || resource || '","scope":{{"bytes":0,"rows":0}},"session_id":"' || session_id || '",' || ip_member || '}}'
    END AS payload_json,
    row_number() OVER (PARTITION BY subject ORDER BY event_id, position) - 1 AS idx
  FROM fanned)"""

_BUILT: dict[tuple[str, str, str], DataFrame] = {}
#: Entries are half hashes in hex, which zstd takes to half. Files of bounded rows are read by tasks of their own also
#: where they compress well.
STORED = {"compression": "zstd", "maxRecordsPerFile": "200000"}


def shared_table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table several queries start from, written once per application and scale."""
    from chainlake.session import materialize

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = materialize(build(spark, sf_dir), name, **STORED)
    return _BUILT[key]


def build_access_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlake.operators.chain import build_chains
    from chainlake.operators.events import access_payloads, longest_chain

    events = access_events(spark, sf_dir)
    return build_chains(access_payloads(events, SALT), longest=longest_chain(events))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of all access events."""
    return shared_table(spark, sf_dir, "chains", build_access_chains)


def deployment_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deployment chain of all access events: of the chains if they are built, else linked without the others."""
    from chainlake.operators.chain import build_chains
    from chainlake.operators.events import access_to_deployment
    from chainlake.schemas import DEPLOYMENT_CHAIN

    if (spark.sparkContext.applicationId, sf_dir, "chains") in _BUILT:
        return chains(spark, sf_dir).filter(F.col("chain_id") == DEPLOYMENT_CHAIN)

    def build(s: SparkSession, d: str) -> DataFrame:
        rows = access_to_deployment(access_events(s, d))
        return build_chains(rows.withColumn("chain_id", F.lit(DEPLOYMENT_CHAIN)), order=("event_id",))

    return shared_table(spark, sf_dir, "deployment", build)


def tamper_kind() -> Column:
    return F.when(F.col("chain_id") == "_deployment", 1).otherwise(
        F.conv(F.substring("chain_id", 1, 2), 16, 10).cast("int") % 7
    )


#: Entries of a chain that a join keeps together.
STRETCH = 20_000


def tampered_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with one kind of damage each, at the middle index, by chain id."""
    from chainlake.operators.scan import beside_rows
    from chainlake.session import materialize

    entries = chains(spark, sf_dir)
    counts = materialize(entries.groupBy("chain_id").agg(F.floor(F.count("*") / 2).alias("__m")), "middles")
    # The middle is looked for in its stretch of the chain only, so that no task of a shuffled join gets a whole long
    # chain; sorted again then, because such a join scatters the entries.
    stretch = lambda c: F.floor(F.col(c) / STRETCH).alias("__stretch")
    middles = beside_rows(counts)
    shuffled = middles is counts
    rows = entries.select("*", stretch("index")).join(middles.select("*", stretch("__m")), ["chain_id", "__stretch"], "left")
    rows = rows.sortWithinPartitions("chain_id", "index") if shuffled else rows
    rows = rows.withColumn("__k", F.when(F.col("index") == F.col("__m"), tamper_kind()).otherwise(0))
    rows = rows.filter("__k != 3").withColumns(
        {
            "payload_json": F.when(
                F.col("__k") == 1, F.replace("payload_json", F.lit('"resource":"'), F.lit('"resource":"x'))
            ).otherwise(F.col("payload_json")),
            "prev_hash": F.when(F.col("__k") == 2, F.sha2("entry_hash", 256)).otherwise(F.col("prev_hash")),
            "version": F.when(F.col("__k") == 4, 2).otherwise(F.col("version")),
            "payload_type": F.when(F.col("__k") == 5, 9).otherwise(F.col("payload_type")),
            "__copies": F.when(F.col("__k") == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))),
        }
    )
    return rows.select(*entries.columns, F.explode("__copies").alias("__c")).drop("__c")


# Expected verdict per damaged chain, from entry counts alone.
TAMPERED_SQL = f"""
{PAYLOADS_SQL},
sizes AS (SELECT chain_id, count(*) AS n, count(*) // 2 AS m,
  CASE WHEN chain_id = '_deployment' THEN 1 ELSE CAST('0x' || substr(chain_id, 1, 2) AS INT) % 7 END AS k
  FROM payloads GROUP BY chain_id),
verdicts AS (
  SELECT chain_id, k, n, m,
    n + CASE WHEN k = 3 THEN -1 WHEN k = 6 THEN 1 ELSE 0 END AS entries,
    CASE WHEN k = 0 OR (k = 3 AND m = n - 1) THEN NULL
         WHEN k = 1 THEN 'tampered_entry' WHEN k = 2 AND m = 0 THEN 'invalid_first'
         WHEN k = 2 THEN 'broken_chain' WHEN k IN (3, 6) THEN 'index'
         WHEN k = 4 THEN 'version' ELSE 'payload_type' END AS error,
    CASE WHEN k = 0 THEN n WHEN k = 6 THEN m + 1 ELSE m END AS valid_prefix
  FROM sizes WHERE NOT (k = 3 AND n = 1))"""


def caller_ip() -> Column:
    return F.concat(F.lit("10.0."), F.col("user_id") % 4, F.lit("."), F.col("user_id") % 250)


def caller_credential() -> Column:
    return F.when(F.col("user_id") % 3 == 0, "app_user").otherwise(F.concat(F.lit("dba"), F.col("user_id") % 5))


CALLER_SQL = """'10.0.' || (user_id % 4) || '.' || (user_id % 250) AS source_ip,
  CASE WHEN user_id % 3 = 0 THEN 'app_user' ELSE 'dba' || (user_id % 5) END AS credential"""
SESSION_SQL = _session_sql("user_id || '|' || strftime(ts, '%Y-%m-%d')")
K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def session_id() -> Column:
    return _session(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))


def _format(template: str) -> Column:
    """Template with {u}, {v} (= u + 1), {k} and {e} filled from an event row."""
    text: Column = F.lit(template)
    values = {
        "{u}": F.col("user_id"),
        "{v}": F.col("user_id") + 1,
        "{k}": F.get_json_object("props", "$.k").cast("bigint"),
        "{e}": F.col("event_id"),
    }
    for mark, value in values.items():
        if mark in template:
            text = F.replace(text, F.lit(mark), value.cast("string"))
    return text


def _format_sql(template: str) -> str:
    text = "'" + template.replace("'", "''") + "'"
    values = {"{u}": "user_id", "{v}": "user_id + 1", "{k}": K_SQL, "{e}": "event_id"}
    for mark, value in values.items():
        if mark in template:
            text = f"replace({text}, '{mark}', CAST({value} AS VARCHAR))"
    return text


def by_action(values: dict[str, str], kind: Column | None = None) -> Column:
    out = None
    for event_type, template in values.items():
        cond = (F.col("event_type") if kind is None else kind) == event_type
        out = F.when(cond, _format(template)) if out is None else out.when(cond, _format(template))
    return out


def by_action_sql(values: dict[str, str | None], kind: str = "event_type") -> str:
    return (
        f"CASE {kind} "
        + " ".join(
            f"WHEN '{t}' THEN {'NULL' if v is None else _format_sql(v)}" for t, v in values.items()
        )
        + " END"
    )


STATEMENTS = {
    "view": "SELECT name, u.email FROM users u WHERE u.id = {u} AND status = 'active'",
    "click": "update orders SET note='it''s {k}', qty=-{k} WHERE user_id IN ({u},{v})  and region != 'x;y'",
    "purchase": "SELECT o.id, count(*) AS n FROM public.orders o JOIN users AS u ON u.id = o.user_id "
    "WHERE (o.user_id = {u} OR u.flag IS NOT NULL) AND paid = true GROUP BY o.id ORDER BY n LIMIT 10;",
    "signup": "ALTER TABLE payments ADD COLUMN c{k} int",
    "error": "DELETE FROM messages WHERE sender_id = '{u}' OR recipient_id >= {v} -- {k}",
    "quoted": """SELECT "name", u."email" FROM "users" u WHERE u."id" = {u} AND "o'x" = 'a'""",
    "with": "WITH a AS (SELECT max(x) FROM t WHERE k IN (1, 2)), b (y) AS (SELECT 1) "
    "SELECT users.name FROM users, a WHERE id = {u}",
    "remark": "SELECT email /* it's */ FROM users -- o'clock\nWHERE id = {u}",
    "escape": "SELECT email FROM users WHERE note = E'it\\'s' AND id = {u}",
    "dollar": """SELECT email FROM users WHERE bio = $q$it's "x" $$ /* -- y$q$ AND id = {u} LIMIT 1""",
    "nested": "SELECT email /* a /* b' */ c */ FROM users WHERE id = {u}",
}
#: Some events hold statements of these kinds instead of their type's.
_KINDS = {"quoted": 31, "with": 37, "remark": 41, "escape": 43, "dollar": 47, "nested": 53}
_KIND_SQL = (
    "CASE " + " ".join(f"WHEN event_id % {n} = 0 THEN '{k}'" for k, n in _KINDS.items()) + " ELSE event_type END"
)
BROKEN = "SELECT 'open FROM users WHERE id = {u}"
UTILITY = "SHOW timezone"


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = (
        F.when(F.col("event_id") % 29 == 0, _format(BROKEN))
        .when(F.col("event_id") % 23 == 0, UTILITY)
        .otherwise(by_action(STATEMENTS, F.expr(_KIND_SQL)))
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        event_ms().alias("ts_ms"),
        caller_ip().alias("source_ip"),
        caller_credential().alias("credential"),
        F.lit("postgres").alias("protocol"),
        session_id().alias("session_id"),
        statement.alias("statement"),
    )


def log_case_sql(values: dict[str, str | None], broken: str = "NULL", utility: str = "NULL") -> str:
    """Per-statement expectation: the template's, or what broken and utility statements give."""
    return (
        f"CASE WHEN event_id % 29 = 0 THEN {broken} WHEN event_id % 23 = 0 THEN {utility} "
        f"ELSE {by_action_sql(values, _KIND_SQL)} END"
    )


COMMANDS = {
    "view": '{"find":"users","filter":{"_id":{u},"age":{"$gt":{k}}},"projection":{"name":1,"email":1}}',
    "click": '{"update":"messages","filter":{"$or":[{"sender_id":{u}},{"recipient_id":{"$in":[{u},"{v}"]}}]},'
    '"u":{"seen":true}}',
    "purchase": '{"aggregate":"orders","pipeline":[{"$match":{"a":1}},{"$group":{"_id":"$b"}}],'
    '"filter":{"user_id":"{u}","tags":[1,"b"]}}',
    "signup": '{"createIndexes":"payments","indexes":[{"key":{"a":1}}]}',
    "error": '{"delete":"messages","filter":{"sender_id":{"$eq":{u}},"note":null}}',
}


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = F.when(F.col("event_id") % 9 == 0, '{"ping":1}').otherwise(by_action(COMMANDS))
    return table(spark, sf_dir, "events").select(
        "event_id",
        event_ms().alias("ts_ms"),
        caller_ip().alias("source_ip"),
        caller_credential().alias("credential"),
        F.lit("mongodb").alias("protocol"),
        session_id().alias("session_id"),
        statement.alias("statement"),
    )


_METHODS = {"view": "GET", "click": "PUT", "purchase": "HEAD", "signup": "POST", "error": "DELETE"}


def object_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    path = (
        F.when(e % 19 == 0, "/uploads")
        .when(e % 11 == 0, _format("/uploads/system/f{e}"))
        .when(e % 7 == 0, _format("/media/{u}"))
        .otherwise(_format("/uploads/users/{u}/f{e}.jpg"))
    )
    q = (
        F.when(e % 13 == 0, "uploads=")
        .when(
            e % 5 == 0,
            F.concat(F.lit("X-Amz-Algorithm=A&X-Amz-Credential=AK"), F.col("user_id") % 3, F.lit("%2F2024%2Fr")),
        )
        .otherwise("")
    )
    headers = F.map_filter(
        F.create_map(
            F.lit("x-forwarded-for"),
            F.when(e % 2 == 0, F.concat(caller_ip(), F.lit(" , 1.1.1.1"))),
            F.lit("x-real-ip"),
            F.when(e % 3 == 0, F.lit("10.9.9.9")),
            F.lit("authorization"),
            F.when(
                (e % 5).isin(1, 2),
                F.concat(F.lit("AWS4-HMAC-SHA256 Credential=AK"), F.col("user_id") % 4, F.lit("/2024/r/s3")),
            ),
        ),
        lambda k, v: v.isNotNull(),
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        event_ms().alias("ts_ms"),
        by_action(_METHODS).alias("method"),
        path.alias("path"),
        q.alias("query"),
        headers.alias("headers"),
    )


OBJECT_SQL = f"""
SELECT event_id, user_id, epoch_us(ts) // 1000 AS ts_ms, {by_action_sql(_METHODS)} AS method,
  CASE WHEN event_id % 19 = 0 OR event_id % 11 = 0 THEN 'uploads' WHEN event_id % 7 = 0 THEN 'media'
       ELSE 'uploads' END AS bucket,
  CASE WHEN event_id % 19 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'system/f' || event_id
       WHEN event_id % 7 = 0 THEN CAST(user_id AS VARCHAR)
       ELSE 'users/' || user_id || '/f' || event_id || '.jpg' END AS key,
  CASE WHEN event_id % 13 = 0 THEN 'uploads=' WHEN event_id % 5 = 0 THEN 'presigned' ELSE '' END AS q,
  CASE WHEN event_id % 2 = 0 THEN '10.0.' || (user_id % 4) || '.' || (user_id % 250)
       WHEN event_id % 3 = 0 THEN '10.9.9.9' ELSE '0.0.0.0' END AS source_ip,
  CASE WHEN event_id % 5 IN (1, 2) THEN 'AK' || (user_id % 4)
       WHEN event_id % 5 = 0 AND event_id % 13 != 0 THEN 'AK' || (user_id % 3) END AS credential
FROM events"""
