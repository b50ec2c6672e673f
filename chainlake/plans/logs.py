"""Raw logs: fingerprints, analysis, callers, affected users, access events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions.text import (
    access_key,
    clean_literal,
    command_action,
    object_bucket,
    object_key,
    request_action,
    source_ip,
)
from chainlake.operators import access_log, fingerprint, identity, resolve
from chainlake.plans import fixtures as fx
from chainlake.plans.registry import query

IDENTITY = identity.IdentityConfig(
    app_sources=("10.0.1.1", "10.0.1.5/32", "10.0.2.6", "10.0.3.3"),
    app_credentials={"postgres": ("app_user",), "mongodb": ("app_user",), "s3": ("AK1",)},
)
USER_TABLES = [
    ("users", ["id"]),
    ("orders", ["user_id"]),
    ("messages", ["sender_id", "recipient_id"]),
]
COLLECTIONS = [("users", ["_id"]), ("messages", ["recipient_id", "sender_id"])]
PATTERNS = [
    ("uploads", "^(?:members|(?P<kind>users))/(?P<user_id>[^/]+)/.*"),
    ("media", "^(?P<user_id>[^/]+)"),
    ("*", "([bad"),
]

SHAPES = {
    "view": "select name, u.email from users u where u.id = ? and status = ?",
    "click": "update orders set note = ?, qty = -? where user_id in (?, ?) and region <> ?",
    "purchase": "select o.id, count(*) as n from public.orders o join users as u on u.id = o.user_id "
    "where (o.user_id = ? or u.flag is not null) and paid = ? group by o.id order by n limit ?",
    "signup": "alter table payments add column c{k} int",
    "error": "delete from messages where sender_id = ? or recipient_id >= ?",
    "quoted": """select "name", u."email" from "users" u where u."id" = ? and "o'x" = ?""",
    "with": "with a as (select max(x) from t where k in (?, ?)), b (y) as (select ?) select users.name from users, a where id = ?",
    "remark": "select email from users where id = ?",
    "escape": "select email from users where note = ? and id = ?",
    "dollar": "select email from users where bio = ? and id = ? limit ?",
    "nested": "select email from users where id = ?",
}
SHAPE_SQL = fx.log_case_sql(
    SHAPES, broken=f"lower({fx._format_sql(fx.BROKEN)})", utility="'show timezone'"
)


@query(
    "fingerprint_queries",
    f"SELECT event_id, {SHAPE_SQL} AS query_shape, sha256({SHAPE_SQL}) AS query_fingerprint FROM events",
)
def fingerprint_queries(spark, sf_dir):
    rows = fingerprint.fingerprint_queries(fx.query_log(spark, sf_dir))
    return rows.select("event_id", "query_shape", "query_fingerprint")


@query(
    "top_fingerprints",
    f"""WITH shapes AS (SELECT *, sha256({SHAPE_SQL}) AS query_fingerprint FROM events)
    SELECT query_fingerprint, count(*) AS accesses, count(DISTINCT user_id % 7) AS actors,
      min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms
    FROM shapes GROUP BY query_fingerprint""",
)
def top_fingerprints(spark, sf_dir):
    users = fx.table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 7).alias("admin_id"), fx.event_ms().alias("timestamp")
    )
    shapes = fingerprint.fingerprint_queries(fx.query_log(spark, sf_dir)).select("event_id", "query_fingerprint")
    return fingerprint.top_fingerprints(shapes.join(users, "event_id"))


_TABLES = {
    "view": "users", "click": "orders", "purchase": "public.orders, users", "signup": "payments", "error": "messages",
    "quoted": "users", "with": "users, a", "remark": "users", "escape": "users", "dollar": "users", "nested": "users",
}
_ALIASES = {
    "view": "u", "click": "", "purchase": "o, u", "signup": "", "error": "",
    "quoted": "u", "with": "", "remark": "", "escape": "", "dollar": "", "nested": "",
}
_COLUMNS = {
    "view": "name, email", "click": "note, qty", "purchase": "id, count(*)", "signup": "", "error": "",
    "quoted": "name, email", "with": "name", "remark": "email", "escape": "email", "dollar": "email", "nested": "email",
}
_FILTERS = {
    "view": "u.id = {u} | status = 'active'",
    "click": "user_id IN ({u}, {v}) | region <> 'x;y'",
    "purchase": "o.user_id = {u} | u.flag IS NOT NULL ~ | paid = true",
    "signup": "",
    "error": "sender_id = '{u}' | recipient_id >= {v}",
    "quoted": "u.id = {u} | o'x = 'a'",
    "with": "id = {u}",
    "remark": "id = {u}",
    "escape": "note = E'it\\'s' | id = {u}",
    "dollar": """bio = $q$it's "x" $$ /* -- y$q$ | id = {u}""",
    "nested": "id = {u}",
}
_WHERE = {
    "view": "u.id = {u} AND status = 'active'",
    "click": "user_id IN ({u},{v})  and region != 'x;y'",
    "purchase": "(o.user_id = {u} OR u.flag IS NOT NULL) AND paid = true",
    "signup": None,
    "error": "sender_id = '{u}' OR recipient_id >= {v}",
    "quoted": """u."id" = {u} AND "o'x" = 'a'""",
    "with": "id = {u}",
    "remark": "id = {u}",
    "escape": "note = E'it\\'s' AND id = {u}",
    "dollar": """bio = $q$it's "x" $$ /* -- y$q$ AND id = {u}""",
    "nested": "id = {u}",
}
_ACTIONS = {
    "view": "read", "click": "write", "purchase": "read", "signup": "schema_change", "error": "delete",
    "quoted": "read", "with": "read", "remark": "read", "escape": "read", "dollar": "read", "nested": "read",
}


@query(
    "analyze_queries",
    f"""SELECT event_id, {fx.log_case_sql(_ACTIONS)} AS action, {fx.log_case_sql(_TABLES, "''", "''")} AS tables,
    {fx.log_case_sql(_ALIASES, "''", "''")} AS aliases, {fx.log_case_sql(_COLUMNS, "''", "''")} AS columns,
    {fx.log_case_sql(_FILTERS, "''", "''")} AS filters, {fx.log_case_sql(_WHERE)} AS raw_where FROM events""",
)
def analyze_queries(spark, sf_dir):
    p = fingerprint.analyze_queries(fx.query_log(spark, sf_dir))
    return p.select(
        "event_id",
        "action",
        F.array_join(F.transform("tables", lambda t: t["name"]), ", ").alias("tables"),
        F.array_join(F.transform("tables", lambda t: t["alias"]), ", ").alias("aliases"),
        F.array_join("columns", ", ").alias("columns"),
        F.array_join(
            F.transform(
                "filters",
                lambda f: F.concat_ws(" ", f["column"], f["operator"], F.coalesce(f["value"], F.lit("~"))),
            ),
            " | ",
        ).alias("filters"),
        "raw_where",
    )


_USERS = {
    "view": "{u}", "click": "{u},{v}", "purchase": "{u}", "signup": "", "error": "{u}",
    "quoted": "{u}", "with": "{u}", "remark": "{u}", "escape": "{u}", "dollar": "{u}", "nested": "{u}",
}


@query(
    "resolve_users_sql",
    f"SELECT event_id, {fx.log_case_sql(_USERS, chr(39) * 2, chr(39) * 2)} AS affected_users FROM events",
)
def resolve_users_sql(spark, sf_dir):
    p = resolve.resolve_users_sql(fingerprint.analyze_queries(fx.query_log(spark, sf_dir)), USER_TABLES)
    return p.select("event_id", F.array_join("affected_users", ",").alias("affected_users"))


CLASS_SQL = """
  CASE WHEN src AND cred THEN 'app' WHEN src THEN 'suspicious' ELSE 'admin' END AS caller_class,
  CASE WHEN src AND NOT cred THEN 'app source ' || source_ip || ' used non-app credential ''' || c || ''''
       WHEN cred AND NOT src THEN 'stolen:' || c ELSE c END AS caller"""
CALLS_SQL = f"""calls AS (
  SELECT *, coalesce(credential, 'unknown') AS c,
    source_ip IN ('10.0.1.1', '10.0.1.5', '10.0.2.6', '10.0.3.3') AS src, credential = 'app_user' AS cred
  FROM (SELECT *, {fx.CALLER_SQL} FROM events)), classed AS (SELECT *, {CLASS_SQL} FROM calls)"""


@query("classify_identity", f"WITH {CALLS_SQL} SELECT event_id, caller_class, caller FROM classed")
def classify_identity(spark, sf_dir):
    rows = identity.classify_identity(fx.query_log(spark, sf_dir), IDENTITY)
    return rows.select("event_id", "caller_class", "caller")


@query(
    "classify_identity_credential_mode",
    f"""WITH {CALLS_SQL} SELECT event_id, CASE WHEN cred THEN 'app' ELSE 'admin' END AS caller_class,
    c AS caller FROM calls""",
)
def classify_identity_credential_mode(spark, sf_dir):
    config = identity.IdentityConfig(mode="credential", app_credentials=IDENTITY.app_credentials)
    rows = identity.classify_identity(fx.query_log(spark, sf_dir), config)
    return rows.select("event_id", "caller_class", "caller")


_LABEL_SQL = """CASE caller_class WHEN 'app' THEN {app} WHEN 'suspicious' THEN 'suspicious:' || caller ELSE caller END"""


@query(
    "build_access_events",
    f"""WITH {CALLS_SQL}, parts AS (
      SELECT *, {fx.log_case_sql(_TABLES, "''", "''")} AS t, {fx.log_case_sql(_COLUMNS, "''", "''")} AS cols,
        {fx.log_case_sql(_WHERE)} AS w FROM classed)
    SELECT event_id, {_LABEL_SQL.format(app="'app:' || credential")} AS admin_id,
      coalesce({fx.log_case_sql(_ACTIONS)}, 'read') AS action,
      CASE WHEN t = '' THEN '(utility)' ELSE t END AS resource,
      'columns: ' || CASE WHEN cols = '' THEN '*' ELSE cols END || coalesce('; filter: ' || w, '') AS scope,
      sha256({SHAPE_SQL}) AS query_fingerprint,
      {fx.log_case_sql(_USERS, chr(39) * 2, chr(39) * 2)} AS affected_users,
      epoch_us(ts) // 1000 AS timestamp, {fx.SESSION_SQL} AS session_id, source_ip FROM parts""",
)
def build_access_events(spark, sf_dir):
    rows = access_log.build_access_events(fx.query_log(spark, sf_dir), IDENTITY, USER_TABLES)
    return rows.select(
        "event_id",
        "admin_id",
        "action",
        "resource",
        "scope",
        "query_fingerprint",
        F.array_join("affected_users", ",").alias("affected_users"),
        "timestamp",
        "session_id",
        F.col("metadata")["source_ip"].alias("source_ip"),
    )


_COLLECTION = {"view": "users", "click": "messages", "purchase": "orders", "signup": "payments", "error": "messages"}
_DOC_ACTION = {"view": "read", "click": "write", "purchase": "read", "signup": "schema_change", "error": "delete"}
_DOC_FILTERS = {
    "view": "_id $eq {u} | age $gt {k}",
    "click": "",
    "purchase": "user_id $eq {u} | tags $eq [1, b]",
    "signup": "",
    "error": "sender_id $eq {u} | note $eq null",
}
_DOC_SCOPE = {
    "view": "collection: users; fields: name, email; filter: _id, age $gt",
    "click": "collection: messages",
    "purchase": "collection: orders; filter: user_id, tags",
    "signup": "collection: payments",
    "error": "collection: messages; filter: sender_id, note",
}
_DOC_COMMAND_SCOPE = {
    "view": "collection: users; fields: name, email; filter: _id, age",
    "click": "collection: messages; filter: $or",
    "purchase": "collection: orders; filter: user_id, tags; pipeline: $match | $group",
    "signup": "collection: payments",
    "error": "collection: messages; filter: sender_id, note",
}


def _doc(values: dict, ping: str) -> str:
    return f"CASE WHEN event_id % 9 = 0 THEN {ping} ELSE {fx.by_action_sql(values)} END"


@query(
    "analyze_commands",
    f"""SELECT event_id, {_doc(_COLLECTION, "'unknown'")} AS collection, {_doc(_DOC_ACTION, "'read'")} AS action,
    {_doc(_DOC_FILTERS, "''")} AS filters, {_doc(_DOC_SCOPE, "'collection: unknown'")} AS scope,
    {_doc(_DOC_COMMAND_SCOPE, "'collection: unknown'")} AS command_scope FROM events""",
)
def analyze_commands(spark, sf_dir):
    p = fingerprint.analyze_commands(fx.command_log(spark, sf_dir))
    return p.select(
        "event_id",
        "collection",
        "action",
        F.array_join(
            F.transform("filters", lambda f: F.concat_ws(" ", f["column"], f["operator"], f["value"])), " | "
        ).alias("filters"),
        "scope",
        "command_scope",
    )


_DOC_SHAPES = {
    "view": '{"find":"?","filter":{"_id":"?","age":{"$gt":"?"}},"projection":{"name":"?","email":"?"}}',
    "click": '{"update":"?","filter":{"$or":["?"]},"u":{"seen":"?"}}',
    "purchase": '{"aggregate":"?","pipeline":["?"],"filter":{"user_id":"?","tags":["?"]}}',
    "signup": '{"createIndexes":"?","indexes":["?"]}',
    "error": '{"delete":"?","filter":{"sender_id":{"$eq":"?"},"note":"?"}}',
}
_PING_SHAPE = "'{\"ping\":\"?\"}'"


@query(
    "fingerprint_commands",
    f"""SELECT event_id, {_doc(_DOC_SHAPES, _PING_SHAPE)} AS query_shape,
    sha256({_doc(_DOC_SHAPES, _PING_SHAPE)}) AS query_fingerprint FROM events""",
)
def fingerprint_commands(spark, sf_dir):
    rows = fingerprint.fingerprint_commands(fx.command_log(spark, sf_dir))
    return rows.select("event_id", "query_shape", "query_fingerprint")


_DOC_USERS = {
    "view": "{u}", "click": "{u},{v}", "purchase": "{u}", "signup": "", "error": "{u}",
    "quoted": "{u}", "with": "{u}", "remark": "{u}",
}


@query(
    "resolve_users_doc",
    f"SELECT event_id, {_doc(_DOC_USERS, chr(39) * 2)} AS affected_users FROM events",
)
def resolve_users_doc(spark, sf_dir):
    p = fingerprint.analyze_commands(fx.command_log(spark, sf_dir))
    rows = resolve.resolve_users_doc(p, COLLECTIONS, USER_TABLES)
    return rows.select("event_id", F.array_join("affected_users", ",").alias("affected_users"))


@query(
    "build_doc_events",
    f"""WITH {CALLS_SQL}
    SELECT event_id, caller AS admin_id, {fx.by_action_sql(_DOC_ACTION)} AS action,
      {fx.by_action_sql(_COLLECTION)} AS resource, {fx.by_action_sql(_DOC_SCOPE)} AS scope,
      sha256({fx.by_action_sql(_DOC_SHAPES)}) AS query_fingerprint,
      {fx.by_action_sql(_DOC_USERS)} AS affected_users
    FROM classed WHERE event_id % 9 != 0 AND caller_class = 'admin'""",
)
def build_doc_events(spark, sf_dir):
    rows = access_log.build_doc_events(fx.command_log(spark, sf_dir), IDENTITY, COLLECTIONS, USER_TABLES)
    return rows.select(
        "event_id",
        "admin_id",
        "action",
        "resource",
        "scope",
        "query_fingerprint",
        F.array_join("affected_users", ",").alias("affected_users"),
    )


@query(
    "command_filters",
    f"""SELECT count(*) FILTER (event_id % 9 != 0) AS kept,
      count(*) FILTER (event_id % 9 != 0 AND event_type IN ('click', 'signup', 'error')) AS markers FROM events""",
)
def command_filters(spark, sf_dir):
    p = fingerprint.analyze_commands(fx.command_log(spark, sf_dir))
    kept = fingerprint.drop_internal_commands(p).select(F.lit(1).alias("kept"), F.lit(0).alias("marker"))
    marked = fingerprint.marker_worthy(p).select(F.lit(0).alias("kept"), F.lit(1).alias("marker"))
    return kept.unionByName(marked).agg(F.sum("kept").alias("kept"), F.sum("marker").alias("markers"))


@query(
    "command_action",
    f"""SELECT event_id, {_doc({**_DOC_ACTION, 'purchase': 'read'}, "'read'")} AS action FROM events""",
)
def command_action_query(spark, sf_dir):
    log = fx.command_log(spark, sf_dir)
    return log.select("event_id", command_action(F.json_object_keys("statement")[0]).alias("action"))


@query(
    "object_request_fields",
    f"""WITH o AS ({fx.OBJECT_SQL})
    SELECT event_id, bucket, key, source_ip, credential,
      CASE WHEN q = 'presigned' THEN 'read' WHEN method IN ('PUT', 'POST') THEN 'write'
           WHEN method = 'DELETE' THEN 'delete' ELSE 'read' END AS action FROM o""",
)
def object_request_fields(spark, sf_dir):
    log = fx.object_log(spark, sf_dir)
    return log.select(
        "event_id",
        object_bucket(F.col("path")).alias("bucket"),
        object_key(F.col("path")).alias("key"),
        source_ip(F.col("headers"), "0.0.0.0").alias("source_ip"),
        access_key(F.col("headers")["authorization"], F.col("query")).alias("credential"),
        request_action(F.col("method"), F.col("query")).alias("action"),
    )


_NORMAL_SQL = """CASE WHEN bucket = 'uploads' AND key LIKE 'users/%' THEN 'users/{user_id}/*'
  WHEN bucket = 'media' THEN '{user_id}' ELSE key END"""


@query(
    "fingerprint_requests",
    f"""WITH o AS ({fx.OBJECT_SQL}),
    n AS (SELECT event_id, method || ' /' || bucket || '/' || {_NORMAL_SQL} AS normalized FROM o)
    SELECT event_id, normalized, sha256(normalized) AS query_fingerprint FROM n""",
)
def fingerprint_requests(spark, sf_dir):
    log = fx.object_log(spark, sf_dir).withColumns(
        {"bucket": object_bucket(F.col("path")), "key": object_key(F.col("path"))}
    )
    return resolve.fingerprint_requests(log, PATTERNS).select("event_id", "normalized", "query_fingerprint")


_OBJECT_USERS = """CASE WHEN key LIKE 'users/%' OR bucket = 'media' THEN CAST(user_id AS VARCHAR) ELSE '' END"""


@query(
    "resolve_users_object",
    f"WITH o AS ({fx.OBJECT_SQL}) SELECT event_id, {_OBJECT_USERS} AS affected_users FROM o",
)
def resolve_users_object(spark, sf_dir):
    log = fx.object_log(spark, sf_dir).withColumns(
        {"bucket": object_bucket(F.col("path")), "key": object_key(F.col("path"))}
    )
    rows = resolve.resolve_users_object(log, PATTERNS + [("*", "^system/(?P<user_id>.*)")], ["system/"])
    return rows.select("event_id", F.array_join("affected_users", ",").alias("affected_users"))


@query(
    "build_object_events",
    f"""WITH o AS ({fx.OBJECT_SQL}), c AS (
      SELECT *, coalesce(credential, 'unknown') AS c, coalesce(credential = 'AK1', false) AS cred,
        source_ip IN ('10.0.1.1', '10.0.1.5', '10.0.2.6', '10.0.3.3') AS src,
        CASE WHEN q = 'presigned' THEN 'read' WHEN method IN ('PUT', 'POST') THEN 'write'
             WHEN method = 'DELETE' THEN 'delete' ELSE 'read' END AS action
      FROM o WHERE NOT (method = 'POST' AND q = 'uploads=')), classed AS (SELECT *, {CLASS_SQL} FROM c)
    SELECT event_id, {_LABEL_SQL.format(app="'app'")} AS admin_id, action, bucket || '/' || key AS resource,
      'bucket: ' || bucket || '; key: ' || key || '; action: ' || action AS scope,
      sha256(method || ' /' || bucket || '/' || {_NORMAL_SQL}) AS query_fingerprint,
      {_OBJECT_USERS} AS affected_users FROM classed""",
)
def build_object_events(spark, sf_dir):
    rows = access_log.build_object_events(fx.object_log(spark, sf_dir), IDENTITY, PATTERNS, ["system/"])
    return rows.select(
        "event_id",
        "admin_id",
        "action",
        "resource",
        "scope",
        "query_fingerprint",
        F.array_join("affected_users", ",").alias("affected_users"),
    )


@query(
    "excluded_and_sensitive",
    f"""SELECT count(*) FILTER (t != 'payments') AS kept, count(*) FILTER (t = 'users') AS sensitive
    FROM (SELECT {fx.log_case_sql(_TABLES, "''", "''")} AS t FROM events)""",
)
def excluded_and_sensitive(spark, sf_dir):
    p = fingerprint.analyze_queries(fx.query_log(spark, sf_dir))
    # Both conditions are tested in one analysis of the log.
    kept = resolve.not_excluded(["payments"])
    hit = resolve.is_sensitive({"users": ["email", "phone"], "orders": ["card"]})
    flags = p.select(kept.alias("kept"), hit.alias("sensitive"))
    return flags.agg(F.count_if("kept").alias("kept"), F.count_if("sensitive").alias("sensitive"))


@query(
    "unknown_shapes",
    f"""WITH {CALLS_SQL}, s AS (SELECT *, sha256({SHAPE_SQL}) AS query_fingerprint FROM classed)
    SELECT event_id, query_fingerprint FROM s WHERE caller_class = 'app' AND query_fingerprint NOT IN (
      SELECT query_fingerprint FROM s WHERE caller_class = 'admin' AND event_type IN ('view', 'click'))""",
)
def unknown_shapes(spark, sf_dir):
    """Application statements of shapes no administrator used in reads of users or updates."""
    rows = identity.classify_identity(fingerprint.fingerprint_queries(fx.query_log(spark, sf_dir)), IDENTITY)
    kinds = fx.table(spark, sf_dir, "events").select("event_id", "event_type")
    rows = rows.join(kinds, "event_id")
    known = rows.filter((F.col("caller_class") == "admin") & F.col("event_type").isin("view", "click"))
    app = rows.filter(F.col("caller_class") == "app").select("event_id", "query_fingerprint")
    return resolve.unknown_shapes(app, known)


@query(
    "clean_literal",
    """SELECT event_id, trim(trim(trim(v), ''''), '"') AS cleaned FROM (
      SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '  ''' || user_id || ''' '
        WHEN event_id % 3 = 1 THEN '"' || user_id || '"' ELSE ' ' || user_id END AS v FROM events)""",
)
def clean_literal_query(spark, sf_dir):
    e = F.col("event_id")
    uid = F.col("user_id").cast("string")
    v = (
        F.when(e % 3 == 0, F.concat(F.lit("  '"), uid, F.lit("' ")))
        .when(e % 3 == 1, F.concat(F.lit('"'), uid, F.lit('"')))
        .otherwise(F.concat(F.lit(" "), uid))
    )
    return fx.table(spark, sf_dir, "events").select("event_id", clean_literal(v).alias("cleaned"))
