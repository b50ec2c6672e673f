"""Which end users does an access touch?

Table, collection and key-pattern settings are short lists from a config file. They
enter the plan as literals, so every resolver is a narrow projection.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions.text import clean_literal, strip_qualifier, unqualified

UserTables = list[tuple[str, list[str]]]


def _settings(tables: UserTables) -> Column:
    return F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.array(*[F.lit(c) for c in columns]).alias("columns"))
            for name, columns in tables
        ]
    )


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def resolve_users_sql(parsed: DataFrame, tables: UserTables) -> DataFrame:
    """Add ``affected_users`` from ``tables`` and ``filters`` of analysed statements.

    First-seen order, distinct, case-sensitive. An unqualified filter counts for every
    table of the statement.
    """
    settings = _settings(tables)

    def user_columns(table: Column) -> Column:
        def matches(s: Column) -> Column:
            return (
                (s["name"] == table["name"])
                | (table["name"].contains(".") & (s["name"] == unqualified(table["name"])))
                | (~table["name"].contains(".") & (unqualified(s["name"]) == table["name"]))
            )

        return F.try_element_at(F.filter(settings, matches), F.lit(1))["columns"]

    def values(f: Column) -> Column:
        listed = F.split(F.regexp_replace(f["value"], r"^\(+|\)+$", ""), ",")
        return (
            F.when(f["operator"] == "=", F.array(clean_literal(f["value"])))
            .when(f["operator"] == "IN", F.transform(listed, clean_literal))
            .otherwise(_no_strings())
        )

    def of_table(table: Column) -> Column:
        columns = user_columns(table)
        relevant = F.filter(
            "filters",
            lambda f: f["value"].isNotNull()
            & F.array_contains(columns, strip_qualifier(f["column"], table["alias"], table["name"])),
        )
        return F.when(columns.isNull(), _no_strings()).otherwise(F.flatten(F.transform(relevant, values)))

    users = F.flatten(F.transform("tables", of_table))
    return parsed.withColumn(
        "affected_users", F.array_distinct(F.filter(users, lambda u: u != ""))
    )


def _leaf_values(value) -> list[str]:
    if isinstance(value, bool) or value is None or isinstance(value, float):
        return []
    if isinstance(value, (int, str)):
        return [str(value)]
    if isinstance(value, list):
        return [x for item in value for x in _leaf_values(item)]
    if isinstance(value.get("$oid"), str):
        return [value["$oid"]]
    out = _leaf_values(value["$eq"]) if "$eq" in value else []
    if isinstance(value.get("$in"), list):
        out += _leaf_values(value["$in"])
    return out


def _field_values(doc: dict) -> list[tuple[str, str]]:
    pairs = [
        (name, v) for name, value in doc.items() if name not in ("$and", "$or") for v in _leaf_values(value)
    ]
    for name in ("$and", "$or"):
        if isinstance(doc.get(name), list):
            for part in doc[name]:
                if isinstance(part, dict):
                    pairs += _field_values(part)
    return pairs


_PAIRS = T.ArrayType(
    T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])
)


@F.pandas_udf(_PAIRS)
def filter_pairs(filters: pd.Series) -> pd.Series:
    """Equality values of a document filter by field, outer level before nested ones."""

    def pairs(text):
        if text is None:
            return None
        try:
            doc = json.loads(text)
        except ValueError:
            return []
        if not isinstance(doc, dict):
            return []
        return [{"field": f, "value": v} for f, v in _field_values(doc)]

    return filters.map(pairs)


def resolve_users_doc(
    commands: DataFrame, collections: UserTables, tables: UserTables | None = None
) -> DataFrame:
    """Add ``affected_users`` from ``collection`` and ``filter_json``.

    ``collections`` settings come first; ``tables`` are the fallback.
    """
    settings = _settings(collections + (tables or []))
    fields = F.try_element_at(
        F.filter(settings, lambda s: s["name"] == F.col("collection")), F.lit(1)
    )["columns"]
    # Only filters of configured collections go to the Python helper.
    with_pairs = commands.withColumn(
        "__pairs", filter_pairs(F.when(fields.isNotNull(), F.col("filter_json")))
    )
    users = F.flatten(
        F.transform(
            fields,
            lambda name: F.transform(
                F.filter("__pairs", lambda p: p["field"] == name), lambda p: p["value"]
            ),
        )
    )
    return with_pairs.withColumn(
        "affected_users", F.coalesce(F.array_distinct(users), _no_strings())
    ).drop("__pairs")


def valid_patterns(patterns: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(bucket, regex, number of the user_id group) of the patterns that compile.

    Java group names allow no underscore, so groups are addressed by number. The group before
    user_id holds the rest of the key from there on, whatever the pattern: it stands in a lookahead,
    so it matches wherever user_id is tried, also inside alternatives and other groups.
    """
    out = []
    for bucket, pattern in patterns:
        try:
            compiled = re.compile(re.sub(r"\(\?<(?=\w+>)", "(?P<", pattern))
        except re.error:
            continue
        number = compiled.groupindex.get("user_id")
        if number is None:
            continue

        def later(at: int) -> int:
            return at + (at >= number)

        names = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{compiled.groupindex[m[1]]}", compiled.pattern)
        moved = re.sub(r"\\([1-9]\d?|[\s\S])", lambda m: f"\\{later(int(m[1]))}" if m[1].isdigit() and m[1] != "0" else m[0], names)
        marked = moved.replace("(?P<user_id>", r"(?=([\s\S]*))(?P<user_id>")
        out.append((bucket, re.sub(r"\(\?P<\w+>", "(", marked), number + 1))
    return out


def _bucket_matches(bucket: str) -> Column:
    return F.lit(True) if bucket == "*" else F.col("bucket") == bucket


def is_excluded(key: Column, prefixes: list[str]) -> Column:
    """Object key starts with one of the excluded prefixes."""
    out = F.lit(False)
    for prefix in prefixes:
        out = out | F.startswith(key, F.lit(prefix))
    return F.coalesce(out, F.lit(False))


def resolve_users_object(
    requests: DataFrame, patterns: list[tuple[str, str]], excluded_prefixes: list[str] = ()
) -> DataFrame:
    """Add ``affected_users`` from ``bucket`` and ``key`` by (bucket or ``*``, regex) patterns."""
    found = [
        F.when(
            _bucket_matches(bucket) & F.col("key").rlike(regex),
            F.regexp_extract("key", regex, group),
        )
        for bucket, regex, group in valid_patterns(patterns)
    ]
    users = F.array_distinct(F.array_compact(F.array(*found))) if found else _no_strings()
    return requests.withColumn(
        "affected_users",
        F.when(is_excluded(F.col("key"), list(excluded_prefixes)), _no_strings()).otherwise(users),
    )


def fingerprint_requests(requests: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Add ``normalized`` and ``query_fingerprint`` of object requests (method, bucket, key).

    The first matching pattern replaces the user id and everything after it.
    """
    normalized = F.lit(None).cast("string")
    for bucket, regex, group in reversed(valid_patterns(patterns)):
        user = F.regexp_extract("key", regex, group)
        prefix = F.left("key", F.length("key") - F.length(F.regexp_extract("key", regex, group - 1)))
        more = F.length(prefix) + F.length(user) < F.length("key")
        text = F.concat(prefix, F.lit("{user_id}"), F.when(more, "/*").otherwise(""))
        normalized = F.when(_bucket_matches(bucket) & F.col("key").rlike(regex), text).otherwise(normalized)
    normalized = F.concat(
        F.col("method"), F.lit(" /"), F.col("bucket"), F.lit("/"), F.coalesce(normalized, F.col("key"))
    )
    return requests.withColumn("normalized", normalized).withColumn(
        "query_fingerprint", F.sha2("normalized", 256)
    )


def _keep(parsed: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on analysed columns.

    Spark moves a plain filter below the projections that analyse a statement and repeats their patterns
    inside it for every use; a row generated for each one kept stays above them.
    """
    return parsed.withColumn("__kept", F.explode(F.when(condition, F.array(F.lit(True))))).drop("__kept")


def not_excluded(excluded: list[str]) -> Column:
    """Whether an analysed statement has no table, or one that is not excluded."""
    names = F.array(*[F.lit(n) for n in excluded]).cast("array<string>")
    touched = F.exists("tables", lambda t: ~F.array_contains(names, unqualified(t["name"])))
    return (F.size("tables") == 0) | touched


def is_sensitive(sensitive: dict[str, list[str]]) -> Column:
    """Whether an analysed statement reads or writes a column listed as sensitive for one of its tables."""
    settings = _settings(sorted(sensitive.items()))

    def hits(table: Column) -> Column:
        columns = F.try_element_at(
            F.filter(settings, lambda s: s["name"] == unqualified(table["name"])), F.lit(1)
        )["columns"]
        return F.coalesce(
            F.exists("columns", lambda c: (c == "*") | F.array_contains(columns, unqualified(c)))
            & columns.isNotNull(),
            F.lit(False),
        )

    return F.exists("tables", hits)


def excluded_tables(parsed: DataFrame, excluded: list[str]) -> DataFrame:
    """Drop statements all of whose tables are excluded."""
    return _keep(parsed, not_excluded(excluded)) if excluded else parsed


def sensitive_access(parsed: DataFrame, sensitive: dict[str, list[str]]) -> DataFrame:
    """Statements that read or write a column listed as sensitive for one of their tables."""
    return _keep(parsed, is_sensitive(sensitive))


def unknown_shapes(app_events: DataFrame, known: DataFrame) -> DataFrame:
    """Application statements whose fingerprint is not one of the known shapes."""
    return app_events.join(known.select("query_fingerprint").distinct(), "query_fingerprint", "left_anti")


def unlisted_predicates(events: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Statements without a user (event_id, table_name, raw_where) that strict resolution can't judge."""
    listed = F.coalesce(F.col("raw_where").isin(list(predicates)), F.lit(False))
    return events.filter((F.size("affected_users") == 0) & ~listed).select("event_id", "table_name", "raw_where")


def resolution_policy(
    events: DataFrame,
    snapshot: DataFrame,
    policy: str,
    predicates: dict[str, str] | None = None,
) -> DataFrame:
    """Attribute statements that name no user, by table (opt-in: output is table-sized).

    ``events``: event_id, table_name, action, is_aggregation, raw_where, affected_users.
    ``snapshot``: table_name, user_id and the columns predicates use. ``conservative``
    gives a read to every user of its table; ``aggregation_aware`` first drops pure
    aggregates; ``strict`` gives it to the users that satisfy ``raw_where``, with
    ``predicates`` mapping each distinct raw_where to a Spark predicate; what is not in it
    gives no row here and is named by ``unlisted_predicates``.
    """
    links, users, keys = _classes(events, snapshot, policy, predicates)
    return links.join(users, keys).select("event_id", "user_id")


def attribution_classes(
    events: DataFrame, snapshot: DataFrame, policy: str, predicates: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """What ``resolution_policy`` says, without a row for each event and user.

    Statements of one table, and with ``strict`` of one raw_where, form a class: (event_id and the
    columns of its class), (columns of the class, user_id, events). The second has the users of every class that occurs,
    with the number of statements that name each of them.
    """
    links, users, keys = _classes(events, snapshot, policy, predicates)
    counts = links.groupBy(*keys).agg(F.count("*").alias("events"))
    return links, users.join(counts, keys)


def attribution_counts(
    events: DataFrame, snapshot: DataFrame, policy: str, predicates: dict[str, str] | None = None
) -> DataFrame:
    """Attributions and attributed events by table: what ``resolution_policy`` gives, counted.

    Every statement of a class names every user of it, so the rows are statements times users of the
    class and are not made; work grows with events and snapshot.
    """
    links, users, keys = _classes(events, snapshot, policy, predicates)
    named = users.groupBy(*keys).agg(F.count("*").alias("__users"))
    attributed = links.join(named, keys)
    return attributed.groupBy("table_name").agg(
        F.sum("__users").alias("attributions"), F.countDistinct("event_id").alias("events")
    )


def _classes(events, snapshot, policy, predicates):
    """(event_id and class of open statements, class and user_id, columns of a class)."""
    open_events = events.filter(F.size("affected_users") == 0)
    if policy == "strict":
        if not predicates:
            raise ValueError("strict resolution needs predicates")
        # One scan of the snapshot tests all predicates.
        met = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(raw)) for raw, p in sorted(predicates.items())]))
        users = snapshot.select("table_name", "user_id", F.explode(met).alias("raw_where")).distinct()
        keys = ["table_name", "raw_where"]
        return open_events.select("event_id", *keys), users, keys
    reads = open_events.filter(F.col("action") == "read")
    if policy == "aggregation_aware":
        reads = reads.filter(~F.col("is_aggregation"))
    elif policy != "conservative":
        raise ValueError(f"unknown policy {policy}")
    keys = ["table_name"]
    return reads.select("event_id", *keys), snapshot.select("table_name", "user_id").distinct(), keys
