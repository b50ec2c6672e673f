"""Log-wide fingerprints and statement analysis, as regular-expression projections.

Literals (plain, escape and dollar quotes), quoted identifiers and comments, also nested ones, are
taken out first, from left to right by one pattern, so none of them is looked for inside another. The
patterns after that never meet a quote and stay inside the JVM. This covers
the statement forms an access log needs; it is not a SQL grammar.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions.text import command_action

# Fixed values: (pattern, replacement) steps that bring a statement whose quoted
# literals are already "?" to its canonical spacing. Runs of blanks go first, so that no
# later pattern tries again from each blank of a long run.
NORMALIZE_STEPS = [
    (r"\s+", " "),
    (r"\?+", "?"),
    (r"(?i)\b[exbn]\?", "?"),
    (r"(^|[^A-Za-z0-9_$.\"])[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\b", "$1?"),
    (r"(?i)\b(?:true|false)\b", "?"),
    (r"\s*,\s*", ", "),
    (r"\s*(<>|!=|<=|>=|=|<|>)\s*", " $1 "),
    (r"!=", "<>"),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
    (r"\s+", " "),
    (r"\s*;\s*", "; "),
]
_MARK = "\u0001"
#: Stands around the number of a quoted identifier, so that it reads as a plain name.
_NAME_MARK = "__qid__"
#: Block comments may stand inside others, so deep at most; deeper ones count as left open.
COMMENT_DEPTH = 12


def _block_comment(depth: int) -> str:
    inner = f"|{_block_comment(depth - 1)}" if depth else ""
    return rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*){inner})*+\*/"


# Scanner states. All repetition is possessive or of single characters, which the matcher runs as a
# loop: a part of any length takes time in proportion and no stack. What is left open takes the rest
# of the statement, so no text is scanned twice. A doubled plain quote makes two literals that touch.
_ESCAPE_TEXT = r"""(?<![\w$])[eE]'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+"""
_DOLLAR_TEXT = r"""(?<![\w$])\$((?:[A-Za-z_]\w*+)?)\$[\s\S]*?"""
_COMMENT = _block_comment(COMMENT_DEPTH)
_QUOTED = (
    rf"""{_ESCAPE_TEXT}(?:'|\\?\z)|{_DOLLAR_TEXT}(?:\$\1\$|\z)|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)"""
    rf"""|--[^\n]*+|{_COMMENT}|/\*[\s\S]*+"""
)
#: A quoted part that has an end.
_CLOSED = rf"""\A(?:{_ESCAPE_TEXT}'|{_DOLLAR_TEXT}\$\1\$|'[^']*+'|"[^"]*+"|--[^\n]*+|{_COMMENT})\z"""


def _cut(statement: Column) -> tuple[Column, Column]:
    """(text between quoted parts and comments, those parts)."""
    return F.split(statement, _QUOTED, -1), F.regexp_extract_all(statement, F.lit(_QUOTED), F.lit(0))


def _balanced(quoted: Column) -> Column:
    """Whether no quote or comment is left open; only the last part can be."""
    return F.coalesce(F.try_element_at(quoted, F.lit(-1)).rlike(_CLOSED), F.size(quoted) == 0)


def _is_literal(part: Column) -> Column:
    return part.rlike(r"\A(?:[eE]?'|\$)")


def _rejoin(between: Column, stand_ins: Column) -> Column:
    return F.array_join(F.zip_with(between, stand_ins, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")


def normalize_sql(statement: Column) -> Column:
    """Literals to ``?``, canonical spacing, lower case; unbalanced quotes: lower-cased raw text."""
    between, quoted = _cut(statement)
    text = _rejoin(
        between,
        F.transform(quoted, lambda t: F.when(_is_literal(t), "?").when(t.startswith('"'), t).otherwise(" ")),
    )
    for pattern, replacement in NORMALIZE_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    text = F.ltrim(F.rtrim(text, F.lit("; ")))
    return F.lower(F.when(_balanced(quoted), text).otherwise(statement))


def fingerprint_queries(log: DataFrame, column: str = "statement") -> DataFrame:
    """Add ``query_shape`` and its SHA-256, ``query_fingerprint``."""
    return log.withColumn("query_shape", normalize_sql(F.col(column))).withColumn(
        "query_fingerprint", F.sha2("query_shape", 256)
    )


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when there is no match or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


_NAME = r'[\w."]+'
_TAIL = (
    r"(?:group\s+by|order\s+by|limit|offset|having|returning|union|intersect|except|window|"
    r"fetch|for\s+update)\b"
)
_LITERAL = rf"^(?:-\s*)?(?:[0-9][\w.]*|(?:{_MARK}[0-9]+{_MARK})+|(?i:true|false|null)|\$[0-9]+|\?)$"


def _first_statement(masked: Column) -> Column:
    return F.btrim(F.split_part(masked, F.lit(";"), F.lit(1)), F.lit(" \t\r\n"))


def _nested(depth: int) -> str:
    """Pattern of a pair of parentheses with others inside, down to ``depth``."""
    inner = f"|{_nested(depth - 1)}" if depth else ""
    return rf"\((?:[^()]++{inner})*+\)"


#: One common table expression; its query may hold parentheses six deep.
_CTE = rf"{_NAME}\s*(?:\([^()]*+\)\s*)?as\s*(?:(?:not\s+)?materialized\s*)?{_nested(6)}"
_WITH = rf"(?is)^with\s+(?:recursive\s+)?{_CTE}(?:\s*,\s*{_CTE})*+\s*"


def _put_back(text: Column, mark: str, quoted: Column, of: Callable[[Column], Column] = lambda t: t) -> Column:
    """Put ``of`` the quoted parts in place of their numbers, which stand between two ``mark``."""
    number = lambda x: F.try_to_number(x, F.lit("999999999")).cast("int")
    return F.array_join(
        F.transform(
            F.split(text, mark, -1), lambda x, i: F.when(i % 2 == 0, x).otherwise(of(F.get(quoted, number(x))))
        ),
        "",
    )


def _restore(text: Column, quoted: Column) -> Column:
    """Literals and quoted identifiers as they were written."""
    return _put_back(_put_back(text, _MARK, quoted), _NAME_MARK, quoted)


def _named(text: Column, quoted: Column) -> Column:
    """Identifiers without their quotes."""
    bare = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    return _put_back(text, _NAME_MARK, quoted, bare)


#: A piece of a list up to the next comma outside of parentheses, which may be six deep.
_ITEM = rf"(?:[^,()]++|{_nested(6)}|[()])++"


def _items(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0))
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def analyze_queries(log: DataFrame, column: str = "statement") -> DataFrame:
    """Add action, tables, columns, filters and raw_where of each statement's first part.

    A query after common table expressions counts alone. Unknown statements and unbalanced
    quotes give a null action and empty arrays.
    """
    between, quoted = _cut(F.col(column))

    def stand_in(t: Column, i: Column) -> Column:
        wrap = lambda mark: F.concat(F.lit(mark), i.cast("string"), F.lit(mark))
        return F.when(_is_literal(t), wrap(_MARK)).when(t.startswith('"'), wrap(_NAME_MARK)).otherwise(" ")

    # Patterns try again from each blank of a run, so runs are kept short.
    first = F.regexp_replace(_first_statement(_rejoin(between, F.transform(quoted, stand_in))), r"\s{9,}", " ")
    df = log.withColumns({"__pieces": quoted, "__first": F.when(_balanced(quoted), first).otherwise("")})
    # Anchored, and left as it is before anything but a query, which then gives only an action.
    flat = F.regexp_replace("__first", _WITH + r"(?=select\b)", "")
    for _ in range(3):
        flat = F.regexp_replace(flat, r"(?i)\(\s*select\b[^()]*\)", "(subquery)")
    df = df.withColumn("__text", flat)

    text = F.col("__text")
    verb = F.lower(F.regexp_extract(text, r"^([A-Za-z]+)", 1))
    is_table_ddl = text.rlike(r"(?i)^(?:create(?:\s+(?:temp|temporary|unlogged))?|alter)\s+table\b")
    is_drop = verb == "drop"
    is_set_operation = text.rlike(r"(?i)\b(?:union|intersect|except)\b")
    action = (
        F.when(verb.isin("select", "with"), "read")
        .when(verb.isin("insert", "update"), "write")
        .when(verb == "delete", "delete")
        .when(is_table_ddl | is_drop, "schema_change")
    )
    df = df.withColumns({"action": action, "__verb": verb})

    verb = F.col("__verb")
    reads = (verb == "select") & ~is_set_operation
    from_list = _extract(text, rf"(?is)\bfrom\s+(.*?)(?:\s+(?:where|set|values|{_TAIL[:-2]})\b.*)?$")
    joins = F.regexp_replace(
        from_list, r"(?i)\s+(?:natural\s+)?(?:(?:inner|left|right|full|cross)\s+)?(?:outer\s+)?join\s+", ", "
    )
    joins = F.regexp_replace(joins, r"(?is)\s+(?:on|using)\b.*?(?=,(?![^()]*\))|$)", "")
    target = F.coalesce(
        _extract(text, rf"(?i)^insert\s+into\s+({_NAME}(?:\s+as\s+\w+)?)"),
        _extract(text, rf"(?i)^update\s+(?:only\s+)?({_NAME}(?:\s+(?:as\s+)?(?!set\b)\w+)?)"),
        _extract(
            text,
            rf"(?i)^(?:create(?:\s+\w+)?|alter)\s+table\s+(?:if\s+(?:not\s+)?exists\s+)?(?:only\s+)?({_NAME})",
        ),
        _extract(text, r"(?is)^drop\s+\w+\s+(?:if\s+exists\s+)?(.*?)(?:\s+(?:cascade|restrict))?$"),
    )
    sources = F.when(reads | (verb == "delete"), joins).otherwise(target)

    def table(item: Column) -> Column:
        sub = item.rlike(r"(?i)^\(subquery\)")
        alias = _extract(item, rf"(?i)^(?:\(subquery\)|{_NAME})\s+(?:as\s+)?(\w+)")
        name = _named(F.regexp_extract(item, rf"^({_NAME})", 1), F.col("__pieces"))
        alias = _named(alias, F.col("__pieces"))
        return F.struct(F.when(sub, "(subquery)").otherwise(name).alias("name"), alias.alias("alias"))

    tables = F.filter(
        F.transform(_items(F.coalesce(sources, F.lit(""))), table),
        lambda t: (t["name"] != "") & ((t["name"] != "(subquery)") | t["alias"].isNotNull()),
    )

    selected = _extract(text, r"(?is)^select\s+(?:distinct\s+|all\s+)?(.*?)(?:\s+from\b.*)?$")

    def select_item(item: Column) -> Column:
        aliased = _extract(item, r"(?is)^(.+?)\s+(?:as\s+)?\w+$")
        return (
            F.when(item.rlike(r"^(?:\*|\w+|[\w.]+\.\*)$"), item)
            .when(item.rlike(r"^[\w.]+$"), F.substring_index(item, ".", -1))
            .otherwise(aliased)
        )

    assigned = _extract(text, r"(?is)^update\s.*?\bset\s+(.*?)(?:\s+(?:where|from|returning)\b.*)?$")
    inserted = _extract(text, rf"(?is)^insert\s+into\s+{_NAME}\s*\(([^()]*)\)")
    defined = _extract(text, r"(?is)^create(?:\s+\w+)?\s+table\s[^(]*\((.*)\)")
    first_word = lambda item: _extract(item, r"^\"?([\w.]+)")
    constraint = r"(?i)^(?:primary|foreign|unique|check|constraint|exclude|like)\b"
    columns = (
        F.when(reads, F.transform(_items(selected), select_item))
        .when(verb == "update", F.transform(_items(assigned), first_word))
        .when(verb == "insert", F.transform(_items(inserted), first_word))
        .when(
            verb == "create",
            F.transform(F.filter(_items(defined), lambda d: ~d.rlike(constraint)), first_word),
        )
    )

    where = F.when(
        reads | verb.isin("update", "delete"),
        _extract(text, rf"(?is)\bwhere\s+(.*?)(?:\s+{_TAIL}.*)?$"),
    )

    def literal(value: Column) -> Column:
        value = F.trim(value)
        return F.when(value.rlike(_LITERAL), _restore(value, F.col("__pieces")))

    named = lambda c: _named(c, F.col("__pieces"))

    def predicate(term: Column) -> Column:
        term = F.regexp_replace(F.trim(term), r"^[\s(]+(?!subquery)", "")
        compared = r"(?is)^([\w.]+)\s*(=|<>|!=|<=|>=|<|>)\s*(.*)$"
        listed = r"(?is)^([\w.]+)\s+(?:not\s+)?in\s*\((.*?)\)"
        null_test = r"(?is)^([\w.]+)\s+is\s+(not\s+)?null\b"
        in_values = F.array_compact(
            F.transform(F.split(F.regexp_extract(term, listed, 2), ","), literal)
        )
        operator = F.regexp_extract(term, compared, 2)
        by_list = F.struct(
            named(F.regexp_extract(term, listed, 1)).alias("column"),
            F.lit("IN").alias("operator"),
            F.concat(F.lit("("), F.array_join(in_values, ", "), F.lit(")")).alias("value"),
        )
        by_null = F.struct(
            named(F.regexp_extract(term, null_test, 1)).alias("column"),
            F.when(F.regexp_extract(term, null_test, 2) != "", "IS NOT NULL")
            .otherwise("IS NULL")
            .alias("operator"),
            F.lit(None).cast("string").alias("value"),
        )
        by_value = F.struct(
            named(F.regexp_extract(term, compared, 1)).alias("column"),
            F.when(operator == "!=", "<>").otherwise(operator).alias("operator"),
            literal(F.regexp_replace(F.regexp_extract(term, compared, 3), r"\)+$", "")).alias("value"),
        )
        return (
            F.when(term.rlike(listed) & ~term.rlike(r"(?i)\bin\s*\(\s*(?:subquery|select)"), by_list)
            .when(term.rlike(null_test), by_null)
            .when(term.rlike(compared) & ~term.rlike(r"^[0-9]"), by_value)
        )

    terms = F.split(F.coalesce(where, F.lit("")), r"(?i)\s+(?:and|or)\s+")
    filters = F.array_compact(F.transform(terms, predicate))
    no_strings = F.array().cast("array<string>")
    return df.withColumns(
        {
            "tables": tables,
            "columns": F.transform(
                F.array_compact(F.coalesce(columns, no_strings)),
                lambda c: _restore(_named(c, F.col("__pieces")), F.col("__pieces")),
            ),
            "filters": filters,
            "raw_where": _restore(where, F.col("__pieces")),
        }
    ).drop("__pieces", "__first", "__text", "__verb")


def analyze_commands(log: DataFrame, column: str = "statement") -> DataFrame:
    """Add command, collection, action, columns, filters, filter_json and scope of document commands."""
    text = F.col(column)
    command = F.get(F.json_object_keys(text), 0)
    collection = F.coalesce(_extract(text, r'^\s*\{\s*"[^"]*"\s*:\s*"([^"]*)"'), F.lit("unknown"))
    df = log.withColumns(
        {
            "command": command,
            "collection": collection,
            "action": F.when(command.isNotNull(), command_action(command)),
            "filter_json": F.get_json_object(text, "$.filter"),
            "columns": F.coalesce(
                F.json_object_keys(F.get_json_object(text, "$.projection")), F.array().cast("array<string>")
            ),
            "__stages": F.from_json(F.get_json_object(text, "$.pipeline"), "array<string>"),
        }
    )

    def member(obj: Column, name: Column) -> Column:
        return F.call_function("get_json_object", obj, F.concat(F.lit("$['"), name, F.lit("']")))

    def shown(value: Column) -> Column:
        items = F.from_json(value, "array<string>")
        is_list = value.startswith("[") & items.isNotNull()
        listed = F.concat(F.lit("["), F.array_join(items, ", ", "null"), F.lit("]"))
        nested = value.startswith("{") & F.json_object_keys(value).isNotNull()
        return F.when(value.isNull(), "null").when(is_list, listed).when(~nested, value)

    def predicates(name: Column) -> Column:
        value = member(F.col("filter_json"), name)
        operators = F.json_object_keys(F.when(value.startswith("{"), value))
        nested = F.transform(
            F.filter(operators, lambda o: o.startswith("$")),
            lambda o: F.struct(name.alias("column"), o.alias("operator"), shown(member(value, o)).alias("value")),
        )
        direct = F.array(
            F.struct(name.alias("column"), F.lit("$eq").alias("operator"), shown(value).alias("value"))
        )
        return F.when(operators.isNotNull(), nested).otherwise(direct)

    keys = F.filter(F.json_object_keys("filter_json"), lambda k: ~k.startswith("$"))
    filters = F.coalesce(
        F.flatten(F.transform(keys, predicates)),
        F.array().cast("array<struct<column:string,operator:string,value:string>>"),
    )
    df = df.withColumn("filters", filters)
    described = F.transform(
        "filters",
        lambda f: F.when(f["operator"] == "$eq", f["column"]).otherwise(
            F.concat_ws(" ", f["column"], f["operator"])
        ),
    )
    stages = F.array_compact(F.transform("__stages", lambda s: F.get(F.json_object_keys(s), 0)))

    def part(label: str, values: Column, joiner: str = ", ") -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, joiner)))

    scope = F.concat_ws(
        "; ",
        F.concat(F.lit("collection: "), F.col("collection")),
        part("fields: ", F.col("columns")),
        part("filter: ", described),
    )
    command_scope = F.concat_ws(
        "; ",
        F.concat(F.lit("collection: "), F.col("collection")),
        part("fields: ", F.col("columns")),
        part("filter: ", F.json_object_keys("filter_json")),
        part("pipeline: ", stages, " | "),
    )
    return df.withColumns({"scope": scope, "command_scope": command_scope}).drop("__stages")


def _shape(value):
    if isinstance(value, dict):
        return {k: _shape(v) for k, v in value.items()}
    return ["?"] if isinstance(value, list) else "?"


@F.pandas_udf(T.StringType())
def command_shape(commands: pd.Series) -> pd.Series:
    """Document with its leaves masked, compact, member order kept."""

    def shape(text):
        if text is None:
            return None
        try:
            doc = json.loads(text)
        except ValueError:
            return "{}"
        return json.dumps(_shape(doc), separators=(",", ":"), ensure_ascii=False)

    return commands.map(shape)


def fingerprint_commands(log: DataFrame, column: str = "statement") -> DataFrame:
    """Add ``query_shape`` and ``query_fingerprint`` of document commands."""
    return log.withColumn("query_shape", command_shape(F.col(column))).withColumn(
        "query_fingerprint", F.sha2("query_shape", 256)
    )


def top_fingerprints(events: DataFrame, actor: str = "admin_id") -> DataFrame:
    """Accesses, actors and time span per query shape."""
    return events.groupBy("query_fingerprint").agg(
        F.count("*").alias("accesses"),
        F.countDistinct(actor).alias("actors"),
        F.min("timestamp").alias("first_ms"),
        F.max("timestamp").alias("last_ms"),
    )


# Housekeeping commands that never become events, and commands that
# leave a change record.
INTERNAL_COMMANDS = [
    "ping",
    "hello",
    "isMaster",
    "ismaster",
    "buildInfo",
    "buildinfo",
    "getLog",
    "getFreeMonitoringStatus",
    "saslStart",
    "saslContinue",
    "authenticate",
    "logout",
    "endSessions",
    "killCursors",
    "getMore",
    "whatsmyuri",
    "replSetGetStatus",
    "serverStatus",
    "hostInfo",
    "connectionStatus",
    "currentOp",
    "killOp",
]
MARKER_COMMANDS = [
    "insert",
    "update",
    "delete",
    "findAndModify",
    "findandmodify",
    "drop",
    "dropDatabase",
    "create",
    "createIndexes",
    "dropIndexes",
    "renameCollection",
]


def drop_internal_commands(commands: DataFrame) -> DataFrame:
    return commands.filter(F.col("command").isNotNull() & ~F.col("command").isin(INTERNAL_COMMANDS))


def marker_worthy(commands: DataFrame) -> DataFrame:
    return commands.filter(F.col("command").isin(MARKER_COMMANDS))


def drop_multipart_initiate(requests: DataFrame, complete_only: bool = True) -> DataFrame:
    """Leave out requests that only open a multipart upload."""
    if not complete_only:
        return requests
    opens = (F.col("method") == "POST") & F.coalesce(F.col("query").contains("uploads"), F.lit(False))
    return requests.filter(~opens)
