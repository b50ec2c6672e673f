"""Secret scans: fixed patterns, and literals that are assigned to sensitive names.

The lexer reads assignments of source and configuration syntax (``name = "literal"``,
``name: literal``, ``"name": "literal"``, ``name => 'literal'``, ``name := a + "b"``) into pairs of a
name and an expression of literals and names. A target may be a subscript (``cfg["name"]``), an array
(``name[]``) or carry a type (``name: str =``, Go's ``name string =``); literals may have a prefix
(``f"..."``) or backticks, and those among the arguments of a call (``getenv("A", "...")``) are values of their own.
A value that is a bare name before another operator is read again as a target. Constants are propagated: a name in an expression stands for
the value last assigned to it in the text. A value is scored by how sensitive its target name
is and how much it looks like a secret; a value at or above ``MIN_SCORE`` adds the span of the expression, unless
a span of the fixed patterns covers it.

Null and empty texts have no spans. Repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.llm.common import map_texts

KINDS = ("assign", "access", "hex", "literal")
BASE_KINDS = KINDS[:3]
MIN_SCORE = 1.0

# The patterns of the base spans.
_ASSIGN = re.compile(
    r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEAST = {"assign": 6, "access": 20}

#: Weight of the parts of a target name; the largest one counts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "key": 0.5, "private": 0.6, "credential": 0.9, "credentials": 0.9, "auth": 0.7,
    "bearer": 0.9, "signature": 0.5, "salt": 0.6, "dsn": 0.6, "cookie": 0.6, "session": 0.4,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "example", "password", "secret", "none", "null", "true", "false", "undefined", "redacted"}

_QUOTED = (
    r"""(?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\\n]*+(?:\\.[^`\\\n]*+)*+`)"""
)
_STRING = r"(?:(?:[fFrRbBuU]|[rR][bBfF]|[bBfF][rR]|u8|[L@$])?%s)" % _QUOTED
_TERM = r"(?:%s|[A-Za-z0-9_$][A-Za-z0-9+/_.=~-]*+)" % _STRING
_EXPRESSION = r"%s(?:[ \t]*+\+[ \t]*+%s)*+" % (_TERM, _TERM)
_OPERATOR = r"(?::=|=>|:|=(?![=~]))"
# Types stand between a name and its operator: after a colon, or after a blank as in Go; brackets hold no quotes.
_TYPE = r"[*&?]?(?:\[\w*\]|)[A-Za-z_][\w.]*+(?:<[\w., <>|?\[\]]{0,80}>|\[[\w., |\[\]]{0,80}\])?[?!]?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+"
_TARGET = re.compile(
    r"""(?<![\w.-])([A-Za-z_][\w.-]*+)(?:["'`][ \t]*+\]|["'`]|[ \t]*+\[[ \t]*+[0-9A-Za-z_]*+[ \t]*+\])?"""
    r"""(?:[!?]?[ \t]*+:[ \t]*+(%s)[ \t]*+=(?![=~>])|[ \t]++(%s)[ \t]*+=(?![=~>])|[!?]?[ \t]*+%s)[ \t]*+(?=[A-Za-z0-9_$"'`@])"""
    % (_TYPE, _TYPE, _OPERATOR),
    re.ASCII,
)
_VALUE = re.compile(_EXPRESSION, re.ASCII)
_TERMS = re.compile(_TERM, re.ASCII)
_CALL = re.compile(r"(?:new[ \t]++)?[A-Za-z_][\w.:]*+[!?]?[ \t]*+\(", re.ASCII)
_ARGUMENT = re.compile(r"(?:%s|[A-Za-z_]\w*+|\])[ \t]*+(?::|=(?!=))|%s|[()\n]" % (_STRING, _STRING), re.ASCII)
_AGAIN = re.compile(r"""[ \t]*+(?:\[[^\]\n]{0,80}\][ \t]*+)?%s|[ \t]++%s[ \t]*+=(?![=~>])""" % (_OPERATOR, _TYPE), re.ASCII)
_INNER = re.compile(r"""[A-Za-z_][\w.]*+[ \t]*+\[[ \t]*+["'`]""", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLAIN_NAME = re.compile(r"[A-Za-z_]\w*\Z", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and without overlap within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= _LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST["access"]]
    # Runs of 24 or more are what remains of all runs when shorter ones are dropped.
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def name_weight(name: str) -> float:
    """How sensitive the target of an assignment is."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    return max((SENSITIVE.get(p, 0.0) for p in parts + joined), default=0.0)


def value_weight(value: str) -> float:
    """How much a value looks like a secret: its bits of surprise, 1 at 20 bits."""
    if len(value) < 6 or value.lower() in PLACEHOLDERS or value[0] in "$<{%" or len(set(value)) < 4:
        return 0.0
    counts = {c: value.count(c) for c in set(value)}
    bits = -sum(n * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit))
    return bits / 20 * (0.6 + 0.2 * kinds)


def _content(term: str) -> str | None:
    """What a quoted literal holds; null for other terms."""
    if term[-1] not in "\"'`":
        return None
    return term[term.index(term[-1]) + 1 : -1]


def _resolved(expression: str, constants: dict[str, str]) -> str:
    value = ""
    for term in _TERMS.findall(expression):
        inner = _content(term)
        if inner is not None:
            value += inner
        elif _PLAIN_NAME.match(term) and term in constants:
            value += constants[term]
        else:
            value += term
    return value


def _arguments(text: str, at: int) -> list[tuple[int, int]]:
    """Spans of the literals among the arguments of a call up to the next target; of one that never closes, on its line."""
    out, depth, line = [], 1, None
    for m in _ARGUMENT.finditer(text, at):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
            if not depth:
                return out
        elif m[0] == "\n":
            line = len(out) if line is None else line
        elif m[0][-1] in ":=":
            return out
        else:
            out.append((m.start(), m.end()))
    return out[:line]


def assignments(text: str) -> list[tuple[str, str, int, int]]:
    """(name, value after propagating constants, start, end of the expression) in text order."""
    out, constants, at = [], {}, 0
    while m := _TARGET.search(text, at):
        # Of two words before an operator one is a type, a keyword or a label; the more sensitive one is the name.
        pair, start = [m[1], *filter(None, (m[2], m[3]))], m.end()
        name = max(pair, key=name_weight)
        at = start
        call = _CALL.match(text, start)
        if call:
            # Named arguments are targets of their own, so reading goes on inside.
            for a, b in _arguments(text, call.end()):
                out.append((name, _resolved(text[a:b], constants), a, b))
            at = call.end()
            continue
        value = _VALUE.match(text, start)
        if not value:
            continue
        bare = _PLAIN_NAME.match(value[0])
        if (bare and _AGAIN.match(text, value.end())) or _INNER.match(text, start):
            continue  # the name is a target itself
        resolved = _resolved(value[0], constants)
        constants.update(dict.fromkeys(pair, resolved))
        out.append((name, resolved, start, value.end()))
        at = value.end()
    return out


def literal_spans(text: str, covered: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of values assigned to sensitive names that no span of ``covered`` holds."""
    if "=" not in text and ":" not in text:
        return []
    out = []
    # Of the spans that begin before a place, the one that reaches farthest tells whether any goes beyond it.
    ordered = sorted((a, b) for a, _, b in covered)
    begins, reach = [a for a, _ in ordered], list(accumulate((b for _, b in ordered), max))
    for name, value, start, end in assignments(text):
        weight = name_weight(name)
        if weight and weight * value_weight(value) >= MIN_SCORE:
            before = bisect_left(begins, end)
            if not before or reach[before - 1] <= start:
                out.append((start, 3, end))
    return out


def spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + literal_spans(text, base))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and found: array of (kind, start, end, base) by start, then kind; code points, end exclusive."""
    item = T.StructType(
        [
            T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
        ]
    )

    def run(texts: list[str]) -> list[pa.Array]:
        rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": k < len(BASE_KINDS)} for a, k, b in spans(t)] for t in texts]
        kinds = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        return [pa.array(rows, pa.list_(kinds))]

    slim = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = map_texts(slim, "__text", [T.StructField("found", T.ArrayType(item))], run)
    return found.withColumnRenamed("__id", id_col)
