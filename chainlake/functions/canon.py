"""Canonical JSON (RFC 8785 member order and escapes, NFC strings, no nulls).

Objects with fixed members are written by ``to_json`` inside the JVM. Spark has no
Unicode normaliser and writes control characters with upper-case hex, so text
outside printable ASCII goes through a small Arrow helper; the others send it a
null.
"""

from __future__ import annotations

import json
import math
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _utf16(name: str) -> bytes:
    return name.encode("utf-16-be", "surrogatepass")


def _number(value: float) -> str:
    """ECMAScript Number-to-String for a finite double."""
    if not math.isfinite(value):
        raise ValueError("non-finite number")
    if value == 0:
        return "0"
    if value < 0:
        return "-" + _number(-value)
    shortest = repr(value)
    digits, _, exp10 = shortest.partition("e")
    whole, _, frac = digits.partition(".")
    frac = "" if frac == "0" else frac
    point = len(whole) + (int(exp10) if exp10 else 0)
    sig = (whole + frac).lstrip("0")
    point -= len(whole + frac) - len(sig)
    sig = sig.rstrip("0")
    if len(sig) <= point <= 21:
        return sig + "0" * (point - len(sig))
    if 0 < point <= 21:
        return sig[:point] + "." + sig[point:]
    if -6 < point <= 0:
        return "0." + "0" * -point + sig
    power = point - 1
    tail = "." + sig[1:] if len(sig) > 1 else ""
    return f"{sig[0]}{tail}e{'+' if power >= 0 else '-'}{abs(power)}"


class CanonError(ValueError):
    pass


def canonical_text(value, path: str = "") -> str:
    """Canonical form of one parsed JSON value; raises with the dotted path of a null."""
    if value is None:
        raise CanonError(f"null at {path or '<root>'}")
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, str):
        return json.dumps(unicodedata.normalize("NFC", value), ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(canonical_text(v, f"{path}[{i}]") for i, v in enumerate(value)) + "]"
    members = {unicodedata.normalize("NFC", k): v for k, v in value.items()}
    return (
        "{"
        + ",".join(
            json.dumps(k, ensure_ascii=False) + ":" + canonical_text(members[k], f"{path}.{k}" if path else k)
            for k in sorted(members, key=_utf16)
        )
        + "}"
    )


_CANONICAL = T.StructType(
    [T.StructField("canonical", T.StringType()), T.StructField("error", T.StringType())]
)


class _Other(Exception):
    """A number that needs more than its digits."""


def _other(_: str):
    raise _Other


def simple_codec() -> tuple:
    """Decoder and encoder of JSON text without fractions; made where they are used, because they can't be sent."""
    decoder = json.JSONDecoder(parse_float=_other, parse_constant=_other)
    return decoder.decode, json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def canonical_json(text: str, codec: tuple) -> str:
    """Canonical form of JSON text.

    ASCII text without escapes, nulls and fractions needs no Unicode rule and only simple numbers, so the
    standard library's encoder gives its canonical form.
    """
    if text.isascii() and "\\" not in text and "null" not in text:
        decode, encode = codec
        try:
            return encode(decode(text))
        except (_Other, RecursionError):
            pass
    return canonical_text(json.loads(text))


@F.arrow_udf(_CANONICAL)
def canonicalize(texts: pa.Array) -> pa.Array:
    """JSON text -> canonical text, or the reason why there is none."""
    if texts.null_count == len(texts):
        canonical = errors = pa.nulls(len(texts), pa.string())
    else:
        canonical, errors, codec = [], [], simple_codec()
        for text in texts.to_pylist():
            try:
                canonical.append(None if text is None else canonical_json(text, codec))
                errors.append(None)
            except ValueError as exc:
                canonical.append(None)
                errors.append(str(exc))
        canonical, errors = pa.array(canonical, pa.string()), pa.array(errors, pa.string())
    return pa.StructArray.from_arrays([canonical, errors], ["canonical", "error"])


def is_plain(json_text: Column) -> Column:
    """True where ``to_json`` output already is canonical text."""
    return json_text.rlike(r"^[\x20-\x7e]*$") & ~json_text.contains("\\u00")


def object_text(members: dict[str, Column]) -> Column:
    """JSON of an object with known member names in canonical order; null members are absent."""
    fields = [members[name].alias(name) for name in sorted(members, key=_utf16)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def with_canonical(df: DataFrame, objects: dict[str, dict[str, Column]], plain_only: bool = False) -> DataFrame:
    """Add a canonical JSON column per entry of ``objects`` (column name -> members).

    The JSON text is a projection of its own, so that testing and using it do not write
    it again. Only text that is not plain goes to the Python helper; ``plain_only`` keeps
    everything in the JVM and fails on such text.
    """
    return with_canonical_text(df, {name: object_text(members) for name, members in objects.items()}, plain_only)


def with_canonical_text(df: DataFrame, texts: dict[str, Column], plain_only: bool = False) -> DataFrame:
    """``with_canonical`` of texts that ``object_text`` makes."""
    staged = df.withColumns({f"__{name}": text for name, text in texts.items()})
    out = {}
    for name in texts:
        text = F.col(f"__{name}")
        if plain_only:
            rest = F.raise_error(F.lit("text needs Unicode normalisation")).cast("string")
        else:
            rest = canonicalize(F.when(~is_plain(text), text))["canonical"]
        out[name] = F.when(is_plain(text), text).otherwise(rest)
    return staged.withColumns(out).drop(*[f"__{name}" for name in texts])


def sorted_map(m: Column) -> Column:
    """Map with entries in name order, nulls dropped, so that ``to_json`` is stable."""
    entries = F.filter(F.map_entries(m), lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.array_sort(entries))


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")
