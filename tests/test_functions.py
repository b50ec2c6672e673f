"""Digests, canonical text and small text functions against plain Python."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from chainlake.functions import canon, crypto, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("salt", ["s", "test-salt", "x" * 64, "y" * 65, "ключ"])
def test_hmac_matches_python(spark, salt):
    values = ["", "42", "user@example.com", "ünïcode"]
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    rows = df.select(
        "v",
        crypto.hmac_sha256_hex(salt, F.col("v")).alias("a"),
        crypto.hmac_sha256_closure(salt)("v").alias("b"),
    ).collect()
    for r in rows:
        want = hmac.new(salt.encode(), r["v"].encode(), hashlib.sha256).hexdigest()
        assert r["a"] == r["b"] == want


def test_closure_keeps_the_salt_out_of_the_plan(spark):
    df = spark.range(1).select(crypto.hmac_sha256_closure("very-secret")(F.lit("u")))
    plan = df._jdf.queryExecution().toString()
    inner, outer = (p.hex() for p in crypto.hmac_pads("very-secret"))
    assert "very-secret" not in plan and inner not in plan.lower() and outer not in plan.lower()


def test_worked_example(spark):
    payload = (
        '{"action":"read","actor_id":"app:app_user","actor_label":"app:app_user","actor_type":"app",'
        '"affected_user_ids":["a1b2c3"],"protocol":"postgres","query_fingerprint":"' + "0" * 64 + '",'
        '"query_shape":"SELECT * FROM users WHERE id = $1","resource":"users","scope":{"bytes":256,"rows":1},'
        '"session_id":"d1e2f3a4-0000-0000-0000-000000000000","source_ip":"10.0.1.5"}'
    )
    parts = [F.lit(1), F.lit(0), F.lit(0x65F0E600), F.lit("0" * 64), F.lit(1), F.lit(payload)]
    assert len(payload) == 406
    assert one(spark, F.octet_length(crypto.envelope(*parts))) == 460
    assert (
        one(spark, crypto.entry_hash(*parts))
        == "4fbb782dc3b1850bf5a46e2f44f7b18ff8248abd0de6574998f6f60a80ead022"
    )
    members = {
        k: F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) if isinstance(v, list) else
        F.struct(*[F.lit(x).alias(n) for n, x in sorted(v.items())])
        for k, v in json.loads(payload).items()
    }
    assert canon.with_canonical(spark.range(1), {"c": members}).first()["c"] == payload


def test_negative_timestamp_envelope(spark):
    parts = [F.lit(1), F.lit(0), F.lit(-1), F.lit("0" * 64), F.lit(2), F.lit("{}")]
    got = bytes(one(spark, crypto.envelope(*parts)))
    assert got[9:17] == b"\xff" * 8 and got[-2:] == b"{}" and len(got) == 56


CANON_CASES = [
    ('{"b":1,"a":2}', '{"a":2,"b":1}'),
    ('{"é":"é"}', '{"é":"é"}'),
    ('{"é":1}', '{"é":1}'),
    ('{"x":"\\u001f\\n\\t\\"\\\\ \\/"}', '{"x":"\\u001f\\n\\t\\"\\\\ /"}'),
    # UTF-16 order: the surrogate pair sorts before U+FF5E.
    ('{"\uff5e":1,"\U0001f600":2}', '{"\U0001f600":2,"\uff5e":1}'),
    ('{"n":[1.0,1e21,1e-7,0.5,-0.0,123456789.25,1e20,5e-324]}',
     '{"n":[1,1e+21,1e-7,0.5,0,123456789.25,100000000000000000000,5e-324]}'),
    ('{"t":true,"f":false,"o":{}}', '{"f":false,"o":{},"t":true}'),
]


def test_canonical_text(spark):
    df = spark.createDataFrame(CANON_CASES, "raw STRING, want STRING")
    for r in df.select("want", canon.canonicalize("raw").alias("c")).collect():
        assert r["c"]["canonical"] == r["want"] and r["c"]["error"] is None


def test_nulls_are_refused_with_their_path(spark):
    cases = [("null", "null at <root>"), ('{"a":{"b":null}}', "null at a.b"), ('{"a":[1,null]}', "null at a[1]"),
             ("[null]", "null at [0]")]
    df = spark.createDataFrame(cases, "raw STRING, want STRING")
    for r in df.select("want", canon.canonicalize("raw").alias("c")).collect():
        assert r["c"]["error"] == r["want"] and r["c"]["canonical"] is None


def test_jvm_and_python_forms_agree(spark):
    values = ["plain", "tab\there", "bell\u0007", "é", 'quo"te', "back\\slash", "\u007f", "日本", "\u0000"]
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    rows = canon.with_canonical(df, {"c": {"v": F.col("v"), "gone": F.lit(None).cast("string")}}).collect()
    for r in rows:
        assert r["c"] == canon.canonical_text({"v": r["v"]})


def test_plain_only_fails_on_other_text(spark):
    df = spark.createDataFrame([("é",)], "v STRING")
    with pytest.raises(Exception, match="normalisation"):
        canon.with_canonical(df, {"c": {"v": F.col("v")}}, plain_only=True).collect()


def test_seconds_floor_below_zero(spark):
    df = spark.createDataFrame([(-1,), (-1000,), (-1001,), (0,), (999,), (1000,)], "ms BIGINT")
    got = [r[0] for r in df.select(text.ms_to_seconds(F.col("ms"))).collect()]
    assert got == [-1, -1, -2, 0, 0, 1]


def test_percent_decode_keeps_plus(spark):
    assert one(spark, text.percent_decode(F.lit("a+b%2Fc"))) == "a+b/c"


def test_access_key_sources(spark):
    header = "AWS4-HMAC-SHA256 Credential=AK_1-x/2024/r, SignedHeaders=host"
    assert one(spark, text.access_key(F.lit(header), F.lit(""))) == "AK_1-x"
    assert one(spark, text.access_key(F.lit(None).cast("string"), F.lit("a=1&X-Amz-Credential=K%2F2024&b=2"))) == "K"
    assert one(spark, text.access_key(F.lit("Basic x"), F.lit("X-Amz-Credential=K"))) is None


def test_reason_is_cut_on_characters(spark):
    assert one(spark, text.truncate_reason(F.lit("é" * 300))) == "é" * 256 + "…"
    assert one(spark, text.truncate_reason(F.lit("ok"))) == "ok"


def test_bucket_and_key(spark):
    for path, bucket, key in [("/b/k/x", "b", "k/x"), ("//b/k", "b", "k"), ("/b", "b", ""), ("/b/", "b", "")]:
        assert one(spark, text.object_bucket(F.lit(path))) == bucket
        assert one(spark, text.object_key(F.lit(path))) == key
