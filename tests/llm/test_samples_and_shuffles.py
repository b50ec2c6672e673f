"""Samples that copies don't change, and the shuffle path of large window sets."""

import time

import pytest
from pyspark.sql import functions as F

from chainlake.llm import common, decontaminate, pii, queries, toxicity


def test_copies_do_not_change_a_sample(spark):
    rows = spark.range(300).select(F.concat(F.lit("text "), F.col("id")).alias("t"))
    copies = rows.union(spark.range(20_000).select(F.lit("text 7")))
    want = common.least_different(rows, F.col("t"), F.col("t"), 50)
    assert len(set(want)) == 50 and common.least_different(copies, F.col("t"), F.col("t"), 50) == want
    one = spark.range(50_000).select(F.lit("call +1 202 555 0100 now").alias("text"))
    assert common.least_different(one, F.col("text"), F.col("text"), 50) == ["call +1 202 555 0100 now"]
    assert pii.learn(one).unary.any() and not pii.learn(one.limit(0)).unary.any()


def test_sample_of_texts_without_blanks_is_linear(spark):
    def seconds(n):
        text = spark.createDataFrame([("x" * n + " mail a@b.cc " + "y" * n,)], "text string")
        start = time.time()
        pii.learn(text)
        return time.time() - start

    seconds(100)
    assert seconds(1_000_000) < 20


def test_sample_of_texts_of_many_words_is_linear(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "least_different", lambda rows, key, value, size: seen.extend(r[0] for r in rows.select(value).collect()) or [])
    pii.learn(spark.createDataFrame([("a b c d mail x@y.zz e f g h 7 i",), (" +1  b",)], "text string"))
    assert seen == ["c d mail x@y.zz e f g h 7 i", "+1  b"]
    long = spark.createDataFrame([("the rain in Spain falls 12.34.56.78 mainly\n" * 4000,)], "text string")
    start = time.time()
    pii.learn(long)
    assert time.time() - start < 20 and len(seen[-1]) == pii.SAMPLE_CHARS


def test_a_repeated_id_teaches_once(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    once = spark.createDataFrame([(1, "awful words here"), (2, "kind words here")], "doc_id long, text string")
    many = once.union(spark.range(500).select(F.lit(1).cast("long"), F.concat(F.lit("b later text "), F.col("id"))))
    assert toxicity.train(many, labels, F.lit(True)) == toxicity.train(once, labels, F.lit(True))


@pytest.mark.parametrize("form", ["scan", "spans", "documents"])
def test_windows_that_are_not_broadcast(spark, sf_dir, form):
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").union(
        spark.createDataFrame([(None, None), (None, ""), (1, "a b"), (1, "a b"), (None, "never seen words")], "doc_id long, text string")
    )
    bench = queries.table(spark, sf_dir, "benchmark").select("item_id", "text").union(
        spark.createDataFrame([(None, "x y"), (9_000, None), (9_001, "never seen")], "item_id long, text string")
    )
    apply = {"scan": decontaminate.scan, "spans": decontaminate.remove_spans, "documents": decontaminate.drop_documents}[form]
    wide = apply(docs, bench, broadcast_windows=0)
    assert sorted(map(str, wide.collect())) == sorted(map(str, apply(docs, bench).collect()))
