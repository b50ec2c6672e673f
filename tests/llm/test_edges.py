"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainlake.llm import (
    decontaminate, langid, licenses, line_dedup, pii, piece_bpe, queries, secret_scan, simhash, toxicity, winnowing,
)

LONG = "the rain in Spain falls 12.34.56.78 mainly\n" * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, found int, fp int, item string, host string, h int"
ROWS = [
    (1, "the same words over and over again here", "en", "a", 39, "x", 1, 2, "i", "q", 3),
    (1, "the same words over and over again here", "en", "a", 39, "x", 1, 2, "i", "q", 3),
    (2, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", 1, 2, "i", "q", 3),
    (4, LONG, "en", None, len(LONG), "x", 1, 2, "i", "q", 3),
    (None, "ein Text ohne Nummer", "de", "b", 20, "x", 1, 2, "i", "q", 3),
    (5, "ein Text ohne Nummer", "de", "b", 20, "x", 1, 2, "i", "q", 3),
    (6, "123 456 !!", "de", "b", 10, "x", 1, 2, "i", "q", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, "words over and over again"), (2, None), (3, ""), (None, "ein Text ohne Nummer"), (4, "never seen")],
        "item_id long, text string",
    )


def dictionaries(docs):
    return langid.learn(docs, F.lit(True))


def model():
    return licenses.fit(["plain words of a page", "more plain words", "ein Text ohne Nummer"])


OPERATORS = {
    "licenses": lambda d, b: licenses.scan(d, model()),
    "pii": lambda d, b: pii.scan(d, pii.learn(d)),
    "lines": lambda d, b: line_dedup.dedup(d, F.col("source")),
    "pieces": lambda d, b: piece_bpe.encode(d, queries.model_path()),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "decontaminate": lambda d, b: decontaminate.scan(d, b),
    "spans": lambda d, b: decontaminate.remove_spans(d, b),
    "secrets": lambda d, b: secret_scan.scan(d),
    "language": lambda d, b: langid.identify(d, dictionaries(d)),
    "winnowing": lambda d, b: winnowing.fingerprints(d),
    "winnowing-next": lambda d, b: winnowing.compare_next(d),
    "toxicity": lambda d, b: toxicity.score(d, {5: 1.0, 2**toxicity.BITS: -1.0}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_a_result(docs, bench, name):
    out = OPERATORS[name](docs, bench)
    assert sorted(str(r[0]) for r in out.select("doc_id").collect()) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, bench, name):
    assert OPERATORS[name](docs.limit(0), bench).collect() == []


def test_empty_benchmark(docs, bench):
    assert decontaminate.scan(docs, bench.limit(0)).filter("size(items) > 0").count() == 0
    assert decontaminate.remove_spans(docs, bench.limit(0)).count() == len(ROWS)
    assert decontaminate.drop_documents(docs, bench.limit(0)).count() == len(ROWS)


def test_short_items_are_one_window(docs, bench):
    found = {r.doc_id: r for r in decontaminate.scan(docs, bench).collect()}
    assert found[1].hit_words == [3, 4, 5, 6, 7] and found[1]["items"] == ["1"]
    assert found[5].hit_words == [] and found[2].n_words == 0


def test_removed_spans_leave_the_rest(docs, bench):
    out = {r.doc_id: r for r in decontaminate.remove_spans(docs, bench).collect()}
    assert out[1].text.split() == ["the", "same", "here"]
    assert out[4].text == LONG and out[2].text is None and out[3].text == ""
    kept = decontaminate.drop_documents(docs, bench)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 0 and kept.count() == len(ROWS) - 2


def test_language_of_nothing(docs):
    out = {r.doc_id: r for r in langid.identify(docs, dictionaries(docs)).collect()}
    for i in (2, 3, 6):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    assert out[5].lang_pred == "de"
    assert langid.learn(docs, F.lit(False)) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_train_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none, F.lit(True)) == {}
    assert {r.score for r in toxicity.score(docs, {}).collect()} == {0.5}


def test_labels_with_nulls_and_conflicts(docs, spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    rows = {r.id: r.label for r in toxicity.sample(labels, F.lit(True), "doc_id", "toxic").collect()}
    assert rows == {1: 1, 5: 0}
    assert toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).count() == len(ROWS)


def test_equal_texts_are_one_component(docs):
    out = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert (2, 2) in out and (3, 2) in out and (None, 5) in out and out.count((1, 1)) == 2


def test_line_dedup_cases(spark):
    rows = [(i, "h", f"menu \nown line {i}\n\n menu") for i in range(8)] + [(8, "h", None), (9, None, "menu\nx"), (10, "g", "menu")]
    pages = spark.createDataFrame(rows, "page_id int, host string, text string")
    out = {r.page_id: r.text for r in line_dedup.dedup(pages, F.col("host")).collect()}
    assert out[3] == "own line 3\n" and out[8] is None and out[9] == "menu\nx" and out[10] == "menu"


def test_patterns_of_pages_run_once(spark, sf_dir):
    """The passes over the lines read what the patterns wrote, not the pages again."""
    found = queries.op3_line_dedup(spark, sf_dir)
    assert found.inputFiles() and not any("pages.parquet" in f for f in found.inputFiles())
    assert found.count() == queries.table(spark, sf_dir, "pages").count()


@pytest.mark.parametrize("short, few", [(8_000, 32), (0, -1), (0, 3), (0, 1_000)])
def test_lines_of_pages_are_those_of_the_patterns(spark, monkeypatch, short, few):
    monkeypatch.setattr(line_dedup, "SHORT_PAGE", short)
    monkeypatch.setattr(line_dedup, "FEW_OPENERS", few)
    dice = random.Random(5)
    parts = ["<script", "<SCRIPT>", "</script>", "<style a>", "<style", "</Style>", "<!--", "-->", "<!-->", "<p>", "<", ">",
             " ", "\t", "\n", "text", "\x01", "\x01\x02", "\x01\x03", "İ", "𝔘"]
    pages = ["".join(dice.choice(parts) for _ in range(dice.randrange(1, 30))) for _ in range(3000)] + ["", None]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    out = {r.i: r.t for r in df.select("i", line_dedup.html_lines(F.col("html")).alias("t")).collect()}
    for i, page in enumerate(pages):
        if page is None:
            assert out[i] is None
            continue
        bare = re.sub(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n", page)
        assert out[i] == re.sub(r"[ \t]*\n[ \t\n]*", "\n", re.sub(r"<[^>]*>", "\n", bare)).strip(" ")


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages(docs, spark, sf_dir, number):
    name, stage = corpus_pipeline.STAGES[number]
    real = queries.table(spark, sf_dir, "documents")
    odd = docs.select(*real.columns)
    for table in (odd, odd.limit(0), odd.withColumn("extra", F.lit(1)).withColumn("component_id", F.lit("x"))):
        out = stage(spark, table, sf_dir)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == table.columns
        out.collect()
