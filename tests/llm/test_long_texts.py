"""Time in proportion to very long texts, columns with the names that operators use inside, text ids."""

import random
import time

from pyspark.sql import functions as F

from chainlake.llm import langid, licenses, line_dedup, simhash, winnowing

MIT = licenses.TEMPLATES[licenses.FAMILIES[0]][0]


def slow_windows(text):
    """Every hit against all hits after it."""
    out, first = [], 0
    for end in [m.start() for m in licenses._BREAK.finditer(text)] + [len(text)]:
        at = [(m.start(), m.end()) for m in licenses._WORD.finditer(text, first, end)]
        first = end
        words = [text[a:b].lower().encode() for a, b in at]
        places = list(enumerate(zip(words, words[1:])))
        for family, pairs, size in licenses._ALL:
            found = [(i, p) for i, p in places if p in pairs]
            spots = {i for i, _ in found}
            for k, (i, _) in enumerate(found):
                near = [(j, p) for j, p in found[k:] if j + 2 - i <= 2 * size + 10]
                seen = {p for _, p in near}
                last = max(min(j for j, q in near if q == p) for p in seen)
                while last + 1 in spots:
                    last += 1
                if len(seen) >= licenses.MIN_SHARE * len(pairs):
                    out.append((at[i][0], at[last + 1][1], len(seen) / len(pairs), len(pairs), family))
    return out


def test_windows_are_those_of_all_hits():
    dice = random.Random(3)
    known = [t.split() for f in licenses.FAMILIES for t in licenses.TEMPLATES[f]]
    for _ in range(25):
        words = []
        for _ in range(4):
            part = list(dice.choice(known))[: dice.randrange(20, 120)]
            for _ in range(dice.randrange(6)):
                part[dice.randrange(len(part))] = dice.choice(["of", "the", "elsewhere"])
            words += part + ["between"] * dice.randrange(3)
        text = "".join(w + dice.choice([" ", " ", " ", "\n"]) for w in words)
        assert sorted(licenses.windows(text)) == sorted(slow_windows(text))


def seconds(call, value):
    start = time.perf_counter()
    call(value)
    return time.perf_counter() - start


def test_windows_take_time_in_proportion():
    text = (MIT + " ") * (500_000 // len(MIT))
    licenses.windows(text[:10_000])
    half, whole = seconds(licenses.windows, text), seconds(licenses.windows, text * 2)
    assert whole < 3.5 * half + 0.5 and whole < 60


def test_lines_of_pages_take_time_in_proportion(spark):
    parts = [" ", "<script ", "<script>", "<style>", "<!--", "<", " \t", "<script </script "]
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in parts])).alias("part"))
    page = F.concat(F.lit("a"), F.expr("repeat(part, 1000000 div length(part))"), F.lit("z"))
    pages = rows.select(F.explode(F.array(page, F.concat(page, F.lit("</script>")))).alias("html"))
    lengths = pages.select(F.sum(F.length(line_dedup.html_lines(F.col("html")))))
    assert seconds(lambda df: df.collect(), lengths) < 60


INSIDE = ["__h", "__hnull", "__host", "__nohost", "__bp", "__gone", "__text", "__lang", "__score", "__rejected", "__H0"]


def test_columns_with_inside_names_stay(spark):
    texts = ["a line that stands on every page\nown words of page number %d here" % i for i in range(8)]
    rows = [(i, t, "en", "s", *[f"{n}-{i}" for n in INSIDE]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in INSIDE)
    docs = spark.createDataFrame(rows, schema)
    for out in (
        line_dedup.dedup(docs, F.col("source")),
        simhash.drop_near_duplicates(docs),
        langid.drop_rejected(docs, langid.learn(docs, F.lit(True)), min_margin=-1),
    ):
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[n] == f"{n}-{r.doc_id}" for r in kept for n in INSIDE)
    assert all("every page" not in r.text for r in line_dedup.dedup(docs, F.col("source")).collect())


def test_text_ids_follow_each_other(spark):
    rows = [(f"id-{i:03d}", f"words of the text number {i} and some more of them " * 3) for i in range(60)] + [(None, "last")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    numbers = spark.createDataFrame([(i if r[0] else None, r[1]) for i, r in enumerate(rows)], "doc_id long, text string")
    for parts in (1, 4):
        out = {r.doc_id: r[1:] for r in winnowing.compare_next(docs, parts=parts).collect()}
        same = {r.doc_id: r[1:] for r in winnowing.compare_next(numbers, parts=parts).collect()}
        assert out == {None if i is None else f"id-{i:03d}": v for i, v in same.items()}
    assert winnowing.compare_next(docs.filter("doc_id IS NULL"), parts=4).count() == 1
