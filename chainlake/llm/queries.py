"""One query per operator over the driver tables, with the SQL that checks it where SQL can."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm import (
    collocations, decontaminate, langid, licenses, line_dedup, pii, piece_bpe, secret_scan, simhash, substring_dedup, toxicity,
    whitening, winnowing,
)
from chainlake.llm.common import crc_fold, digest, sha256_of
from chainlake.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    """The public model file of the installed tokenizer package."""
    public_tokenizers = importlib.import_module("public_tokenizers")
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.learn(docs))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licenses"),
        F.array_join(families, ",").alias("families"), F.array_join(spans, ",").alias("spans"),
    )


def op2_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(pii.scan(docs, pii.learn(docs)), "doc_id", pii.KINDS)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", line_dedup.html_lines(F.col("html")).alias("text"))
    # Lines are read three times, and their patterns cost far more than the rest.
    pages = materialize(pages, "page-lines")
    host = F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1)
    found = line_dedup.dedup(pages, host, counts=True)
    return found.select(
        "page_id", host.alias("host"), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text"
    )


OP3_SQL = rf"""
WITH cleaned AS (
  SELECT page_id, coalesce(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), '') AS host, url IS NULL AS nohost,
         trim(regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', chr(10), 'g'),
           '(?s)<[^>]*>', chr(10), 'g'), '[ \t]*\n[ \t\n]*', chr(10), 'g')) AS text
  FROM pages
), numbered AS (SELECT row_number() OVER () AS r, * FROM cleaned),
pieces AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM numbered),
rows_ AS (SELECT r, host, nohost, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM pieces),
totals AS (SELECT host, nohost, count(*) AS pages FROM numbered GROUP BY ALL),
often AS (
  SELECT host, nohost, line FROM (
    SELECT host, nohost, trim(line) AS line, count(DISTINCT r) AS n FROM rows_ WHERE trim(line) <> '' GROUP BY ALL)
  JOIN totals USING (host, nohost)
  WHERE n > greatest(pages * {line_dedup.MAX_RATIO}, {line_dedup.MIN_PAGES - 1})
), marked AS (
  SELECT r, i, rows_.line, often.line IS NOT NULL AS gone FROM rows_
  LEFT JOIN often ON rows_.host = often.host AND rows_.nohost = often.nohost AND trim(rows_.line) = often.line
), kept AS (
  SELECT r, count(*) FILTER (trim(line) <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY r
)
SELECT page_id, CASE WHEN nohost THEN NULL ELSE host END AS host, n_lines, n_dropped,
       CASE WHEN numbered.text IS NULL THEN NULL ELSE kept.text END AS text
FROM numbered JOIN kept USING (r)
"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_digest(piece_bpe.encode(docs, model_path()))


def token_digest(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256_of(F.col("ids").cast("array<string>")).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _FOLD + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(len(w), {decontaminate.WINDOW}) AS n, array_to_string(w[i : i + {decontaminate.WINDOW - 1}], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - {decontaminate.WINDOW - 2}))) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM grams),
spots AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT r, i, n, item_id FROM spots JOIN grams USING (n, gram)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan.scan(table(spark, sf_dir, "documents")), "doc_id", secret_scan.BASE_KINDS)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 4)
    found = langid.identify(docs, langid.learn(docs, fold != 2))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_next(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 5)
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.score(docs, weights).select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = found.select(
        "vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened")
    )
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(unnest(p), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
spots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, {collocations.LONGEST} + 1)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, list_slice(w, i, i + k - 1) AS g, k, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
cuts AS (SELECT lang, g, k, f AS a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
cut AS (SELECT cuts.lang, cuts.g, cuts.k, a, c, x.f AS l, y.f AS r, CAST({collocations.SCORE_SCALE} AS HUGEINT) * a // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = list_slice(cuts.g, 1, c) JOIN f y ON y.lang = cuts.lang AND y.g = list_slice(cuts.g, c + 1, cuts.k)),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_ AS (SELECT lang, g, f, k, unnest(range(2, k)) AS m FROM f WHERE k > 2),
around AS (SELECT lang, list_slice(g, p, p + m - 1) AS g, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS p FROM inner_) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN around USING (lang, g) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {collocations.CONTAINED_PERCENT} * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spots AS (SELECT r, doc_id, i, array_to_string(w[i : i + {substring_dedup.WORDS - 1}], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - {substring_dedup.WORDS - 2})) AS i FROM d WHERE len(w) >= {substring_dedup.WORDS})),
first AS (SELECT g, min(doc_id) AS least FROM spots GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {substring_dedup.WORDS})) AS p FROM spots JOIN first USING (g) WHERE least < coalesce(doc_id, least + 1)),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_pii_scan, op3_line_dedup, op4_sentencepiece, op5_simhash, op6_decontaminate,
        op7_secret_scan, op8_language, op9_winnowing, op10_toxicity, op11_whitening, op12_collocations, op13_substring_dedup,
    )
}
SQL = {
    "op3_line_dedup": OP3_SQL, "op6_decontaminate": OP6_SQL, "op12_collocations": OP12_SQL, "op13_substring_dedup": OP13_SQL,
}
