"""Language identification by compression.

Every language gets a raw-content dictionary: texts of labelled documents, in the order of a hash
of the text, up to ``DICT_BYTES``. Texts are lower-cased, and all ASCII but letters becomes single
spaces, so that capitals, marks and digits don't count. A text is compressed whole with each dictionary and has the
language of the smallest result; ties go to the language with the larger dictionary sample, then
to the name. A result is rejected when the runner-up is less than ``MIN_MARGIN`` bytes larger, or
when the text has no letter.

Only the dictionaries are fitted on a bounded sample: the ``SAMPLE`` different texts of least hash of a
language and ``DICT_BYTES`` bytes of them. Copies don't count, and every language has a dictionary. Null texts and texts without a letter are ``und`` with score 0.
Rows with a null text or language teach nothing. With nothing to learn from, every text is
``und``. Extra columns are ignored by ``identify`` and kept by ``drop_rejected``.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.llm.common import map_texts

DICT_BYTES = 224 * 1024
SAMPLE = 400
#: Languages with dictionaries of full size; of more, each gets an equal part of the same bytes.
FULL_SIZE = 200
MIN_MARGIN = 1
#: Bytes of lead at which the score is about 0.73.
SCORE_BYTES = 4.0
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


#: ASCII letters and all bytes of other characters stay.
_KEPT = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_KEPT).split())


def learn(documents: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content of each language from a bounded sample of the ``usable`` rows."""
    rows = documents.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.xxhash64(text_col)
    counts = rows.groupBy(lang_col).agg(F.approx_count_distinct(h).alias("n")).collect()
    if not counts:
        return {}
    size = DICT_BYTES * FULL_SIZE // max(FULL_SIZE, len(counts))
    # About twice the wanted different texts have hashes up to a bound; the least of them follow below, so that
    # neither copies nor the error of the count change the sample.
    most = {r[lang_col]: min(2**63 - 1, 2**64 * 2 * SAMPLE // max(r["n"], 1) - 2**63) for r in counts}
    bound = F.create_map(*[F.lit(x).cast(t) for item in most.items() for x, t in zip(item, ("string", "long"))])
    cut = F.substring(text_col, 1, 4 * DICT_BYTES // SAMPLE)
    near = (
        rows.filter(h <= F.element_at(bound, F.col(lang_col)))
        .groupBy(lang_col, h.alias("h"))
        .agg(F.min(cut).alias("t"))
        .groupBy(lang_col)
        .agg(F.sort_array(F.collect_list(F.struct("h", "t"))).alias("all"))
    )
    out = {}
    for r in near.select(lang_col, F.slice("all", 1, SAMPLE).alias("all")).collect():
        # The end of a dictionary is the cheapest to refer to, so full texts come last.
        out[r[lang_col]] = b" ".join(plain(x["t"]) for x in r["all"])[:size]
    return out


def _compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    # Matches of three bytes count, since word endings tell languages apart.
    settings = zstandard.ZstdCompressionParameters.from_level(
        5, strategy=zstandard.STRATEGY_GREEDY, min_match=3, search_log=3, chain_log=17, hash_log=17, window_log=19,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    out = []
    for lang, content in sorted(dictionaries.items(), key=lambda x: (-len(x[1]), x[0])):
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=settings)
        out.append((lang, zstandard.ZstdCompressor(compression_params=settings, dict_data=shared)))
    return out


def judge(text: str, compressors: list) -> tuple[str, float, int | None]:
    """(language, score, lead over the runner-up in bytes) of one text."""
    if not compressors or not _LETTER.search(text):
        return UNKNOWN, 0.0, None
    data = plain(text)
    sizes = [(len(c.compress(data)), rank) for rank, (_, c) in enumerate(compressors)]
    (best, rank), *others = sorted(sizes)
    lead = others[0][0] - best if others else best
    return compressors[rank][0], 1 / (1 + math.exp(-min(lead, 600) / SCORE_BYTES)), lead


def identify(
    documents: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
    min_margin: int = MIN_MARGIN, keep_columns: bool = False,
) -> DataFrame:
    """``id_col``, lang_pred, score and rejected of every document.

    With ``keep_columns`` all columns stay and the results are named __lang, __score, __rejected.
    """
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)
    ready: list = []

    def run(texts: list[str]) -> list[pa.Array]:
        if not ready:
            ready.append(_compressors(shared.value))
        found = [judge(t, ready[0]) for t in texts]
        return [
            pa.array([f[0] for f in found], pa.string()),
            pa.array([f[1] for f in found], pa.float64()),
            pa.array([f[2] is None or f[2] < min_margin for f in found], pa.bool_()),
        ]

    out = [
        T.StructField("__lang", T.StringType()),
        T.StructField("__score", T.DoubleType()),
        T.StructField("__rejected", T.BooleanType()),
    ]
    kept = documents.columns if keep_columns else [id_col]
    slim = documents.select(*[F.col(c) for c in kept], F.col(text_col).alias("__text"))
    found = map_texts(slim, "__text", out, run)
    if keep_columns:
        return found
    return found.select(
        id_col, F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected")
    )


def drop_rejected(documents: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: int = MIN_MARGIN) -> DataFrame:
    """The documents whose language is clear, unchanged."""
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    slim = documents.select(*[F.col(c).alias(n) for c, n in names.items()])
    found = identify(slim, dictionaries, text_col=names[text_col], min_margin=min_margin, keep_columns=True)
    return found.filter(~F.col("__rejected")).select(*[F.col(n).alias(c) for c, n in names.items()])
