"""Document fingerprints by winnowing.

Every run of ``K`` code points (A-Z folded to a-z) has a rolling hash. Of every window of
``WINDOW`` consecutive hashes the least is kept, the rightmost one on ties, with its position. Two
texts that share ``K + WINDOW - 1`` code points share a kept hash. A text shorter than ``K`` has
one hash, of the whole text; the empty and the null text have none. Likeness of two fingerprints
is the share of common values among all their different values (1 if both are empty).

Repeated ids follow each other in the order of their texts, null ids come after all others.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chainlake.llm.common import least_different, map_texts, ship_package

K = 12
WINDOW = 28
#: Ids looked at for each cut where ids are texts.
CUT_IDS = 50
_BASE = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def code_points(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points + np.where((points >= 65) & (points <= 90), 32, 0).astype(np.uint64)


def rolling(points: np.ndarray, k: int = K) -> np.ndarray:
    """Polynomial hash of every run of ``k`` points modulo 2**64, made from runs of half the length."""
    if len(points) < k:
        k = len(points)
    if not k:
        return np.empty(0, np.uint64)
    out, done, part, width = None, 0, points, 1
    while True:
        if k & width:
            if out is None:
                out, done = part, width
            else:
                n = len(points) - done - width + 1
                out, done = out[:n] * np.uint64(pow(_BASE, width, 2**64)) + part[done : done + n], done + width
        if width * 2 > k:
            break
        part = part[: len(part) - width] * np.uint64(pow(_BASE, width, 2**64)) + part[width:]
        width *= 2
    out = out[: len(points) - k + 1]
    # Mix, so that the least value is a fair choice.
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out >> np.uint64(32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept of a text, by position."""
    hashes = rolling(points, k)
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    # Least hash and, among equals, the largest position.
    part = hashes << np.uint64(32) | (np.uint64(2**32 - 1) - np.arange(n, dtype=np.uint64))
    window = min(window, n)
    width = 1
    while width * 2 <= window:
        part = np.minimum(part[:-width], part[width:])
        width *= 2
    if width < window:
        part = np.minimum(part[: n - window + 1], part[window - width :])
    part = part[np.concatenate(([True], part[1:] != part[:-1]))]
    return (part >> np.uint64(32)).astype(np.uint32), (2**32 - 1 - (part & np.uint64(2**32 - 1))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common values among all different values; both sorted and without repeats."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def as_text(hashes: np.ndarray) -> str:
    """Kept hashes in text order, eight hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``id_col``, hashes (array of long) and positions (array of int, from 0) of every text."""

    def run(texts: list[str]) -> list[pa.Array]:
        kept = [winnow(code_points(t), k, window) for t in texts]
        return [pa.array([h.astype(np.int64) for h, _ in kept], pa.list_(pa.int64())),
                pa.array([p.astype(np.int32) for _, p in kept], pa.list_(pa.int32()))]

    out = [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    return map_texts(documents.select(id_col, F.col(text_col).alias("__text")), "__text", out, run)


def _runs(documents: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Documents cut into runs of descending id, each followed by a copy of the next run's first rows.

    Only ids go into the choice of the cuts, and only the documents at a cut are sent twice.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)]
    if parts == 1:
        cuts = []
    elif isinstance(documents.schema[id_col].dataType, T.StringType):
        # Texts have no percentiles; where the cuts are changes no result.
        some = sorted(least_different(rows.filter("id IS NOT NULL"), F.col("id"), F.col("id"), CUT_IDS * parts))
        cuts = [some[int(s * len(some))] for s in shares] if some else []
    else:
        cuts = rows.agg(F.percentile_approx("id", shares, 10_000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []), reverse=True)
    # Run 0 holds the largest ids; a null id is in the last run.
    run_of = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        run_of = F.when(F.col("id") > cut, i).otherwise(run_of)
    rows = rows.withColumn("run", run_of)
    # First id of each run that has rows: at most ``parts`` rows.
    firsts = rows.groupBy("run").agg(F.max("id").alias("id"), F.count("*").alias("n")).orderBy("run").collect()
    if not firsts:
        return rows.withColumn("tail", F.lit(False))
    pairs = [(f, firsts[i - 1]["run"]) for i, f in enumerate(firsts)]
    copy_to = F.lit(None).cast("int")
    for f, to in pairs:
        same = (F.col("run") == f["run"]) & F.col("id").eqNullSafe(F.lit(f["id"]))
        copy_to = F.when(same, F.lit(to)).otherwise(copy_to)
    places = F.array(F.struct(F.col("run"), F.lit(False).alias("tail")), F.struct(copy_to.alias("run"), F.lit(True).alias("tail")))
    out = rows.withColumn("copy", copy_to).select("id", "text", F.explode(
        F.when(F.col("copy").isNull(), F.slice(places, 1, 1)).otherwise(places)).alias("at"))
    return out.select("at.run", "at.tail", "id", "text")


def compare_next(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW,
    parts: int | None = None,
) -> DataFrame:
    """Fingerprint every text and its edited text, and compare both with it.

    The edited text has its last half replaced by the start of the next document in descending id
    order (the first after the last). ``parts`` is the number of id runs, by default the number
    of shuffle partitions; each run is sorted by Spark and streamed.
    """
    spark = documents.sparkSession
    ship_package(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = _runs(documents, id_col, text_col, parts)
    ready = runs.repartition(parts, "run").sortWithinPartitions("run", "tail", F.desc_nulls_last("id"), "text")
    id_type = documents.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )
    arrow = to_arrow_schema(schema)

    def prints(text: str):
        kept, _ = winnow(code_points(text), k, window)
        return kept, np.unique(kept)

    def row(doc, following):
        id_, text, (kept, values) = doc
        _, next_text, (_, next_values) = following
        half = len(text) // 2
        edited = text[: len(text) - half] + next_text[:half] if half else text
        edited_kept, edited_values = prints(edited)
        return (
            id_, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(kept), as_text(edited_kept),
            likeness(values, edited_values), likeness(values, next_values),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ended = None, None, False
        for batch in batches:
            out = []
            for number, tail, id_, text in zip(*[batch.column(n).to_pylist() for n in ("run", "tail", "id", "text")]):
                if number != current:
                    current, held, ended = number, None, False
                if ended:
                    continue  # more rows that share the first id of the next run
                doc = (id_, text, prints(text))
                if held is not None:
                    out.append(row(held, doc))
                held, ended = doc, tail
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return ready.mapInArrow(run, schema)
