"""Shared pieces: streaming texts through Arrow batches, broadcast limits, row numbers."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one Arrow batch of texts.
BATCH_ROWS = 1_000
#: Texts (in characters) handed to one call of a batch function.
SLICE_CHARS = 1_000_000


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of an application, once."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of about ``limit`` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        n = len(text) if text else 0
        if at > start and size + n > limit:
            yield start, at
            start, size = at, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame, text_col: str, out: list[T.StructField], fn: Callable[[list[str]], list[pa.Array]]
) -> DataFrame:
    """Replace ``text_col`` by the columns ``out`` that ``fn`` makes of a list of whole texts.

    A null text is an empty text. Memory is bounded by one Arrow batch.
    """
    ship_package(df.sparkSession)
    # Whole texts are large rows; a batch of them has to fit beside the models of a worker.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType(kept + out)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                columns = [part.column(n) for n in names] + fn(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def least_different(rows: DataFrame, key: Column, value: Column, size: int) -> list[str]:
    """``value`` of the ``size`` rows whose different ``key`` has the least hash; copies of a row change nothing."""
    h = F.xxhash64(key)
    n = rows.agg(F.approx_count_distinct(h)).first()[0]
    # About twice the wanted keys have hashes up to a bound, so that the ordering below sees few rows.
    bound = min(2**63 - 1, 2**64 * 2 * size // max(n, 1) - 2**63)
    near = rows.filter(h <= F.lit(bound).cast("long")).select(h.alias("h"), value.alias("t"))
    return [r["t"] for r in near.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(size).collect()]


def unused(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores before it as make it none of the ``taken`` (names ignore case)."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_of(items: Column) -> Column:
    """Lower-case hex digest of strings joined by commas."""
    return F.sha2(F.array_join(items, ","), 256)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def written(found: Column) -> Column:
    """Spans as kind:start:end."""
    return F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def digest(found: DataFrame, id_col: str, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base ``kinds``, digest of the base spans, and all spans as text."""
    base = F.filter("found", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        id_col, *counts, sha256_of(written(base)).alias("base_sha256"), F.array_join(written(F.col("found")), ",").alias("spans")
    )
