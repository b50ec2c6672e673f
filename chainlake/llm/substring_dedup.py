"""Substring deduplication by level-wise doubling.

A window of ``words`` consecutive words can repeat only if the windows of half its length inside
it do. So only half windows are compared first, and of those only anchors: the one of least hash
within each full window. Equal full windows have equal anchors, therefore an anchor that one
document alone holds rules out all full windows around it. Consecutive full windows with one
anchor form a run; a run is compared as a whole (hash of all its words).

1. Each run is a row (document, place, anchor, hash of the run). Per anchor, partial aggregates give
   the least and greatest document and whether all its runs are equal. Anchors of one document alone end here.
2. Where all runs of an anchor are equal, every run outside the first document is a repeat.
3. Anchors with different runs are extended to twice their length: each full window of those
   runs is a row, and the least document of each window decides. No candidates, no second level.
4. The words that repeated windows cover are taken out of each document.

Windows are judged on the input. Equality of windows is equality of two 64-bit hashes: of the
anchor and of the run or window. Texts are shuffled by their own key only, in steps 3 and 4. No
group is collected but the places of one document.

Words are separated by ASCII white space and are otherwise unchanged. Null and empty texts have no
words. Rows with the same id are the same document and remove nothing of each other; rows with a null id come
after all others and remove nothing of each other. Ids may be of any type that Spark orders. Other columns are kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chainlake.llm.common import ship_package, slices
from chainlake.llm.ngrams import Words
from chainlake.session import materialize

WORDS = 50
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbours, not symmetric."""
    x = (a ^ (a >> _S29)) * _A + b
    return (x ^ (x >> _S32)) * _B


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words, by doubling shorter windows."""
    power, size, out, done = hashes, 1, None, 0
    while True:
        if length & size:
            n = len(hashes) - done - size + 1
            part = power[done : done + max(n, 0)]
            out = part if out is None else _mix(out[: len(part)], part)
            done += size
        if done == length:
            return out
        power = _mix(power[:-size], power[size:]) if len(power) > size else power[:0]
        size *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value within every ``width`` neighbours."""
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _starts(cut: list[list[bytes]], words: int) -> np.ndarray:
    """Places, in the joined word list, at which a window of one document starts."""
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    first = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - words + 1, 0)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return inside, np.repeat(first, n), np.repeat(np.arange(len(cut)), n)


def runs_of(cut: list[list[bytes]], words: int, known: Words) -> tuple[np.ndarray, ...]:
    """Runs of all full windows of the documents: (document, first place, windows, anchor, hash of the run)."""
    inside, first, owner = _starts(cut, words)
    none = np.zeros(0, np.int64)
    if not len(inside):
        return none, none, none, none, none
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.uint64, sum(map(len, cut)))
    half = (words + 1) // 2
    at = inside + first
    anchor = _least(window_hashes(hashes, half), words - half + 1)[at]
    full = window_hashes(hashes, words)[at]
    width = words - half + 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    # A run ends after ``width`` windows, so its first and last window together hold all its words.
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    within = np.arange(len(at)) - np.repeat(begin, length)
    begin = np.flatnonzero(within % width == 0)
    length = np.diff(np.append(begin, len(at)))
    whole = _mix(_mix(full[begin], full[begin + length - 1]), length.astype(np.uint64))
    return owner[begin], inside[begin], length, anchor[begin].view(np.int64), whole.view(np.int64)


def windows_of(cut: list[list[bytes]], open_runs: list[list[dict]], words: int, known: Words) -> tuple[np.ndarray, ...]:
    """Full windows of the given runs: (document, place, anchor, hash of the window)."""
    inside, first, owner = _starts(cut, words)
    none = np.zeros(0, np.int64)
    if not len(inside):
        return none, none, none, none
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.uint64, sum(map(len, cut)))
    half = (words + 1) // 2
    total = len(hashes)
    mark = np.zeros(total + 1, np.int64)
    base = np.cumsum([0] + [len(c) for c in cut])
    for doc, found in enumerate(open_runs):
        for run in found:
            mark[base[doc] + run["start"]] += 1
            mark[base[doc] + run["start"] + run["n"]] -= 1
    at = inside + first
    chosen = np.cumsum(mark)[at] > 0
    at = at[chosen]
    anchor = _least(window_hashes(hashes, half), words - half + 1)[at]
    full = window_hashes(hashes, words)[at]
    return owner[chosen], inside[chosen], anchor.view(np.int64), full.view(np.int64)


def _cut(texts: list[str | None]) -> list[list[bytes]]:
    return [t.encode().split() if t else [] for t in texts]


def _spread(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str], fn) -> Iterator[pa.RecordBatch]:
    """Rows that ``fn(texts, first, last, batch)`` makes of slices of each batch, with the keys of their documents."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            owner, *columns = fn(texts[a:b], a, b, batch)
            picked = pa.array(owner + a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(picked) for k in keys] + [pa.array(c) for c in columns], keys + names
            )


def repeated(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, key, start, n): runs of windows that also start in a document of smaller id.

    ``documents`` holds id, key (hash of the text) and text; ``start`` is the number of the first word
    of the first window, from 0; ``n`` the number of consecutive windows.
    """
    spark = documents.sparkSession
    id_type = documents.schema["id"].dataType

    def schema(**columns: str) -> T.StructType:
        out = T.StructType().add("id", id_type).add("key", "long")
        for name, kind in columns.items():
            out = out.add(name, kind)
        return out

    at_run = schema(start="integer", n="integer", anchor="long", run="long")
    at_window = schema(start="integer", anchor="long", window="long")
    run_types, window_types = to_arrow_schema(at_run), to_arrow_schema(at_window)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for out in _spread(
            batches, ["id", "key"], ["start", "n", "anchor", "run"],
            lambda texts, a, b, batch: runs_of(_cut(texts), words, known),
        ):
            yield out.cast(run_types)

    long_enough = documents.filter(F.length("text") >= 2 * words - 1)
    placed = materialize(long_enough.mapInArrow(runs, at_run), "runs")
    # Null ids come last: the least id ignores them, and their presence makes the anchor shared.
    anchors = (
        placed.groupBy("anchor")
        .agg(
            F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("nulls"),
            F.min("run").alias("r1"), F.max("run").alias("r2"),
        )
        .filter("least <> most OR nulls AND least IS NOT NULL")
        .select("anchor", "least", (F.col("r1") == F.col("r2")).alias("alike"))
    )
    later = F.col("id").isNull() | (F.col("id") > F.col("least"))
    shared = materialize(
        placed.join(anchors, "anchor").filter(later | ~F.col("alike")).select("id", "key", "start", "n", "alike"), "shared"
    )
    whole = shared.filter("alike").drop("alike")
    open_runs = shared.filter("NOT alike")
    if open_runs.isEmpty():
        return whole
    per_document = open_runs.groupBy("id", "key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for out in _spread(
            batches, ["id", "key"], ["start", "anchor", "window"],
            lambda texts, a, b, batch: windows_of(
                _cut(texts), batch.column("runs").slice(a, b - a).to_pylist(), words, known
            ),
        ):
            yield out.cast(window_types)

    longer = materialize(
        _with(documents, per_document, "inner").select("id", "key", "text", "runs").mapInArrow(windows, at_window), "windows"
    )
    first = (
        longer.groupBy("anchor", "window")
        .agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("nulls"))
        .filter("least <> most OR nulls AND least IS NOT NULL")
        .select("anchor", "window", "least")
    )
    single = longer.join(first, ["anchor", "window"]).filter(later)
    return whole.unionByName(single.select("id", "key", "start", F.lit(1).alias("n")))


def _with(documents: DataFrame, per_document: DataFrame, how: str) -> DataFrame:
    other = per_document.withColumnsRenamed({"id": "__id", "key": "__key"})
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    return documents.join(other, same, how).drop("__id", "__key")


def remove(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The documents without repeated passages, and two columns more: n_words and n_removed.

    ``text_col`` holds the kept words joined by one space, also where nothing was removed; n_words counts before.
    """
    ship_package(documents.sparkSession)
    order = documents.columns
    row = F.struct(*[F.col(c) for c in order if c != text_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    packed = documents.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), row.alias("row")
    )
    found = repeated(packed.select("id", "key", "text"), words)
    per_document = found.groupBy("id", "key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    joined = _with(packed, per_document, "left").select("row", "text", "runs")
    kept_type = [f for f in joined.schema.fields if f.name == "row"]
    schema = T.StructType(kept_type).add("text", "string").add("n_words", "long").add("n_removed", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                tokens = text.encode().split()
                kept = tokens
                if found:
                    mark = np.zeros(len(tokens) + 1, np.int64)
                    for run in found:
                        mark[run["start"]] += 1
                        mark[run["start"] + run["n"] + words - 1] -= 1
                    stays = np.cumsum(mark[:-1]) == 0
                    kept = [tokens[i] for i in np.flatnonzero(stays)]
                for column, value in zip(out, (b" ".join(kept).decode(), len(tokens), len(tokens) - len(kept))):
                    column.append(value)
            arrays = [batch.column("row"), *map(pa.array, out, (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "n_words", "n_removed"])

    done = joined.mapInArrow(cut, schema)
    return done.select(
        *[F.col("text").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in order], "n_words", "n_removed"
    )
