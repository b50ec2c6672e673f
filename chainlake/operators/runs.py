"""Runs of consecutive entries, found where the entries lie.

Stored chains are clustered: a file holds long stretches of a chain in index order. Each task walks
the rows it reads once and folds every stretch (same chain, index one higher than in the row before)
into one row, with its first error inside. Only those rows are shuffled: one for each file and chain
of a clustered table, one for each entry at worst.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bits of ``flags``: what is wrong with an entry on its own.
BAD_VERSION, BAD_TYPE, BAD_HASH = 1, 2, 4
#: Errors of entries by their number in a run, in the order of checks.
ERRORS = {1: "version", 2: "payload_type", 3: "broken_chain", 4: "tampered_entry"}

SCHEMA = (
    "chain_id string, first bigint, last bigint, n bigint, head string, prev_hash string, flags int, at bigint, error int"
)


def _errors(flags: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """First failed check of entries whose predecessor is known; 0 when all pass."""
    return np.select([flags & BAD_VERSION > 0, flags & BAD_TYPE > 0, ~linked, flags & BAD_HASH > 0], [1, 2, 3, 4], 0)


def _true(mask: pa.Array) -> np.ndarray:
    return pc.fill_null(mask, False).to_numpy(zero_copy_only=False)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32()]

    def rows(runs: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs), types)], names)

    open_run: list | None = None  # values of the last run so far, which the next batch may go on with
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if before is not None:
            batch_and = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
        else:
            batch_and = batch
        skip = batch_and.num_rows - batch.num_rows
        chain_id, index = batch_and.column("chain_id"), batch_and.column("index")
        entry_hash, prev_hash = batch_and.column("entry_hash"), batch_and.column("prev_hash")
        flags = batch.column("flags").to_numpy()
        at = pc.fill_null(batch.column("index"), -1).to_numpy()
        size = batch_and.num_rows
        follows, linked = np.zeros(size, bool), np.zeros(size, bool)
        if size > 1:
            same = _true(pc.equal(chain_id.slice(1), chain_id.slice(0, size - 1)))
            follows[1:] = same & _true(pc.equal(index.slice(1), pc.add(index.slice(0, size - 1), 1)))
            linked[1:] = _true(pc.equal(prev_hash.slice(1), entry_hash.slice(0, size - 1)))
        follows, linked = follows[skip:], linked[skip:]
        error = np.where(follows, _errors(flags, linked), 0)
        begin = np.flatnonzero(~follows)
        if not len(begin) or begin[0] != 0:
            begin = np.append(0, begin)  # goes on with the run of the batch before
        end = np.append(begin[1:], len(flags))
        wrong = np.flatnonzero(error)
        first_wrong = np.searchsorted(wrong, begin)
        found = []
        picked = [batch.column(c).take(pa.array(i)).to_pylist() for c, i in (
            ("chain_id", begin), ("index", begin), ("index", end - 1), ("entry_hash", end - 1), ("prev_hash", begin)
        )]
        for r, (chain, first, last, head, prev) in enumerate(zip(*picked)):
            k = first_wrong[r]
            row = wrong[k] if k < len(wrong) and wrong[k] < end[r] else None
            found.append([
                chain, first, last, int(end[r] - begin[r]), head, prev, int(flags[begin[r]]),
                None if row is None else int(at[row]), None if row is None else int(error[row]),
            ])
        if follows[0]:
            more = found.pop(0)
            open_run[2:5] = more[2], open_run[3] + more[3], more[4]
            if open_run[8] is None:
                open_run[7:9] = more[7:9]
        if found:
            done = ([open_run] if open_run else []) + found[:-1]
            if done:
                yield rows(done)
            open_run = found[-1]
        before = batch.slice(batch.num_rows - 1)
    if open_run:
        yield rows([open_run])


def find_runs(entries: DataFrame) -> DataFrame:
    """Runs of a table with chain_id, index, entry_hash, prev_hash and flags.

    first, last: indexes; n: entries; head: hash of the last one; prev_hash, flags: of the first one;
    at, error: index and number of the first error after the first entry.
    """
    return entries.select("chain_id", "index", "entry_hash", "prev_hash", "flags").mapInArrow(_fold, SCHEMA)


def local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the rows that follow the row before them, by chain, index and hash."""
    before = None
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        both = batch if before is None else pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
        n = both.num_rows
        linked = np.zeros(n, bool)
        if n > 1:
            here, there = both.slice(1), both.slice(0, n - 1)
            linked[1:] = (
                _true(pc.equal(here.column("chain_id"), there.column("chain_id")))
                & _true(pc.equal(here.column("index"), pc.add(there.column("index"), 1)))
                & _true(pc.equal(here.column("prev_hash"), there.column("entry_hash")))
            )
        before = batch.slice(size - 1)
        columns = [batch.column(c) for c in ("chain_id", "index", "prev_hash")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(linked[n - size :])], ["chain_id", "index", "prev_hash", "linked"])
