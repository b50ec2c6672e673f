"""Hash-linking of entries that arrive sorted by chain, one Arrow batch after the other.

Only the digest of an entry needs the one before it. Envelope fields are packed and digests spelled for
a whole batch at once, so that what runs entry by entry is one SHA-256 over ready bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chainlake.schemas import ENTRY_VERSION, MAX_PAYLOAD_BYTES, ZERO_HASH

#: Entries of a long chain that are stored and linked together.
BLOCK_ROWS = 1_000
#: Heads in one batch.
HEAD_ROWS = 10_000

# The envelope before the payload.
_HEADER = np.dtype(
    [("version", "u1"), ("index", ">u8"), ("timestamp", ">i8"), ("prev_hash", "V32"), ("payload_type", "u1"), ("size", ">u4")]
)
_ZERO = bytes.fromhex(ZERO_HASH)


def _stretches(batch: pa.RecordBatch, chain: str | None, started: bool, count: int) -> list[tuple[int, int, int, bytes | None]]:
    """(begin, end, first index, hash before) of the rows that follow one another; no hash where they go on from the last batch."""
    states, seeds = batch.column("__state"), batch.column("__seed").to_numpy(zero_copy_only=False)
    seeded = np.flatnonzero(seeds).tolist()
    chains = pc.run_end_encode(batch.column("chain_id"), run_end_type=pa.int64())
    out, at, nth = [], 0, 0
    for value, end in zip(chains.values.to_pylist(), chains.run_ends.to_pylist()):
        head = None
        if at or not started or value != chain:
            count, head = 0, _ZERO
        while nth < len(seeded) and seeded[nth] < end:
            if seeded[nth] > at:
                out.append((at, seeded[nth], count, head))
            state = states[seeded[nth]].as_py() or f"0|{ZERO_HASH}"
            count, head = int(state.split("|")[0]), bytes.fromhex(state.split("|")[1])
            at, nth = seeded[nth] + 1, nth + 1
        # Empty stretches carry the state of a seed on to the next batch.
        out.append((at, end, count, head))
        at = end
    return out


def _spelled(digests: list[bytes]) -> pa.Array:
    offsets = np.arange(0, 64 * len(digests) + 1, 64, dtype=np.int32)
    return pa.StringArray.from_buffers(len(digests), pa.py_buffer(offsets), pa.py_buffer(b"".join(digests).hex().encode()))


class _Envelopes:
    """What is hashed of the rows of a batch, one behind the other with a hole for the hash before each."""

    def __init__(self, batch: pa.RecordBatch, index: np.ndarray):
        n = batch.num_rows
        texts = pc.fill_null(batch.column("payload_json"), "").cast(pa.large_binary())
        header = np.zeros(n, _HEADER)
        header["version"], header["index"] = ENTRY_VERSION, index
        header["timestamp"] = pc.fill_null(batch.column("timestamp"), 0).to_numpy(zero_copy_only=False)
        header["payload_type"] = pc.fill_null(batch.column("payload_type"), 0).cast(pa.uint8()).to_numpy(zero_copy_only=False)
        header["size"] = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        headers = pa.Array.from_buffers(pa.binary(_HEADER.itemsize), n, [None, pa.py_buffer(header.tobytes())]).cast(pa.large_binary())
        joined = pc.binary_join_element_wise(headers, texts, pa.scalar(b"", pa.large_binary()))
        self.ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + n + 1].tolist()
        self.data = bytearray(joined.buffers()[2])

    def link(self, a: int, b: int, head: bytes) -> list[bytes]:
        """``head`` and the digests of the rows from a to b that follow it."""
        sha256, data, begin, out = hashlib.sha256, memoryview(self.data), self.ends[a], [head]
        for end in self.ends[a + 1 : b + 1]:
            data[begin + 17 : begin + 49] = head
            head = sha256(data[begin:end]).digest()
            out.append(head)
            begin = end
        return out

    def head(self, head: bytes) -> bytes:
        """The last digest alone."""
        sha256, data, begin = hashlib.sha256, memoryview(self.data), self.ends[0]
        for end in self.ends[1:]:
            data[begin + 17 : begin + 49] = head
            head = sha256(data[begin:end]).digest()
            begin = end
        return head


def _accepted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch without the payloads that can't become entries; seeds stay."""
    size = pc.binary_length(batch.column("payload_json"))
    refused = pc.fill_null(pc.greater(size, MAX_PAYLOAD_BYTES), True)
    if "__seed" in batch.schema.names:
        refused = pc.and_(refused, pc.invert(batch.column("__seed")))
    return batch.filter(pc.invert(refused)) if pc.any(refused).as_py() else batch


def _complete(batch: pa.RecordBatch, seeds: pa.Array | None = None) -> None:
    for name in ("timestamp", "payload_type", "payload_json"):
        missing = pc.is_null(batch.column(name))
        if pc.any(missing if seeds is None else pc.and_(missing, pc.invert(seeds))).as_py():
            raise ValueError(f"an entry has no {name}")


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append index, prev_hash and entry_hash to rows sorted by chain_id and order of arrival.

    A row with ``__seed`` is no entry: its ``__state``, "entry count|head", is what the chain goes on from.
    """
    chain, started, count, head = None, False, 0, _ZERO
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        seeds = batch.column("__seed")
        _complete(batch, seeds)
        stretches = _stretches(batch, chain, started, count)
        index = np.zeros(n, np.int64)
        for a, b, first, _ in stretches:
            index[a:b] = np.arange(first, first + b - a)
        envelopes = _Envelopes(batch, index)
        previous, digests = [], []
        for a, b, first, start in stretches:
            hashes = envelopes.link(a, b, head if start is None else start)
            previous += hashes[:-1]
            digests += hashes[1:]
            head, count = hashes[-1], first + b - a
        chain, started = batch.column("chain_id")[n - 1].as_py(), True
        own = pc.invert(seeds)
        names = [c for c in batch.schema.names if c not in ("__state", "__seed")]
        kept = batch.select(names).filter(own)
        linked = [pa.array(index).filter(own), _spelled(previous), _spelled(digests)]
        yield pa.RecordBatch.from_arrays(kept.columns + linked, [*names, "index", "prev_hash", "entry_hash"])


def link_accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``link_batches`` of the payloads that can become entries."""
    return link_batches(map(_accepted, batches))


def pack_blocks(block_rows: int = BLOCK_ROWS) -> Callable:
    """Rows sorted by __bucket, chain_id and order of arrival as blocks of a chain: (__bucket, chain_id, at, n, rows).

    ``at`` counts the blocks of a task; ``rows`` is a compressed Arrow stream of all columns but __bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Without threads, which cost more than they give for blocks of this size.
        options, at = pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False), 0
        for batch in map(_accepted, batches):
            if not batch.num_rows:
                continue
            _complete(batch)
            keys = [pc.run_end_encode(batch.column(c), run_end_type=pa.int64()).run_ends.to_pylist() for c in ("__bucket", "chain_id")]
            ends = sorted({*keys[0], *keys[1], *range(block_rows, batch.num_rows, block_rows)})
            content = batch.drop_columns(["__bucket"])
            begin, out = 0, []
            for end in ends:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, content.schema, options=options) as writer:
                    writer.write_batch(content.slice(begin, end - begin))
                out.append((batch.column("__bucket")[begin].as_py(), batch.column("chain_id")[begin].as_py(), at, end - begin, sink.getvalue().to_pybytes()))
                begin, at = end, at + 1
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["__bucket", "chain_id", "at", "n", "rows"])

    return run


PACKED = "__bucket bigint, chain_id string, at bigint, n bigint, rows binary"


def _unpacked(rows: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(rows.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)) as reader:
        return reader.read_next_batch()


def block_heads(states: dict) -> Callable:
    """Go through blocks sorted by chain_id and ``at``: (chain_id, at, count, head) before each block, and with ``at`` null after the last.

    ``states``: (count, head) of the chains that go on from something. Nothing else is handed on, so that what
    has to run entry after entry is the digests alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["chain_id", "at", "count", "head"])

        last, count, head, found = None, 0, _ZERO, []
        for batch in batches:
            for name, at, rows in zip(batch.column("chain_id").to_pylist(), batch.column("at").to_pylist(), batch.column("rows")):
                if last is None or name != last[0]:
                    if last is not None:
                        found.append((*last, head))
                    count, head = states.get(name, (0, _ZERO))
                found.append((name, at, count, head))
                content = _unpacked(rows)
                index = np.arange(count, count + content.num_rows)
                head, count = _Envelopes(content, index).head(head), count + content.num_rows
                last = name, None, count
            if len(found) > HEAD_ROWS:
                yield out(found)
                found = []
        if last is not None:
            yield out([*found, (*last, head)])

    return run


def link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks, each with the (count, head) before it, with index, prev_hash and entry_hash; blocks in any order."""
    for batch in batches:
        for rows, count, head in zip(batch.column("rows"), batch.column("count").to_pylist(), batch.column("head").to_pylist()):
            content = _unpacked(rows)
            n = content.num_rows
            index = np.arange(count, count + n)
            hashes = _Envelopes(content, index).link(0, n, head)
            linked = [pa.array(index), _spelled(hashes[:-1]), _spelled(hashes[1:])]
            yield pa.RecordBatch.from_arrays(content.columns + linked, [*content.schema.names, "index", "prev_hash", "entry_hash"])
