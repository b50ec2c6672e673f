"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into segments that no piece crosses (a run of spaces with the characters after
it). The different segments of a batch form one flat array of symbols. Each round looks up the
rank of every adjacent pair, takes the least rank of each segment (leftmost on ties), merges
all these pairs at once and drops finished segments, until no pair remains. Segments beyond
``LONG`` symbols take one merge a round as well but from a heap, which is linear in their length.

The pieces come from the model file given by its path; they are read on the driver and
broadcast (their number is fixed by the model). Null and empty texts have no ids and decode to the empty
text. Extra columns are ignored, repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.llm.common import map_texts, ship_package

SPACE = "▁"
LONG = 512
#: Segments a worker remembers; the memory is emptied when it is full.
REMEMBERED = 300_000
_BITS = 20


class Slots(dict):
    """Number of each segment in order of first sight; ``fresh`` lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self)
        self.fresh.append(segment)
        return number


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers starts[0], starts[0] + 1, ... for ``sizes[0]``, then the same for the next range."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class Pieces:
    """A BPE model: pieces by id with their scores; ``byte`` is the id of byte zero (bytes follow each other)."""

    def __init__(self, pieces: list[str], scores: list[float], special: list[bool], byte: int):
        self.pieces, self.scores, self.special, self.byte = pieces, scores, special, byte
        self._prepare()

    def __getstate__(self):
        return self.pieces, self.scores, self.special, self.byte

    def __setstate__(self, state):
        self.__init__(*state)

    def _prepare(self) -> None:
        normal = {p: i for i, p in enumerate(self.pieces) if not self.special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece has a space after other characters; segments can't be cut at spaces")
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols) - len(normal))
        # Symbol of a character; one that no piece holds is -1 - its code point.
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        self.odd = {i: s for s, i in symbols.items() if i >= len(self.pieces)}
        # Pair table: every way to put a piece together from two symbols.
        ranks = {s: r for r, s in enumerate(sorted({self.scores[i] for i in normal.values()}, reverse=True))}
        rows = []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    rows.append((a << _BITS | b, ranks[self.scores[i]], i))
        self.keys, self.rank, self.made = np.array(sorted(rows), np.int64).reshape(-1, 3).T.copy()
        self.pairs = {k: (r, m) for k, r, m in rows}
        # Bytes of every id, one after the other, for decoding.
        octets = [
            bytes([i - self.byte]) if self.byte <= i < self.byte + 256
            else b"" if self.special[i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.octets = np.frombuffer(b"".join(octets), np.uint8)
        self.octet_sizes = np.array([len(o) for o in octets])
        self.octet_starts = np.cumsum(self.octet_sizes) - self.octet_sizes
        self.forget()

    def forget(self) -> None:
        self.slots = Slots()
        self.slot_starts = self.slot_sizes = np.empty(0, np.int64)
        self.store = np.empty(0, np.int32)

    def _spell(self, symbols: list[int]) -> list[int]:
        """Ids of finished symbols; one that is no piece becomes its bytes."""
        out: list[int] = []
        for s in symbols:
            if 0 <= s < len(self.pieces):
                out.append(s)
            else:
                out += [self.byte + b for b in (chr(-1 - s) if s < 0 else self.odd[s]).encode()]
        return out

    def merge_rounds(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each segment) after all merges."""
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        sym = self.symbol[points]
        word = np.repeat(np.arange(len(segments)), np.fromiter(map(len, segments), np.int64, len(segments)))
        done = []
        while len(sym):
            key = np.where((sym[1:] < 0) | (sym[:-1] < 0), -1, sym[:-1] << _BITS | sym[1:])
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            pair = np.nonzero((self.keys[at] == key) & (word[:-1] == word[1:]))[0]
            # Least rank of each segment, leftmost on ties.
            cost = self.rank[at[pair]] << 32 | pair
            owner = word[pair]
            first = np.nonzero(np.diff(owner, prepend=-1))[0]
            where = (np.minimum.reduceat(cost, first) & 0xFFFFFFFF) if len(first) else first
            sym[where] = self.made[at[where]] if len(where) else sym[where]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            # Segments without a pair are finished.
            alive = np.zeros(len(segments), bool)
            alive[owner[first]] = True
            live = alive[word]
            done.append((sym[~live], word[~live]))
            keep &= live
            sym, word = sym[keep], word[keep]
        sym = np.concatenate([d[0] for d in done] or [sym])
        word = np.concatenate([d[1] for d in done] or [word])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        odd = np.nonzero((sym < 0) | (sym >= len(self.pieces)))[0]
        if len(odd):
            spelt = [self._spell([s]) for s in sym[odd].tolist()]
            sizes = np.ones(len(sym), np.int64)
            sizes[odd] = [len(x) for x in spelt]
            ends = np.cumsum(sizes)
            flat = np.repeat(sym, sizes)
            for e, x in zip(ends[odd].tolist(), spelt):
                flat[e - len(x) : e] = x
            sym, word = flat, np.repeat(word, sizes)
        return sym.astype(np.int32), np.bincount(word, minlength=len(segments))

    def merge_long(self, segment: str) -> list[int]:
        """The same merges for one long segment, from a heap of pairs over a linked list."""
        sym = self.symbol[np.frombuffer(segment.encode("utf-32-le"), np.uint32)].tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if sym[i] >= 0 and sym[j] >= 0 and (found := self.pairs.get(sym[i] << _BITS | sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        gone = -(2**40)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = made, gone, after[j]
            if after[i] < len(sym):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return self._spell([s for s in sym if s != gone])

    @staticmethod
    def segments(text: str) -> list[str]:
        """Segments of a text with a space put before it; each is named without its first space."""
        if "  " in text or text[0] in (" ", SPACE) or SPACE in text:
            return [s[1:] for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def _learn(self) -> None:
        """Store the ids of the segments met for the first time."""
        fresh, self.slots.fresh = self.slots.fresh, []
        if not fresh:
            return
        fresh = [SPACE + s for s in fresh]
        short = [i for i, s in enumerate(fresh) if len(s) <= LONG]
        ids, counts = [], np.zeros(len(fresh), np.int64)
        owner = []
        for at in range(0, len(short), 20_000):
            block = short[at : at + 20_000]
            got, sizes = self.merge_rounds([fresh[i] for i in block])
            ids.append(got)
            counts[block] = sizes
            owner.append(np.repeat(block, sizes))
        for i, s in enumerate(fresh):
            if len(s) > LONG:
                got = self.merge_long(s)
                ids.append(np.array(got, np.int32))
                counts[i] = len(got)
                owner.append(np.full(len(got), i))
        flat = np.concatenate(ids)[np.argsort(np.concatenate(owner), kind="stable")]
        self.slot_starts = np.append(self.slot_starts, len(self.store) + np.cumsum(counts) - counts)
        self.slot_sizes = np.append(self.slot_sizes, counts)
        self.store = np.append(self.store, flat)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text) of whole texts."""
        if len(self.slots) > REMEMBERED:
            self.forget()
        cut = [self.segments(t) if t else [] for t in texts]
        words = np.fromiter(map(len, cut), np.int64, len(cut))
        slot = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(cut)), np.int64, int(words.sum()))
        self._learn()
        sizes = self.slot_sizes[slot]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum(words)
        return self.store[ranges(self.slot_starts[slot], sizes)], total[ends] - total[ends - words]

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each list of ids, without the space that encoding puts before a text."""
        sizes = self.octet_sizes[ids]
        data = self.octets[ranges(self.octet_starts[ids], sizes)].tobytes()
        total = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum(counts)
        spans = zip(total[ends - counts].tolist(), total[ends].tolist())
        return [data[a + 1 : b] if data[a : a + 1] == b" " and b > a else data[a:b] for a, b in spans]


_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


def load(path: str) -> Pieces:
    """Read a model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
    byte = next(i for i in range(n) if model.is_byte(i))
    names = [model.id_to_piece(i) for i in range(n)]
    return Pieces(names, [model.get_score(i) for i in range(n)], special, byte)


def encode(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids (array of int) and decoded (the text that the ids give back)."""
    model = documents.sparkSession.sparkContext.broadcast(load(model_path))

    def run(texts: list[str]) -> list[pa.Array]:
        ids, counts = model.value.encode_batch(texts)
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        back = pa.array(model.value.decode_batch(ids, counts), pa.binary())
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), back.cast(pa.string())]

    slim = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_texts(slim, "__text", out, run).withColumnRenamed("__id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of ``ids_col`` in ``out_col``; a null list is an empty text."""
    ship_package(encoded.sparkSession)
    model = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    @F.pandas_udf("string")
    def texts(ids):
        lists = [np.empty(0, np.int32) if x is None else np.asarray(x, np.int32) for x in ids]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate([np.empty(0, np.int32), *lists])
        return pd.Series([t.decode(errors="replace") for t in model.value.decode_batch(flat, counts)], dtype=object)

    return encoded.withColumn(out_col, texts(F.col(ids_col)))
