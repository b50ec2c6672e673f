"""Hashed words, word n-grams and skip-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

#: Different words a worker remembers the hash of.
REMEMBERED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters and digits and all bytes of other characters make words.
_WORD_BYTES = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


class Words(dict):
    """64-bit hash of each word met; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_WORD_BYTES).split()


def hash_words(texts: list[str], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the text it is from)."""
    cut = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.uint64, int(sizes.sum()))
    return hashes, np.repeat(np.arange(len(texts)), sizes)


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def places(
    hashes: np.ndarray, owner: np.ndarray, bits: int, skips: tuple[int, ...] = (0,), longest: int = 2
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place below ``2**bits``, text) of words, of pairs over each skip and of longer n-grams.

    No feature crosses the end of a text.
    """
    yield _place(hashes, bits), owner
    for skip in skips:
        gap = skip + 1
        if len(hashes) > gap:
            inside = owner[gap:] == owner[:-gap]
            mixed = ((hashes[:-gap] ^ np.uint64(gap)) * _MIX + hashes[gap:])[inside]
            yield _place(mixed, bits), owner[gap:][inside]
    run = hashes
    for n in range(2, longest + 1):
        if len(hashes) < n:
            return
        run = (run[:-1] ^ np.uint64(n)) * _MIX + hashes[n - 1 :]
        if n > 2:
            inside = owner[n - 1 :] == owner[: 1 - n]
            yield _place(run[inside], bits), owner[n - 1 :][inside]
