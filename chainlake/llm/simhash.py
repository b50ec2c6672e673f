"""SimHash fingerprints and near-duplicates within a Hamming distance, filtered by pigeonring.

The 64 bits lie on a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most
``distance`` bits, some start on the ring has, for every chain of l consecutive segments from
there, at most l * distance / SEGMENTS differing bits. The longest chain whose budget is zero
must be equal and is the join key; the longer chains prune candidates before the full check.

A key may be shared by very many different fingerprints (a large group of near copies). Keys
with more than ``BUCKET`` fingerprints are not paired: their fingerprints are listed under all
64 values one bit away and under their own value. Two fingerprints within two bits of each
other share such a value, and all that share one are within two bits, so linking each to the
least of the list gives the same components with at most 65 rows a fingerprint. This needs
``distance == 2``.

Null and empty texts have fingerprint zero and are linked like any other. Equal texts have equal
fingerprints and collapse before any join. Repeated ids count as one document; a null id keeps
its row and never gives a component its name unless no other id is there (then null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.llm.common import map_texts, unused
from chainlake.llm.components import connected_components
from chainlake.session import materialize

SEGMENTS = 8
DISTANCE = 2
SHINGLE = 3
SEED = 42
BUCKET = 32

def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; only A-Z are lower-cased."""
    words = text.encode().lower().split()  # on bytes, both know ASCII only
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    grams = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return np.array(grams, np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """A bit is one if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.astype("<u8").view(np.uint8)
    # Rows of 64 bits, least significant bit first; summed in blocks that a byte can count.
    bits = np.unpackbits(octets, bitorder="little").reshape(n, 64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long."""

    def run(texts: list[str]) -> list[pa.Array]:
        values = np.array([fingerprint(t, width) for t in texts], np.uint64)
        return [pa.array(values.view(np.int64))]

    slim = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = map_texts(slim, "__text", [T.StructField("fp", T.LongType())], run)
    return out.withColumnRenamed("__id", "id")


def budget(length: int, distance: int = DISTANCE, segments: int = SEGMENTS) -> int:
    """Differing bits that a chain of ``length`` segments may have."""
    return length * distance // segments


def free_chain(distance: int = DISTANCE, segments: int = SEGMENTS) -> int:
    """Length of the longest chain that must be equal."""
    return max(n for n in range(1, segments + 1) if budget(n, distance, segments) == 0)


def _rotated(fp: Column, start: int, segments: int) -> Column:
    """The fingerprint with segment ``start`` first, in its highest bits."""
    by = start * (64 // segments)
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _chains(distance: int, segments: int) -> list[tuple[int, int]]:
    """(bits, budget) of the chains that can prune: the longest of each budget below ``distance``."""
    width = 64 // segments
    longest = {budget(n, distance, segments): n * width for n in range(1, segments)}
    return sorted((bits, most) for most, bits in longest.items() if most < distance)


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints with the components of all pairs within ``distance``.

    ``prints`` has one column ``fp`` of distinct longs.
    """
    if distance != 2:
        raise ValueError("the list of neighbours that stands in for large keys is made for two bits")
    if 64 % segments or segments <= distance:
        raise ValueError("segments must divide 64 and exceed the distance")
    chain_bits = 64 // segments * free_chain(distance, segments)
    turned = F.array(
        *[F.struct(F.lit(s).alias("s"), _rotated(F.col("fp"), s, segments).alias("r")) for s in range(segments)]
    )
    keyed = prints.select("fp", F.explode(turned).alias("t")).select(
        "fp", F.col("t.s").alias("s"), F.col("t.r").alias("r"),
        F.shiftrightunsigned(F.col("t.r"), 64 - chain_bits).alias("key"),
    )
    sizes = keyed.groupBy("s", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sized = materialize(keyed.join(sizes, ["s", "key"]), "simhash-keys")

    # Keys of a few fingerprints: pair them, prune by the chains, then check all bits.
    small = sized.filter(F.col("n") <= bucket)
    left = small.select("s", "key", F.col("r").alias("ra"), F.col("fp").alias("a"))
    right = small.select("s", "key", F.col("r").alias("rb"), F.col("fp").alias("b"))
    differ = F.col("ra").bitwiseXOR(F.col("rb"))
    ring = F.lit(True)
    for bits, most in _chains(distance, segments):
        if bits > chain_bits:
            ring = ring & (F.bit_count(F.shiftrightunsigned(differ, 64 - bits)) <= most)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = left.join(right, ["s", "key"]).filter(F.col("a") < F.col("b")).filter(ring).filter(close).select("a", "b")

    # Keys of many: everything within one bit of a fingerprint is a meeting place of its own.
    many = sized.filter(F.col("n") > bucket).select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)]
    near = many.select("fp", F.explode(F.array(*flips)).alias("place"))
    # At most 65 fingerprints share a place, so the list of one stays small.
    places = near.groupBy("place").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    least = F.array_min("all")
    stars = places.select(least.alias("a"), F.explode(F.filter("all", lambda x: x != F.array_min("all"))).alias("b"))
    return pairs.unionByName(stars)


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
    segments: int = SEGMENTS, bucket: int = BUCKET, width: int = SHINGLE,
) -> DataFrame:
    """One row per document: ``id_col``, fp (long), component_id (least id that can be reached)."""
    docs = materialize(fingerprints(documents, id_col, text_col, width), "simhash")
    prints = materialize(docs.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = connected_components(links(prints.select("fp"), distance, segments, bucket), "a", "b")
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that give their component its name; of repeated ids every row stays, and so do null ids."""
    found = near_duplicates(documents, id_col, text_col, **options)
    name = unused("__gone", documents.columns)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return documents.join(gone, documents[id_col] == F.col(name), "left_anti")
