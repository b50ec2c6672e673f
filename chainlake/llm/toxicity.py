"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, word pairs and pairs with one and two words
between them, hashed to ``2**BITS`` places. Labelled texts are dealt to ``SHARDS`` tasks by a hash; each
task runs FTRL-proximal (per-coordinate rates, L1 and L2) over its texts from the common state,
and the states are averaged by place after every round. L1 leaves few weights that are not
zero; these are broadcast, at most ``2**BITS`` of them.

Training takes at most ``SAMPLE`` labelled ids, by a hash of the id, and one text of each. A null label teaches nothing; a document with both labels counts as
toxic. Null and empty texts have no features and get the score of the bias alone. Without any
label the score is 0.5. Repeated documents are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.llm.common import map_texts, ship_package
from chainlake.llm.ngrams import Words, hash_words, places
from chainlake.session import materialize

BITS = 18
SAMPLE = 16_000
SHARDS = 8
ROUNDS = 3
SKIPS = (0, 1, 2)
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2.0, 1.0

def features(text: str, known: Words, bits: int = BITS) -> np.ndarray:
    """Different places of one text, sorted; the bias is place ``2**bits``."""
    found = [p for p, _ in places(*hash_words([text], known), bits, SKIPS)]
    return np.append(np.unique(np.concatenate(found)), 2**bits)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights of accumulated gradients ``z`` and squares ``n``; zero inside the L1 band."""
    short = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, short / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train_shard(rows: Iterator[tuple[str, int]], z: np.ndarray, n: np.ndarray) -> None:
    """Run over texts with their labels, changing the state in place."""
    known = Words()
    for text, label in rows:
        at = features(text, known)
        w = weights_of(z[at], n[at])
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def sample(labels: DataFrame, usable: Column, id_col: str, label_col: str, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled ids (id, label) by a hash of the id, so that labels keep their shares."""
    rows = labels.filter(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(size)


def train(documents: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", size: int = SAMPLE, rounds: int = ROUNDS) -> dict[int, float]:
    """Weights that are not zero, by place, learned from the ``usable`` labels."""
    chosen = materialize(sample(labels, usable, id_col, label_col, size).coalesce(1), "toxicity-sample")
    # The sample has at most ``size`` rows, so it is broadcast.
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows of a repeated id teach once, by their least text, so the rows are bounded like the ids.
    known = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = known.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(SHARDS)))
    rows = materialize(rows.repartition(SHARDS, "shard"), "toxicity-train").select("shard", "id", "text", "label")
    spark = documents.sparkSession
    ship_package(spark)
    state = (np.empty(0, np.int64), np.empty(0), np.empty(0))
    shape = T.StructType([T.StructField("place", T.LongType()), T.StructField("z", T.DoubleType()), T.StructField("n", T.DoubleType())])

    def one_round(start):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = [b for b in batches if b.num_rows]
            if not first:
                return
            z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
            at, z0, n0 = start.value
            z[at], n[at] = z0, n0
            train_shard(((t, y) for b in first for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist())), z, n)
            used = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(z[used]), pa.array(n[used])], ["place", "z", "n"])

        return run

    for number in range(rounds):
        ordered = rows.repartition(SHARDS, "shard").sortWithinPartitions(F.xxhash64("id", F.lit(number)), "text")
        done = ordered.select("text", "label").mapInArrow(one_round(spark.sparkContext.broadcast(state)), shape)
        # A place that a shard never met keeps the common state there: zero change.
        mean = done.groupBy("place").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).orderBy("place").toPandas()
        state = mean["place"].to_numpy(), mean["z"].to_numpy(), mean["n"].to_numpy()
    at, z, n = state
    w = weights_of(z, n)
    return {int(a): float(x) for a, x in zip(at, w) if x}


def score(documents: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score (0 to 1, higher: toxic) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    ready: list = []

    def run(texts: list[str]) -> list[pa.Array]:
        if not ready:
            dense = np.zeros(2**BITS + 1, np.float64)
            dense[list(shared.value)] = list(shared.value.values())
            ready.extend((dense, dense != 0, Words()))
        dense, used, known = ready
        pairs = []
        for place, of in places(*hash_words(texts, known), BITS, SKIPS):
            hit = used[place]
            pairs.append(of[hit] << (BITS + 1) | place[hit])
        # A feature counts once in a text, however often it occurs.
        pairs = np.unique(np.concatenate(pairs))
        total = np.bincount(pairs >> (BITS + 1), dense[pairs & (2 ** (BITS + 1) - 1)], len(texts)) + dense[2**BITS]
        return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))]

    slim = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = map_texts(slim, "__text", [T.StructField("score", T.DoubleType())], run)
    return found.withColumnRenamed("__id", id_col)
