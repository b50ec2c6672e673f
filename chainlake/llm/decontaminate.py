"""Benchmark decontamination: windows of benchmark words found in training documents.

The normalised word windows of the benchmark form a hash set of a measured size. It is
broadcast while it has at most ``broadcast_windows`` entries (and four item names for each of
them); a larger set is joined by a shuffle on the window hash. Every document is cut into words once, its windows are hashed
inside generated code, and a hash hit counts only after its words have been compared.

Null and empty texts have no words and no hits. A row of the documents is a document of its
own, also if ids repeat or are null. Benchmark rows without words or without an id give no
window; rows with the same id are one item. Columns other than the named ones are kept by
``remove_spans`` and ``drop_documents`` and ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.llm.common import fold_ascii, sha256_of
from chainlake.session import materialize

WINDOW = 10
BROADCAST_WINDOWS = 1_000_000
#: Item names that may be broadcast for each of these windows, on average.
ITEMS_A_WINDOW = 4
#: Fixed value: everything that separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(fold_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct (hash, gram, items) of all windows; a shorter item is one window."""
    words = benchmark.filter(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")
    )
    n = F.size("w")
    at = words.filter(n > 0).select(
        "item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))).alias("p")
    )
    gram = at.select("item", F.slice("w", F.col("p"), window).alias("gram"))
    return gram.groupBy("gram").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64("gram").alias("hash"), "gram", "items"
    )


def _window_rows(documents: DataFrame, kept: list[str], lengths: list[int], first: int) -> DataFrame:
    """One row per window from position ``first``: ``kept``, __n, __at, __len, __gram. Position 0 is no window."""
    n = F.size("__w")
    places = F.explode(F.filter(F.sequence(F.lit(0), n), lambda x: x >= first)) if first else F.explode(F.sequence(F.lit(0), n))
    rows = documents.select(*kept, "__w", n.alias("__n"), places.alias("__at"))
    starts = [F.when(F.col("__at") <= F.col("__n") - L + 1, L) for L in lengths]
    if len(lengths) == 1:
        rows = rows.withColumn("__len", starts[0])
    elif lengths:
        rows = rows.withColumn("__len", F.explode(F.array(*starts)))
    else:
        rows = rows.withColumn("__len", F.lit(None).cast("int"))
    rows = rows.filter("__at = 0 OR __len IS NOT NULL")
    gram = F.slice("__w", F.greatest(F.col("__at"), F.lit(1)), F.coalesce(F.col("__len"), F.lit(1)))
    return rows.select(*kept, "__n", "__at", "__len", F.when(F.col("__at") > 0, gram).alias("__gram"))


def _hits(documents: DataFrame, windows: DataFrame, lengths: list[int], shared: bool) -> DataFrame:
    """One row per document start and per hit: (__row, kept columns, __n, __at, __len, __items).

    ``documents`` holds ``__row``, ``__w`` and what is to be kept. The start row has a null ``__len`` and the place 0; only
    it is sure to have ``__doc``. Windows that are not ``shared`` (broadcast) meet the documents' by a shuffle of
    (document number, place, hash): neither texts nor words travel with them, and words are compared where a hash is met.
    """
    kept = [c for c in documents.columns if c != "__w"]
    right = windows.select(
        F.col("hash").alias("__whash"), F.col("gram").alias("__wgram"), F.col("items").alias("__items")
    )
    if shared:
        # Position 0 stands for the document itself, so that one without hits keeps a row.
        rows = _window_rows(documents, kept, lengths, 0)
        rows = rows.withColumn("__hash", F.when(F.col("__at") > 0, F.xxhash64("__gram")))
        same = (F.col("__hash") == F.col("__whash")) & (F.col("__gram") == F.col("__wgram"))
        found = rows.join(F.broadcast(right), same, "left")
        return found.filter("__at = 0 OR __items IS NOT NULL").drop("__hash", "__gram", "__whash", "__wgram")
    # Written once, so that document numbers are the same for both uses.
    documents = materialize(documents, "windows")
    slim = [c for c in kept if c != "__doc"]
    places = _window_rows(documents, ["__row"], lengths, 1).select(
        "__row", "__at", "__len", F.xxhash64("__gram").alias("__whash")
    )
    met = places.join(right, "__whash").join(documents.select(*slim, "__w"), "__row")
    met = met.filter(F.slice("__w", F.col("__at"), F.col("__len")) == F.col("__wgram"))
    starts = documents.select(*kept, F.size("__w").alias("__n"), F.lit(0).alias("__at"), F.lit(None).cast("int").alias("__len"))
    hits = met.select(*slim, F.size("__w").alias("__n"), "__at", "__len", "__items")
    return starts.unionByName(hits, allowMissingColumns=True)


def _prepared(benchmark: DataFrame, item_col: str, text_col: str, window: int, broadcast_windows: int):
    """Windows, their lengths, and whether windows and the items they name are few enough to be broadcast."""
    windows = benchmark_windows(benchmark, item_col, text_col, window)
    # At most ``window`` rows.
    shape = windows.groupBy(F.size("gram").alias("len")).agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items")).collect()
    few = sum(r["n"] for r in shape) <= broadcast_windows
    return windows, sorted(r["len"] for r in shape), few and sum(r["items"] for r in shape) <= ITEMS_A_WINDOW * broadcast_windows


def scan(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document: ``id_col``, n_words, hit_words (sorted word numbers from 1), items (sorted)."""
    windows, lengths, shared = _prepared(benchmark, item_col, item_text_col, window, broadcast_windows)
    docs = documents.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(id_col).alias("__id"),
        words_of(F.col(text_col)).alias("__w"),
    )
    hits = _hits(docs, windows, lengths, shared)
    spans = F.collect_set(F.when(F.col("__at") > 0, F.struct("__at", "__len")))
    found = hits.groupBy("__row", "__id").agg(
        F.max("__n").cast("long").alias("n_words"),
        spans.alias("__spans"),
        F.collect_set("__items").alias("__items"),
    )
    covered = F.flatten(
        F.transform("__spans", lambda s: F.sequence(s["__at"], s["__at"] + s["__len"] - 1))
    )
    return found.select(
        F.col("__id").alias(id_col),
        "n_words",
        F.array_sort(F.array_distinct(covered)).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten("__items"))).alias("items"),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the result of ``scan``."""
    return found.select(
        id_col,
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256_of(F.col("items")).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def remove_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The documents with every hit word taken out of ``text_col``; other text stays as it is.

    A removed run leaves the separators around it. Texts without a hit, also null ones, are unchanged.
    """
    windows, lengths, shared = _prepared(benchmark, item_col, item_text_col, window, broadcast_windows)
    order = documents.columns
    packed = documents.select(
        F.monotonically_increasing_id().alias("__row"),
        F.struct(*[F.col(c) for c in order]).alias("__doc"),
        words_of(F.col(text_col)).alias("__w"),
    )
    # The whole document travels on its start row only.
    slim = F.when(F.col("__at") == 0, F.col("__doc")).alias("__doc")
    hits = _hits(packed, windows, lengths, shared)
    hits = hits.select("__row", slim, "__at", "__len")
    found = hits.groupBy("__row").agg(
        F.max_by("__doc", F.when(F.col("__at") == 0, 1)).alias("__doc"),
        F.collect_set(F.when(F.col("__at") > 0, F.struct("__at", "__len"))).alias("__spans"),
    )
    hit = F.array_distinct(
        F.flatten(F.transform("__spans", lambda s: F.sequence(s["__at"], s["__at"] + s["__len"] - 1)))
    )
    found = found.withColumn("__hit", hit)
    text = F.col(f"__doc.{text_col}")
    # Words and the separators before them; the tail after the last word is one more piece.
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*\z", 0)
    gap = lambda p: F.regexp_extract(p, r"\A[\x00-\x2F\x3A-\x60\x7B-\x7F]*", 0)
    kept = F.transform(pieces, lambda p, i: F.when(F.array_contains("__hit", i + 1), gap(p)).otherwise(p))
    clean = F.when(F.size("__hit") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"__doc.{c}").alias(c) for c in order])


def drop_documents(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The documents without a single hit word, unchanged."""
    windows, lengths, shared = _prepared(benchmark, item_col, item_text_col, window, broadcast_windows)
    order = documents.columns
    packed = documents.select(
        F.monotonically_increasing_id().alias("__row"),
        F.struct(*[F.col(c) for c in order]).alias("__doc"),
        words_of(F.col(text_col)).alias("__w"),
    )
    hits = _hits(packed, windows, lengths, shared).select(
        "__row", F.when(F.col("__at") == 0, F.col("__doc")).alias("__doc"), "__at"
    )
    found = hits.groupBy("__row").agg(
        F.max_by("__doc", F.when(F.col("__at") == 0, 1)).alias("__doc"), F.max("__at").alias("__last")
    )
    return found.filter("__last = 0").select(*[F.col(f"__doc.{c}").alias(c) for c in order])
