"""Building hash chains and verifying them in bulk."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.functions.crypto import is_hash_hex, row_entry_hash
from chainlake.operators import runs
from chainlake.operators.fold import SEGMENT_ROWS, fold_sorted
from chainlake.operators.linking import PACKED, block_heads, link_accepted, link_blocks, pack_blocks
from chainlake.operators.scan import BUCKET_ROWS, beside_rows, bucket_of, by_rank
from chainlake.schemas import (
    CHAIN_ENTRY_COLUMNS,
    ENTRY_VERSION,
    MAX_PAYLOAD_BYTES,
    TYPE_ACCESS,
    TYPE_DEPLOYMENT,
    TYPE_OBSERVED,
    ZERO_HASH,
)
from chainlake.session import materialize


#: Offsets that span more than so many times their number are cut by rank.
SPARSE = 4
#: Blocks of long chains whose heads the driver holds before it stores them.
HEADS_HELD = 100_000


def refusal(payload: str = "payload_json") -> Column:
    """Why a payload can't become an entry; null when it can."""
    size = F.octet_length(payload)
    return F.when(size.isNull(), "null_payload").when(size > MAX_PAYLOAD_BYTES, "payload_too_large")


def refused_payloads(payloads: DataFrame) -> DataFrame:
    """The payload rows that ``build_chains`` leaves out, each with its ``reason``."""
    return payloads.withColumn("reason", refusal()).filter("reason IS NOT NULL")


def build_chains(
    payloads: DataFrame,
    heads: DataFrame | None = None,
    order: tuple[str, ...] = ("event_id", "position"),
    keep: tuple[str, ...] = (),
    longest: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Give payload rows dense indexes and hash-link them per chain, in arrival order.

    ``payloads``: chain_id, timestamp (s), payload_type, payload_json and the order
    columns, of which the first is the non-negative source offset of the event.
    ``longest`` is the number of new rows of the largest chain, counted if not given.
    ``heads``: chain_id, entry_count, head of chains that already exist. ``keep`` names
    payload columns to carry through. Rows that ``refused_payloads`` names are left out.
    """
    order = list(order)
    carried = [c for c in dict.fromkeys([*order, *keep])]
    limit = min(bucket_rows, segment_rows)
    counts = None
    if longest is None or longest > limit:
        # One pass over the keys: rows of each chain and their span of offsets. Counted with refused rows, so that no
        # payload text is made for it.
        counts = payloads.groupBy(F.col("chain_id").alias("__long")).agg(
            F.count("*").alias("n"), F.min(order[0]).alias("low"), F.max(order[0]).alias("high")
        )
        counts = materialize(counts, "counts")
        seen = counts.agg(
            F.max("n").alias("longest"), (F.max("high") - F.min("low")).alias("span"), F.sum("n").alias("n"), F.min("n").alias("least")
        ).first()
        longest = seen["longest"] or 0
    # Refused rows are left out where the texts lie ready; a filter here would have Spark make each text twice.
    rows = payloads.select(
        "chain_id",
        F.col("timestamp").cast("bigint").alias("timestamp"),
        F.col("payload_type").cast("int").alias("payload_type"),
        "payload_json",
        *carried,
    )
    start = None
    if heads is not None:
        last = F.struct((F.col("entry_count").cast("bigint") - 1).alias("index"), F.col("head").alias("entry_hash"))
        start = heads.filter("entry_count > 0").select("chain_id", last.alias("last"))
    if longest <= limit:
        linked = _fold_links(rows, order, start)
    else:
        # At most (rows / limit) chains are this long.
        names = [r["__long"] for r in counts.filter(F.col("n") > limit).collect()]
        is_long = _one_of("chain_id", names)
        # Offsets that are far apart, such as hashes, would put each row into a segment of its own.
        dense = seen["span"] is None or seen["span"] <= SPARSE * seen["n"]
        of = lambda df, kept: None if df is None else df.filter(kept)
        linked = _fold_long(rows.filter(is_long), order, of(start, is_long), limit, dense, len(names) == 1)
        if seen["least"] <= limit:
            linked = _fold_links(rows.filter(~is_long), order, of(start, ~is_long)).unionByName(linked)
    linked = linked.withColumn("version", F.lit(ENTRY_VERSION).cast("int"))
    return linked.select(*CHAIN_ENTRY_COLUMNS, *keep)


def _fold_links(rows: DataFrame, order: list[str], start: DataFrame | None) -> DataFrame:
    """Number and link chains of a bounded length with one shuffle: the fold meets them in order.

    ``start``: chain_id and last (index, entry_hash), the entry that a chain goes on from.
    """
    if start is not None:
        before = [F.lit(-1 if c == order[0] else None).cast(rows.schema[c].dataType).alias(c) for c in order]
        state = F.concat_ws("|", (F.col("last.index") + 1).cast("string"), "last.entry_hash")
        start = start.select("chain_id", *before, state.alias("__state"))
    added = [T.StructField("index", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())]
    return fold_sorted(rows, start, "chain_id", order, T.StringType(), link_accepted, T.StructType(rows.schema.fields + added))


def _one_of(column: str, values: list) -> Column:
    """True where a column has one of few values, of which one may be null; never null."""
    found = F.coalesce(F.col(column).isin([v for v in values if v is not None]), F.lit(False))
    return found | F.col(column).isNull() if None in values else found


def _fold_long(rows: DataFrame, order: list[str], start: DataFrame | None, limit: int, dense: bool, alone: bool) -> DataFrame:
    """Link the few chains too long for one task, in segments of their arrival order.

    What must run one after the other is the digests: a round for each segment takes them over packed blocks and
    notes only the head before each block. The entries are then linked from those heads, block by block and in parallel.
    ``alone``: there is one chain.
    """
    spark = rows.sparkSession
    if dense:
        cut = rows.withColumn("__bucket", bucket_of(F.col(order[0]), limit))
    else:
        cut = by_rank(rows, [], order, limit)
    keys = ["__bucket", "chain_id"]
    packed = cut.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(pack_blocks(), PACKED)
    # Stored by segment once, so that each round reads only its own files.
    stored = materialize(packed, "fold-in", "__bucket")
    numbers = sorted(r[0] for r in stored.select("__bucket").distinct().collect())
    states = {} if start is None else {
        r["chain_id"]: (r["last"]["index"] + 1, bytes.fromhex(r["last"]["entry_hash"])) for r in start.collect()
    }
    found, held, size = [], [], 0

    def keep() -> None:
        nonlocal held, size
        found.append(materialize(spark.createDataFrame(pa.concat_tables(held)), "fold-heads"))
        held, size = [], 0

    for number in numbers:
        part = stored.filter(F.col("__bucket") == number).select("chain_id", "at", "rows")
        part = (part.coalesce(1) if alone else part.repartition("chain_id")).sortWithinPartitions("chain_id", "at")
        passed = part.mapInArrow(block_heads(states), "chain_id string, at bigint, count bigint, head binary").toArrow()
        ended = pc.is_null(passed.column("at"))
        for r in passed.filter(ended).to_pylist():
            states[r["chain_id"]] = r["count"], r["head"]
        blocks = passed.filter(pc.invert(ended))
        held.append(blocks.append_column("__bucket", pa.array([number] * blocks.num_rows, pa.int64())))
        size += blocks.num_rows
        if size > HEADS_HELD:
            keep()
    if held:
        keep()
    added = [T.StructField("index", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())]
    schema = T.StructType(rows.schema.fields + added)
    if not found:
        return spark.createDataFrame([], schema)
    heads = reduce(DataFrame.unionByName, found).withColumnRenamed("chain_id", "__chain")
    same = [stored[c] == heads[c] for c in ("__bucket", "at")] + [stored["chain_id"].eqNullSafe(heads["__chain"])]
    return stored.join(heads, same).select("rows", "count", "head").mapInArrow(link_blocks, schema)


def _own() -> Column:
    """What is checked of an entry; of several copies of an index the least one stands for it."""
    small = F.octet_length("payload_json") <= MAX_PAYLOAD_BYTES
    recomputed = F.coalesce(small & (row_entry_hash() == F.lower("entry_hash")), F.lit(False))
    return F.struct(
        F.col("entry_hash"),
        F.col("prev_hash"),
        F.coalesce(F.col("version") != ENTRY_VERSION, F.lit(True)).alias("bad_version"),
        F.col("payload_type"),
        (~recomputed).alias("bad_hash"),
    )


def link_groups(entries: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """One row per (chain, index) with the entry and the hash of the entry before it.

    Each entry is sent to its own slot and, as a predecessor, to the next one, so the
    shuffle key is (chain_id, index): a chain of any length spreads over all tasks.
    """
    own = _own()
    slots = entries.select(
        "chain_id",
        F.explode(
            F.array(
                F.struct(
                    F.col("index").alias("slot"), own.alias("own"), F.lit(None).cast("string").alias("before")
                ),
                F.struct(
                    (F.col("index") + 1).alias("slot"),
                    F.lit(None).cast(entries.select(own.alias("o")).schema["o"].dataType).alias("own"),
                    F.col("entry_hash").alias("before"),
                ),
            )
        ).alias("s"),
    ).select("chain_id", "s.slot", "s.own", "s.before", F.lit(None).cast("bigint").alias("start"))
    if trusted is not None:
        slots = slots.unionByName(
            trusted.select(
                "chain_id",
                F.col("entry_count").alias("slot"),
                F.lit(None).cast(slots.schema["own"].dataType).alias("own"),
                F.col("head").alias("before"),
                F.col("entry_count").cast("bigint").alias("start"),
            )
        )
    return slots.groupBy("chain_id", "slot").agg(
        F.count("own").alias("copies"),
        F.min("own").alias("own"),
        F.min("before").alias("before"),
        F.max("start").alias("start"),
    )


def _slot_error(types: list[int], check_type: bool) -> Column:
    """First failed check of the entry in a slot, in check order."""
    expected = F.when(F.col("before").isNotNull(), F.col("before")).when(
        F.col("slot") == 0, F.lit(ZERO_HASH)
    )
    error = F.when(F.col("own.bad_version"), "version")
    if check_type:
        known = F.coalesce(F.col("own.payload_type").isin(types), F.lit(False))
        error = error.when(~known, "payload_type")
    broken = expected.isNotNull() & ~F.col("own.prev_hash").eqNullSafe(expected)
    return (
        error.when(broken & (F.col("slot") == 0), "invalid_first")
        .when(broken, "broken_chain")
        .when(F.col("own.bad_hash"), "tampered_entry")
    )


def _by_slots(entries: DataFrame, types: list[int], check_type: bool, trusted: DataFrame | None) -> DataFrame:
    """(chain_id, entries, head, worst, start) of any table, also with gaps and repeated entries."""
    slots = link_groups(entries, trusted).withColumn("__error", _slot_error(types, check_type))
    present = F.col("copies") > 0
    found = F.when(
        F.col("__error").isNotNull() & present,
        F.struct(F.col("slot").alias("position"), F.lit(1).alias("rank"), F.col("__error").alias("error")),
    )
    repeated = F.when(
        F.col("copies") > 1,
        F.struct((F.col("slot") + 1).alias("position"), F.lit(0).alias("rank"), F.lit("index").alias("error")),
    )
    chains = slots.groupBy("chain_id").agg(
        F.sum("copies").alias("entries"),
        F.min(F.when(present, F.col("slot"))).alias("first"),
        F.max_by("own.entry_hash", F.when(present, F.col("slot"))).alias("head"),
        F.max(F.when(present, F.col("slot"))).alias("last"),
        F.min(F.when(~present & F.col("before").isNotNull(), F.col("slot"))).alias("gap"),
        F.min(F.least(found, repeated)).alias("worst"),
        F.coalesce(F.max("start"), F.lit(0)).alias("start"),
        F.max(F.when(F.col("start").isNotNull(), F.col("before"))).alias("trusted_head"),
    )
    gap_error = F.when(
        F.col("first") != F.col("start"),
        F.struct(F.col("start").alias("position"), F.lit(0).alias("rank"), F.lit("index").alias("error")),
    ).when(
        F.col("gap") <= F.col("last"),
        F.struct(F.col("gap").alias("position"), F.lit(0).alias("rank"), F.lit("index").alias("error")),
    )
    return chains.select(
        "chain_id",
        "entries",
        F.coalesce("head", "trusted_head", F.lit(ZERO_HASH)).alias("head"),
        F.least("worst", gap_error).alias("worst"),
        "start",
    )


def _by_runs(entries: DataFrame, types: list[int], check_type: bool, trusted: DataFrame | None) -> DataFrame:
    """What ``_by_slots`` gives, and ``regular``: the runs of the chain lie end to end from its start.

    Only then do the other columns hold. One row for each run, and one for where the next has to
    begin, meet by (chain, index).
    """
    small = F.octet_length("payload_json") <= MAX_PAYLOAD_BYTES
    recomputed = F.coalesce(small & (row_entry_hash() == F.lower("entry_hash")), F.lit(False))
    known = F.coalesce(F.col("payload_type").isin(types), F.lit(False)) if check_type else F.lit(True)
    flags = (
        F.when(F.coalesce(F.col("version") != ENTRY_VERSION, F.lit(True)), runs.BAD_VERSION).otherwise(0)
        + F.when(~known, runs.BAD_TYPE).otherwise(0)
        + F.when(~recomputed, runs.BAD_HASH).otherwise(0)
    )
    found = runs.find_runs(entries.withColumn("flags", flags))
    own = F.struct("prev_hash", "flags", "last", "n", "head", "at", "error")
    none = F.lit(None).cast("bigint")
    slots = found.select("chain_id", F.col("first").alias("slot"), own.alias("own"), F.lit(None).cast("string").alias("before"), none.alias("start"))
    slots = slots.unionByName(
        found.select("chain_id", (F.col("last") + 1).alias("slot"), F.col("head").alias("before")), allowMissingColumns=True
    )
    if trusted is not None:
        slots = slots.unionByName(
            trusted.select(
                "chain_id", F.col("entry_count").cast("bigint").alias("slot"), F.col("head").alias("before"),
                F.col("entry_count").cast("bigint").alias("start"),
            ),
            allowMissingColumns=True,
        )
    met = slots.groupBy("chain_id", "slot").agg(
        F.count("own").alias("begin"), F.count("before").alias("end"), F.count(F.when(F.col("own").isNull() & F.col("before").isNull(), 1)).alias("bare"),
        F.min("own").alias("own"), F.min("before").alias("before"), F.max("start").alias("start"),
    )
    expected = F.coalesce("before", F.when(F.col("slot") == 0, F.lit(ZERO_HASH)))
    broken = ~F.col("own.prev_hash").eqNullSafe(expected)
    has = lambda bit: F.col("own.flags").bitwiseAND(F.lit(bit)) > 0
    first_error = (
        F.when(has(runs.BAD_VERSION), "version").when(has(runs.BAD_TYPE), "payload_type")
        .when(broken & (F.col("slot") == 0), "invalid_first").when(broken, "broken_chain").when(has(runs.BAD_HASH), "tampered_entry")
    )
    names = F.create_map(*[F.lit(x) for pair in runs.ERRORS.items() for x in pair])
    at_first = F.when(F.col("own").isNotNull() & first_error.isNotNull(), F.struct(F.col("slot").alias("position"), F.lit(1).alias("rank"), first_error.alias("error")))
    inside = F.when(F.col("own.error").isNotNull(), F.struct(F.col("own.at").alias("position"), F.lit(1).alias("rank"), names[F.col("own.error")].alias("error")))
    loose = F.col("own").isNotNull() & F.col("before").isNull() & (F.col("slot") != 0)
    chains = met.groupBy("chain_id").agg(
        F.coalesce(F.sum("own.n"), F.lit(0)).alias("entries"),
        F.min(F.when(F.col("own").isNotNull(), F.col("slot"))).alias("first"),
        F.max("own.last").alias("last"),
        F.max_by("own.head", "own.last").alias("head"),
        F.min(F.least(at_first, inside)).alias("worst"),
        F.coalesce(F.max("start"), F.lit(0)).alias("start"),
        F.max(F.when(F.col("start").isNotNull(), F.col("before"))).alias("trusted_head"),
        F.max((F.col("begin") > 1) | (F.col("end") > 1) | (F.col("bare") > 0) | loose | F.col("slot").isNull()).alias("odd"),
    )
    tiled = (F.col("first") == F.col("start")) & (F.col("last") - F.col("first") + 1 == F.col("entries"))
    return chains.select(
        "chain_id", F.col("entries"), F.coalesce("head", "trusted_head", F.lit(ZERO_HASH)).alias("head"), "worst", "start",
        (~F.col("odd") & F.coalesce(tiled, F.col("first").isNull())).alias("regular"),
    )


def verify_chains(
    entries: DataFrame,
    expected_heads: DataFrame | None = None,
    profile: str = "spec",
    check_type: bool = True,
    trusted: DataFrame | None = None,
) -> DataFrame:
    """Check every entry of every chain; one row per chain with its first error.

    Checks per entry, in order: version, index (missing, repeated or not starting where
    it should), payload type, link to the entry before, recomputed hash; then, where
    ``expected_heads`` (chain_id, expected_head) names the chain, its head. ``trusted``
    (chain_id, entry_count, head) makes the check incremental: entries must continue it.
    Profile ``two_types`` accepts payload types 1 and 2 only.
    """
    types = [TYPE_ACCESS, TYPE_DEPLOYMENT] + ([] if profile == "two_types" else [TYPE_OBSERVED])
    verdicts = materialize(_by_runs(entries, types, check_type, trusted), "runs")
    chains = verdicts.filter("regular").drop("regular")
    odd = verdicts.filter("NOT regular").select("chain_id")
    if not odd.isEmpty():
        odd = beside_rows(odd.withColumnRenamed("chain_id", "__odd"))
        mine = lambda df: df.join(odd, F.col("chain_id").eqNullSafe(F.col("__odd")), "left_semi")
        chains = chains.unionByName(_by_slots(mine(entries), types, check_type, None if trusted is None else mine(trusted)))
    error, position = F.col("worst.error"), F.col("worst.position")
    if expected_heads is not None:
        chains = (
            expected_heads.select("chain_id", "expected_head")
            .join(chains, "chain_id", "full_outer")
            .withColumn("entries", F.coalesce("entries", F.lit(0)))
            .withColumn("head", F.coalesce("head", F.lit(ZERO_HASH)))
        )
        wrong = F.col("expected_head").isNotNull() & ~head_matches(F.col("head"), F.col("expected_head"))
        error = F.coalesce(error, F.when(wrong, "head_mismatch"))
        position = F.coalesce(position, F.when(wrong, F.col("entries")))
    return chains.select(
        "chain_id",
        F.col("entries").cast("bigint"),
        "head",
        error.isNull().alias("ok"),
        F.coalesce(position - F.col("start"), F.col("entries")).cast("bigint").alias("valid_prefix"),
        error.alias("error"),
    )


def head_matches(head: Column, expected: Column) -> Column:
    """True when the expected head is well-formed and equal; an empty chain has the zero head."""
    return F.coalesce(is_hash_hex(expected) & (F.lower(expected) == head), F.lit(False))


def verify_heads(entries: DataFrame) -> DataFrame:
    """Recompute only the last entry of each chain."""
    last = entries.groupBy("chain_id").agg(F.max_by(F.struct(*CHAIN_ENTRY_COLUMNS[1:]), "index").alias("e"))
    return last.select("chain_id", "e.*").select(
        "chain_id",
        F.col("index").alias("last_index"),
        F.col("entry_hash").alias("head"),
        (row_entry_hash() == F.col("entry_hash")).alias("ok"),
    )


def verify_incremental(new: DataFrame, trusted: DataFrame, profile: str = "spec") -> DataFrame:
    """``verify_chains`` for the entries after a trusted head."""
    return verify_chains(new, profile=profile, trusted=trusted)


def link_check(entries: DataFrame) -> DataFrame:
    """Per entry: does it follow an entry before it? Hashes are not recomputed.

    Rows that follow the row they lie behind are done where they are. The few others, the first ones
    of runs and those in doubt, look for any entry of the index before. Each row of the table gives one row,
    also repeated ones.
    """
    narrow = entries.select("chain_id", "index", "prev_hash", "entry_hash")
    checked = narrow.mapInArrow(runs.local_links, "chain_id string, index bigint, prev_hash string, linked boolean")
    here = checked.filter("linked").select("chain_id", "index", "linked", F.lit(True).alias("has_predecessor"))
    doubt = checked.filter("NOT linked").select("chain_id", "index", "prev_hash")
    asked = doubt.select("chain_id", "index").distinct()
    earlier = narrow.select("chain_id", (F.col("index") + 1).alias("index"), F.col("entry_hash").alias("__before"))
    answers = earlier.join(asked, ["chain_id", "index"], "left_semi").distinct()
    hashes = answers.groupBy("chain_id", "index").agg(F.collect_set("__before").alias("__before"))
    first = F.col("index") == 0
    matches = F.coalesce(F.array_contains("__before", F.col("prev_hash")), F.lit(False))
    rest = doubt.join(hashes, ["chain_id", "index"], "left").select(
        "chain_id", "index",
        F.when(first, F.coalesce(F.col("prev_hash") == ZERO_HASH, F.lit(False))).otherwise(matches).alias("linked"),
        (first | F.col("__before").isNotNull()).alias("has_predecessor"),
    )
    return here.unionByName(rest)


def last_valid(entries: DataFrame) -> DataFrame:
    """Length of the longest valid prefix of each chain, payload types not checked."""
    return verify_chains(entries, check_type=False).select(
        "chain_id",
        "entries",
        "valid_prefix",
        (~F.col("ok")).alias("needs_recovery"),
    )


def truncate_to_valid(entries: DataFrame) -> DataFrame:
    """Keep only the valid prefix of each chain, one copy of each of its entries.

    A repeated entry ends the prefix of its chain with the error "index", so copies are looked for there only.
    """
    damaged = verify_chains(entries, check_type=False).filter("NOT ok")
    damaged = damaged.select("chain_id", "valid_prefix", F.when(F.col("error") == "index", F.col("valid_prefix") - 1).alias("__last"))
    keep = beside_rows(materialize(damaged, "valid"))
    kept = entries.join(keep, "chain_id", "left").filter(F.col("valid_prefix").isNull() | (F.col("index") < F.col("valid_prefix")))
    last = F.coalesce(F.col("index") == F.col("__last"), F.lit(False))
    copies = Window.partitionBy("chain_id", "index").orderBy("__own")
    ends = kept.filter(last).withColumn("__own", _own()).withColumn("__copy", F.row_number().over(copies)).filter("__copy = 1")
    return kept.filter(~last).select(*entries.columns).unionByName(ends.select(*entries.columns))


def bisect_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """First index at which two copies of a chain differ, one row per diverging chain."""
    left = a.select("chain_id", "index", F.col("entry_hash").alias("a"))
    right = b.select("chain_id", "index", F.col("entry_hash").alias("b"))
    return (
        left.join(right, ["chain_id", "index"], "full_outer")
        .filter(~F.col("a").eqNullSafe(F.col("b")))
        .groupBy("chain_id")
        .agg(F.min("index").alias("first_divergence"), F.count("*").alias("differing_entries"))
    )


def genesis(chain_ids: DataFrame) -> DataFrame:
    """Empty chains: no entries, zero head, valid."""
    return chain_ids.select(
        "chain_id",
        F.lit(0).cast("bigint").alias("entry_count"),
        F.lit(ZERO_HASH).alias("head"),
        F.lit(True).alias("ok"),
    )


def reject_partial_prefix(entries: DataFrame) -> DataFrame:
    """Chains whose first stored index is above zero."""
    return (
        entries.groupBy("chain_id").agg(F.min("index").alias("first_index")).filter("first_index > 0")
    )
