"""Index intervals: merging, coverage, membership, eviction and storage shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.operators.scan import BUCKET_ROWS, Running, bucket_of, longest_key, running

def merge_ranges(ranges: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Merge overlapping or adjacent intervals (chain_id, from_index, to_index, at).

    Intervals with one start collapse first. The running end and the start of the
    current island are then carried from bucket to bucket of the start index.
    """
    starts = ranges.groupBy("chain_id", "from_index").agg(
        F.max("to_index").alias("to_index"), F.max("at").alias("at")
    )
    bucket = bucket_of(F.col("from_index"), bucket_rows)
    longest = longest_key(starts, ["chain_id"])
    reached = running(
        starts,
        ["chain_id"],
        ["from_index"],
        bucket,
        {"__reached": Running("max", F.col("to_index"), inclusive=False)},
        longest,
        bucket_rows,
    )
    opens = F.col("__reached").isNull() | (F.col("from_index") > F.col("__reached") + 1)
    islands = running(
        reached,
        ["chain_id"],
        ["from_index"],
        bucket,
        {"__island": Running("max", F.when(opens, F.col("from_index")))},
        longest,
        bucket_rows,
    )
    return (
        islands.groupBy("chain_id", F.col("__island").alias("from_index"))
        .agg(F.max("to_index").alias("to_index"), F.max("at").alias("at"))
    )


def covered_from_zero(merged: DataFrame, upto: DataFrame) -> DataFrame:
    """Per chain of ``upto`` (chain_id, last_index): does one merged range cover 0..last_index?"""
    from_zero = merged.filter("from_index = 0").select("chain_id", "to_index")
    return upto.join(from_zero, "chain_id", "left").select(
        "chain_id",
        "last_index",
        F.coalesce(F.col("to_index") >= F.col("last_index"), F.lit(False)).alias("covered"),
    )


def last_verified_index(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("chain_id").agg(F.max("to_index").alias("last_verified"))


def range_status(entries: DataFrame, ranges: DataFrame, width: int = 4096) -> DataFrame:
    """Entries whose index lies in a range of their chain.

    The ranges are merged, cut at multiples of ``width`` and joined on (chain, bucket),
    so each entry meets only ranges near it and a long chain spreads out.
    """
    cut = merge_ranges(ranges).select(
        "chain_id",
        "from_index",
        "to_index",
        F.explode(
            F.sequence(F.floor(F.col("from_index") / width), F.floor(F.col("to_index") / width))
        ).alias("__bucket"),
    )
    e = entries.withColumn("__bucket", F.floor(F.col("index") / width)).alias("e")
    return e.join(
        cut.alias("r"),
        (F.col("e.chain_id") == F.col("r.chain_id"))
        & (F.col("e.__bucket") == F.col("r.__bucket"))
        & F.col("e.index").between(F.col("r.from_index"), F.col("r.to_index")),
        "left_semi",
    ).drop("__bucket")


def eviction_plan(
    chains: DataFrame,
    verified: DataFrame,
    durable: DataFrame,
    replicas: DataFrame,
    max_bytes: int,
    deployment_chain: str = "_deployment",
    bucket_rows: int = BUCKET_ROWS,
    require_verified: bool = True,
) -> DataFrame:
    """Chains to evict, oldest first, until usage is back under ``max_bytes``.

    ``chains``: chain_id, modified_ms, bytes, entry_count. ``verified`` and ``durable``
    are index ranges; ``replicas`` (chain_id, index) lists entries a replica still
    holds. Chains that may not be evicted use no budget.
    """
    used = chains.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    to_free = used - max_bytes
    if to_free <= 0:
        return chains.limit(0).select("*", F.lit(0).cast("bigint").alias("freed_before"))
    last = chains.filter(F.col("chain_id") != deployment_chain).withColumn(
        "last_index", F.greatest(F.col("entry_count") - 1, F.lit(0))
    )
    wanted = last.select("chain_id", "last_index")
    ok = last
    if require_verified:
        ok = ok.join(
            covered_from_zero(merge_ranges(verified), wanted).filter("covered").select("chain_id"),
            "chain_id",
            "left_semi",
        )
    at_last = wanted.withColumnRenamed("last_index", "index")
    has_durable = range_status(at_last, durable).select("chain_id").withColumn("__durable", F.lit(True))
    has_copy = replicas.select("chain_id", F.col("index").alias("last_index")).distinct().withColumn(
        "__copy", F.lit(True)
    )
    ok = (
        ok.join(has_durable, "chain_id", "left")
        .join(has_copy, ["chain_id", "last_index"], "left")
        .filter((F.col("entry_count") == 0) | (F.col("__durable") & F.col("__copy")))
        .select(*chains.columns)
    )
    freed = running(
        ok,
        [],
        ["modified_ms", "chain_id"],
        None,
        {"freed_before": Running("sum", F.col("bytes"), inclusive=False)},
        bucket_rows=bucket_rows,
    )
    freed = freed.withColumn("freed_before", F.coalesce("freed_before", F.lit(0)))
    return freed.filter(F.col("freed_before") < to_free)


def shard_of(index: Column, size: int = 10_000) -> Column:
    """Storage shard of an entry: number, half-open index range and file name."""
    number = F.floor(index / size).cast("bigint")
    return F.struct(
        number.alias("shard"),
        (number * size).alias("start"),
        ((number + 1) * size).alias("end"),
        F.format_string("chain_%04d.dat", number).alias("file"),
    )
