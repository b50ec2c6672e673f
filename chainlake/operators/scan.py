"""Running aggregates that stay spread out when one key is very large.

``Window.partitionBy(key)`` puts every row of a key into one task. That is fine up to
``bucket_rows`` rows. Keys above it (found by a count) are cut into buckets of their
order column: a partially aggregated ``groupBy`` summarises each bucket, a window over
those few summaries gives the value carried into each bucket, and one carry row per
bucket joins the bucket's own rows in a window partitioned by (key, bucket). No task
sees more than a bucket, and small keys pay nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlake.session import materialize

BUCKET_ROWS = 1_000_000
#: Keys whose rows are broadcast to the rows of a larger table.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Running:
    """One running measure: ``kind`` is sum, max or last (last non-null value)."""

    kind: str
    value: Column
    inclusive: bool = True


def bucket_of(order: Column, width: int = BUCKET_ROWS) -> Column:
    """Bucket number of an integer order column; unique values give ``width`` rows at most."""
    return F.floor(order / width).cast("bigint")


def by_rank(df: DataFrame, keys: list[str], order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``__bucket``: ranges of about half of ``bucket_rows`` rows along (keys, order), whatever its values.

    Spark samples the boundaries; the rows are written, so that a repeated task finds the same ones.
    """
    parts = max(2, -(-2 * df.count() // bucket_rows))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return materialize(ranged.withColumn("__bucket", F.spark_partition_id().cast("bigint")), "ranges")


def beside_rows(keyed: DataFrame) -> DataFrame:
    """A stored table of one row a key, to be joined with rows by that key.

    It is broadcast while it has few keys, whatever its bytes, so that the rows, with their payloads, are neither
    shuffled nor put out of order; not where broadcasts are switched off.
    """
    off = keyed.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    return keyed if off or keyed.count() > BROADCAST_KEYS else F.broadcast(keyed)


def longest_key(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest key; reads only the key columns."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


_COMBINE = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _frames(partition: list[str], order: list[str], measures: dict[str, Running]) -> list[Column]:
    window = Window.partitionBy(*partition).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return [
        _COMBINE[m.kind](f"__in_{n}").over(upto if m.inclusive else earlier).alias(n)
        for n, m in measures.items()
    ]


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column | None,
    measures: dict[str, Running],
    longest: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add the running ``measures`` of each key in ``order``.

    ``bucket`` must not decrease along ``order`` and ``order`` must be total. Without one,
    buckets are cut by rank, for orders whose values are bunched or sparse. ``longest``
    is the row count of the largest key, counted here when the caller does not know it.
    """
    base = df.select("*", *[m.value.alias(f"__in_{name}") for name, m in measures.items()])
    if (longest_key(df, keys) if longest is None else longest) <= bucket_rows:
        return base.select(*df.columns, *_frames(keys, order, measures))

    base = by_rank(base, keys, order, bucket_rows) if bucket is None else base.withColumn("__bucket", bucket)
    if keys:
        # At most (rows / bucket_rows) keys can be this large, so the list is broadcast.
        large = df.groupBy(*keys).count().filter(F.col("count") > bucket_rows)
        large = F.broadcast(
            large.select(*[F.col(k).alias(f"__large_{k}") for k in keys], F.lit(True).alias("__large"))
        )
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__large_{k}")) for k in keys])
        base = base.join(large, same, "left").drop(*[f"__large_{k}" for k in keys])
    else:
        base = base.withColumn("__large", F.lit(True))
    # Small keys keep all their rows in one bucket and need no carry row.
    base = base.withColumn("__bucket", F.when(F.col("__large"), F.col("__bucket")))

    order_key = F.struct(*[F.col(c) for c in order])
    partials = []
    for name, m in measures.items():
        value = F.col(f"__in_{name}")
        if m.kind == "last":
            partials.append(F.max_by(value, F.when(value.isNotNull(), order_key)).alias(f"__in_{name}"))
        else:
            partials.append(_COMBINE[m.kind](value).alias(f"__in_{name}"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        base.filter("__large")
        .groupBy(*keys, "__bucket")
        .agg(*partials)
        .select(
            *keys,
            "__bucket",
            *[_COMBINE[m.kind](f"__in_{n}").over(before).alias(f"__in_{n}") for n, m in measures.items()],
            F.lit(0).alias("__row"),
        )
    )
    rows = base.drop("__large").withColumn("__row", F.lit(1))
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .select(*df.columns, "__row", *_frames([*keys, "__bucket"], ["__row", *order], measures))
        .filter("__row = 1")
        .drop("__row")
    )


def dense_ordinal(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column | None,
    name: str,
    longest: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in ``order``."""
    count = {name: Running("sum", F.lit(1))}
    out = running(df, keys, order, bucket, count, longest, bucket_rows)
    return out.withColumn(name, F.col(name) - 1)
