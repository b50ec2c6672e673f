"""Ordered folds: recurrences whose next state needs the previous one.

Different keys run in parallel. Within a key the work is serial by definition, so a
key longer than ``segment_rows`` is cut into segments that run one after the other,
each as a task of its own that starts from the stored state of the segment before.
A lost executor repeats one segment, and no task holds more than one segment of a
key. Rows stream through as Arrow batches; only the state is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chainlake.session import new_path

SEGMENT_ROWS = 5_000_000


def _fold_batches(step: Callable, key: str, inputs: list[str], names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            rows = zip(
                batch.column(key).to_pylist(),
                batch.column("__seed").to_pylist(),
                batch.column("__state").to_pylist(),
                zip(*[batch.column(n).to_pylist() for n in inputs]),
            )
            results = []
            for k, seed, start, values in rows:
                if k != current:
                    current, state = k, None
                if seed:
                    state = start
                    continue
                state, out = step(state, *values)
                results.append(out)
            if len(results) < batch.num_rows:
                batch = batch.filter(pc.invert(batch.column("__seed")))
            kept = [n for n in batch.schema.names if n not in ("__state", "__seed")]
            columns = zip(*results) if results else [[] for _ in names]
            outs = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + outs, kept + names)

    return run


def fold_sorted(
    part: DataFrame, states: DataFrame | None, key: str, order: list[str], state_type: T.DataType, run: Callable, schema: T.StructType
) -> DataFrame:
    """Hand the rows of each key in ``order``, behind a row with ``__seed`` and its ``__state`` if there is one, to ``run``."""
    rows = part.select("*", F.lit(None).cast(state_type).alias("__state"), F.lit(False).alias("__seed"))
    if states is not None:
        rows = rows.unionByName(
            states.select(
                key, *order, F.col("__state").cast(state_type).alias("__state"), F.lit(True).alias("__seed")
            ),
            allowMissingColumns=True,
        )
    ready = rows.repartition(key).sortWithinPartitions(key, *order, F.desc("__seed"))
    return ready.mapInArrow(run, schema)


def ordered_fold(
    df: DataFrame,
    key: str,
    index: str | list[str],
    step: Callable,
    inputs: list[str],
    out: list[T.StructField],
    start: DataFrame | None,
    longest: int,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Fold each key in ``index`` order and append the columns ``out``.

    ``step(state, *inputs)`` gets the values of the columns named by ``inputs`` and returns
    ``(new_state, out_values)``. The last out column is the stored state that the
    next segment starts from. ``index`` is dense per key but may start anywhere.
    ``start`` has ``(key, index, __state)`` rows: the state just before that index.
    ``longest`` bounds the number of rows of any key. For keys of one segment ``index`` may be a list
    of columns of any order.
    """
    order = [index] if isinstance(index, str) else index
    spark = df.sparkSession
    state_type = out[-1].dataType
    out_schema = T.StructType(df.schema.fields + out)
    names, types = [f.name for f in out], [to_arrow_type(f.dataType) for f in out]

    def fold(part: DataFrame, states: DataFrame | None) -> DataFrame:
        run = _fold_batches(step, key, inputs, names, types)
        return fold_sorted(part, states, key, order, state_type, run, out_schema)

    if longest <= segment_rows:
        return fold(df, start)

    # Store the rows by segment once, so that each round reads only its own files.
    path_in, path_out = new_path(spark, "fold-in"), new_path(spark, "fold-out")
    segment = F.floor(F.col(index) / segment_rows).cast("bigint")
    df.withColumn("__segment", segment).write.partitionBy("__segment").parquet(path_in)
    first, last = (
        spark.read.parquet(path_in).agg(F.min("__segment"), F.max("__segment")).first()
    )
    done: list[str] = []
    for number in range(first, last + 1):
        part = (
            spark.read.parquet(path_in).filter(F.col("__segment") == number).select(*df.columns)
        )
        states = None if start is None else start.filter(segment == number)
        if done:
            tails = (
                spark.read.schema(out_schema)
                .parquet(done[-1])
                .filter(F.col(index) == number * segment_rows - 1)
                .select(key, (F.col(index) + 1).alias(index), F.col(names[-1]).alias("__state"))
            )
            states = tails if states is None else states.unionByName(tails)
        target = f"{path_out}/segment={number}"
        fold(part, states).write.parquet(target)
        done.append(target)
    return spark.read.schema(out_schema).parquet(*done)

