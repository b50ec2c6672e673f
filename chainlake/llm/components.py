"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no node's neighbours meet in one task. Edges are
written to the shared folder after every round, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.session import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges run from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node of its component.

    Edges with a null end and loops are ignored. An empty table gives an empty result.
    """
    one, two = F.col(a), F.col(b)
    edges = (
        edges.select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b"), one.alias("x"), two.alias("y"))
        .filter("x IS NOT NULL AND y IS NOT NULL AND a <> b")
        .select("a", "b")
        .distinct()
    )
    state, before = materialize(edges, "edges"), None
    while True:
        mark = state.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")),
        ).first()
        if mark == before or not mark[0]:
            break
        before = mark
        large = _large_star(state).distinct()
        state = materialize(_small_star(large).distinct(), "edges")
    roots = state.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
