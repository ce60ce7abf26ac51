"""Connected components of an undirected graph by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ticketlake.llm.common import settle


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs each node's larger neighbours on the smallest of its neighbours and itself."""
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    least = settle(
        both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    )
    larger = both.filter("other > node").join(least, "node")
    return larger.select(F.col("other").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours on the smallest of them."""
    least = settle(edges.groupBy("a").agg(F.min("b").alias("least")))
    moved = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.toDF("a", "b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links`` (two long columns); the component is its
    smallest node. Loops and repeated links don't matter; no links give no rows.

    Both steps are a partially aggregated minimum, checkpointed, and a join of two plain shuffles,
    which the engine may split at a node with any share of the links. Every round is checkpointed;
    only a count and a checksum come to the driver. Rounds grow with the
    logarithm of the nodes.
    """
    x, y = (F.col(c) for c in links.columns[:2])
    edges = (
        links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .filter("a <> b")
        .distinct()
    )
    edges = settle(edges)
    state = _state(edges)
    while state[0]:
        edges = settle(_small_star(settle(_large_star(edges))))
        last, state = state, _state(edges)
        if state == last:
            break
    least = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(least)
