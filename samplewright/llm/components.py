"""Connected components of an edge table by alternating star steps, all on joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: hang neighbours below the smallest one.

    The large step looks at all neighbours of a node and moves the greater ones, the small step looks at the smaller
    ones only. No neighbourhood is collected: a minimum per node is joined back to its edges.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, component`` for every node of the edges ``a > b``; the component is its smallest node.

    ``known`` is an earlier result that further edges are added to: its stars stand for the edges it was made from.
    Each round halves path lengths at least; a round ends in the shared scratch folder, so a lost executor costs
    one round. An edge table without rows gives no rows.
    """
    if known is not None:
        edges = edges.select("a", "b").union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, size = None, _signature(now)
    while size != before and size[0]:
        now, before = written(_star(_star(now, True), False), "edges"), size
        size = _signature(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
