"""Exact top-k search by integer inner product, in the three phases of a uniform threshold.

The columns of the vectors are cut into slices; a query's score is the sum of its partial scores over the slices.

1. Every task gathers, for each query and slice, its local list of the ``k`` best partial scores, and reports the whole
   scores of the vectors on these lists.
2. The ``k``-th best whole score reported for a query is a safe cutoff: the answer holds nothing below it. It is broadcast.
   A vector that reaches the cutoff must reach an equal share of it in one slice at least, so tasks collect just the
   entries whose partial score is at least ``cutoff / slices``; these are sufficient.
3. The scores of collected entries are resolved exactly from the remaining slices, and what is below the cutoff, or below
   the ``k`` best of the task by then, goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplewright.llm.strips import EXACT, Best, Strip, leading, strips, usable
from samplewright.session import scratch_path

SLICES = 2


def local_lists(strip: Strip, batches: Iterator[pa.RecordBatch], k: int, slices: int = SLICES) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 in a task: query and whole score of the vectors on its local lists, at most ``k`` a query."""
    lists = [Best(len(strip), k) for _ in range(slices)]
    for _, ids, queries, parts, bound in strip.tiles(batches, slices):
        whole = sum(parts[1:], parts[0])
        for held, part in zip(lists, parts):
            row, column = leading(part, k, np.maximum(held.least[queries], -bound))
            held.add(column + queries.start, part[row, column], ids[row], whole[row, column])
    owner, ids, whole = (np.concatenate([getattr(held, name) for held in lists]) for name in ("owner", "id", "value"))
    # a vector on several lists counts once
    order = np.lexsort((ids, -whole, owner))
    owner, ids, whole = owner[order], ids[order], whole[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]) | (whole[1:] != whole[:-1])
    best = Best(len(strip), k)
    best.add(owner[new], whole[new], ids[new])
    return best.owner, best.score


def sufficient(strip: Strip, batches: Iterator[pa.RecordBatch], cutoff: np.ndarray, k: int, slices: int = SLICES) -> Best:
    """Phases 2 and 3 in a task: its entries that reach the cutoff, at most the ``k`` best of each query, scores resolved."""
    best = Best(len(strip), k)
    best.least = np.maximum(best.least, cutoff)
    for _, ids, queries, parts, bound in strip.tiles(batches, slices):
        # what the task has found by now may be a higher cutoff
        cut = np.maximum(best.least[queries], cutoff[queries])
        # floats hold these whole numbers exactly, and half of them in double precision
        share = np.maximum(cut, -len(parts) * bound) / len(parts)
        enough = parts[0] >= share
        for part in parts[1:]:
            enough |= part >= share
        row, column = np.nonzero(enough)
        whole = sum(part[row, column].astype(np.int64) for part in parts)
        keep = whole >= cut[column]
        row, column, whole = row[keep], column[keep], whole[keep]
        # of equal copies only the k first of a tile can matter
        order = np.lexsort((row, -whole, column))
        row, column, whole = row[order], column[order], whole[order]
        keep = np.arange(len(column)) - np.searchsorted(column, column) < k
        best.add(column[keep] + queries.start, whole[keep], ids[row[keep]])
    return best


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, slices: int = SLICES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest integer inner products for each query.

    ``is_query`` is a condition on the rows of ``vectors`` (``vec_id, embedding``). Components become
    ``floor(scale * x)``. Rows without an id or a vector, or with null or non-finite components, take no part; a shorter
    vector counts as if zeros followed. A row is no candidate for a query with its id; equal scores go to the smaller id;
    a query with fewer than ``k`` candidates gets all. Rows that repeat an id are candidates each; a repeated query is
    asked once, queries with one id and different vectors each. Components too large for exact scores raise. Extra
    columns do not matter; a table without queries gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    schema, path = "query_id long, rank int, vec_id long, score long", scratch_path(spark, "top")
    spark.createDataFrame([], schema).write.parquet(f"{path}/strip=-1")
    for number, strip, shared in strips(usable(vectors.where(is_query)).dropDuplicates(["vec_id", "embedding"]), scale):

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query, score = local_lists(shared.value, batches, k, slices)
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(score)], names=["query", "score"])

        kth = Window.partitionBy("query").orderBy(F.desc("score"))
        reported = rows.mapInArrow(gather, "query int, score long").withColumn("place", F.row_number().over(kth)).where(F.col("place") == k)
        cutoff = np.full(len(strip), -float(EXACT))
        safe = reported.select("query", "score").toArrow()  # at most one row a query of the strip
        cutoff[safe["query"].to_numpy()] = safe["score"].to_numpy()
        cutoffs = spark.sparkContext.broadcast(cutoff)

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = sufficient(shared.value, batches, cutoffs.value, k, slices)
            yield pa.RecordBatch.from_arrays([pa.array(best.owner.astype(np.int32)), pa.array(shared.value.ids[best.owner]), pa.array(best.id), pa.array(best.score)],
                                             names=["query", "query_id", "vec_id", "score"])

        entries = rows.mapInArrow(collect, "query int, query_id long, vec_id long, score long")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.parquet(f"{path}/strip={number}")
        cutoffs.destroy()
    return spark.read.schema(schema).parquet(path).drop("strip")
