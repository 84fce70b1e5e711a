"""Approximate nearest neighbours by inner product: probed lists, scanned with an adaptive number of dimensions.

Vectors are rotated at random and dealt to lists around centroids. Within a probed list, queries and vectors meet block by
block; partial inner products grow one block of columns at a time, and after each block a hypothesis test abandons the
vectors that would hardly reach the query's current worst neighbour. What is left is scored on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplewright.llm.common import bounded_batches, written

# Rotation, centroids and the number of probed lists are fitted on at most this many vectors (smallest hash of the id).
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 256
MOST_LISTS = 4096
# Share of the sample's true neighbours that the probed lists must hold.
PROBED_SHARE = 0.97
# Vectors and queries of one group, about.
BLOCK = 4096
QUERIES = 2048
COLUMNS = 16
# A vector is abandoned when its partial product is this many standard deviations below what a neighbour's would be.
DEVIATIONS = 2.75
TIE = 1e-9


@dataclass
class Index:
    rotation: np.ndarray   # dimension x dimension, orthogonal
    centroids: np.ndarray  # lists x dimension
    probes: int

    def lists(self, vectors: np.ndarray) -> np.ndarray:
        """Nearest centroid of each vector."""
        gap = (self.centroids ** 2).sum(axis=1) - 2 * vectors @ self.centroids.T
        return gap.argmin(axis=1).astype(np.int32)

    def probed(self, queries: np.ndarray, held: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of the lists each query looks at: those whose centroids have the largest products with it.

        A query goes on until its lists hold the vectors it needs; ``held`` has the vectors of each list.
        """
        product = queries @ self.centroids.T
        order = np.argsort(-product, axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        row, place = np.nonzero((np.arange(len(held)) < self.probes) | (before < need[:, None]))
        return row, order[row, place].astype(np.int32)


def fit(sample: np.ndarray, lists: int, k: int = 20, seed: int = 11, rounds: int = 12) -> Index:
    """Rotation, centroids and probe count from a bounded sample."""
    random = np.random.default_rng(seed)
    n, dimension = sample.shape
    rotation = np.linalg.qr(random.standard_normal((dimension, dimension)))[0]
    different = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(different)))
    centroids = different[random.choice(len(different), lists, replace=False)]
    index = Index(rotation, centroids, lists)
    for _ in range(rounds):
        own = index.lists(sample)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        index.centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], index.centroids)
    # probes: how far down its list order a query must go to meet its true neighbours within the sample
    queries = random.choice(n, min(SAMPLE_QUERIES, n), replace=False)
    product = sample[queries] @ sample.T
    product[np.arange(len(queries)), queries] = -np.inf
    near = np.argsort(-product, axis=1, kind="stable")[:, :min(k, max(n - 1, 1))]
    order = np.argsort(-(sample[queries] @ index.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    depth = np.take_along_axis(place, index.lists(sample)[near], axis=1)
    index.probes = int(min(lists, np.quantile(depth, PROBED_SHARE) + 1))
    return index


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component, so equal vectors have equal products."""
    total = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        total += vectors[:, d] * query[:, d]
    return total


def scan(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, rotation: np.ndarray,
         k: int, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, id, score`` of the ``k`` best vectors of a block for each query row, ties to the smaller id."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    vectors, ids = vectors[order], ids[order]
    # equal vectors are looked at once; at most k + 1 of their ids, the smallest, can matter
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [len(ids)]]))
    distinct = vectors[begin]
    dimension = vectors.shape[1]
    x, q = distinct @ rotation, queries @ rotation
    x_norm, q_norm = np.sqrt((x ** 2).sum(axis=1)), np.sqrt((q ** 2).sum(axis=1))
    pool_q, pool_x, pool_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    worst = np.full(len(q), -np.inf)
    first, width = 0, 512
    while first < len(x):
        last = min(first + width, len(x))
        part = np.zeros((len(q), last - first))
        alive_q = alive_x = None
        for column in range(0, dimension, COLUMNS):
            stop = min(column + COLUMNS, dimension)
            if alive_q is None:
                part += q[:, column:stop] @ x[first:last, column:stop].T
            else:
                value = value + np.einsum("ij,ij->i", q[alive_q, column:stop], x[first + alive_x, column:stop])
            if stop == dimension or first == 0:
                continue
            # a neighbour with product t has about t * stop / dimension of it here, give or take this deviation
            spread = sqrt(stop * (dimension - stop) / (dimension ** 2 * (dimension + 2)))
            if alive_q is None:
                bound = (worst * stop / dimension)[:, None] - deviations * spread * q_norm[:, None] * x_norm[None, first:last]
                keep = part >= bound
                if keep.mean() < 0.3:
                    alive_q, alive_x = np.nonzero(keep)
                    value = part[alive_q, alive_x]
            else:
                keep = value >= worst[alive_q] * stop / dimension - deviations * spread * q_norm[alive_q] * x_norm[first + alive_x]
                alive_q, alive_x, value = alive_q[keep], alive_x[keep], value[keep]
        if alive_q is None:
            alive_q, alive_x = np.nonzero(part >= (worst - TIE)[:, None])
            value = part[alive_q, alive_x]
        else:
            keep = value >= worst[alive_q] - TIE
            alive_q, alive_x, value = alive_q[keep], alive_x[keep], value[keep]
        pool_q, pool_x, pool_s = (np.concatenate(p) for p in ((pool_q, alive_q), (pool_x, alive_x + first), (pool_s, value)))
        order = np.lexsort((-pool_s, pool_q))
        pool_q, pool_x, pool_s = pool_q[order], pool_x[order], pool_s[order]
        start = np.searchsorted(pool_q, np.arange(len(q) + 1))
        full = np.flatnonzero(np.diff(start) >= k + 1)
        # one more than k, for the query's own vector may be among them
        worst[full] = pool_s[start[full] + k]
        keep = pool_s >= worst[pool_q] - TIE
        pool_q, pool_x, pool_s = pool_q[keep], pool_x[keep], pool_s[keep]
        first, width = last, 1024
    score = exact(queries[pool_q], distinct[pool_x])
    copies = np.minimum(size[pool_x], k + 1)
    row = np.repeat(np.arange(len(pool_q)), copies)
    member = ids[np.repeat(begin[pool_x], copies) + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)]
    out_q, out_s = pool_q[row], score[row]
    other = member != query_ids[out_q]
    out_q, member, out_s = out_q[other], member[other], out_s[other]
    order = np.lexsort((member, -out_s, out_q))
    out_q, member, out_s = out_q[order], member[order], out_s[order]
    start = np.searchsorted(out_q, np.arange(len(q) + 1))
    keep = np.arange(len(out_q)) - start[out_q] < k
    return out_q[keep], member[keep], out_s[keep]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, asks`` of the rows that take part: an id, no null or non-finite component, not all zero.

    Vectors of another length than the most frequent one (the smallest of several) take no part either.
    """
    def bad(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "asks").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.where(F.size("embedding") == (lengths["length"] if lengths else 0))


def dealt(listed: DataFrame, lookups: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries with the ``block`` and ``strip`` of their lists that they meet in (``list, blocks, strips``)."""
    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    data = listed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("strip", each("strips"))
    asked = lookups.join(sizes, "list").withColumn("strip", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("strips")).cast("int")).withColumn("block", each("blocks"))
    return data.drop("blocks", "strips"), asked.drop("blocks", "strips")


def nearest(vectors: DataFrame, is_query, k: int = 20, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK, queries_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors found with the largest inner products for each query.

    ``is_query`` is a condition on the rows of ``vectors`` (``vec_id, embedding``). A row is no neighbour of a query with its
    id; equal products go to the smaller id; a query with fewer than ``k`` candidates gets all of them. Rows that
    repeat an id are candidates each; repeated queries are asked once, queries with one id and different vectors each.
    A table without usable vectors gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors.withColumn("asks", F.coalesce(is_query, F.lit(False)))), "vectors")
    asked = rows.where("asks").select("vec_id", "embedding").dropDuplicates()
    rows = rows.select("vec_id", "embedding")
    total = rows.count()
    if not total or asked.isEmpty():
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample_rows).toPandas()
    index = fit(np.stack(sample["embedding"].to_list()), min(MOST_LISTS, round(sqrt(total) / 4)), k)
    shared = spark.sparkContext.broadcast(index)  # bounded by the number of lists and the dimension

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                data = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.lists(data))], names=["vec_id", "embedding", "list"])

    listed = rows.mapInArrow(assign, "vec_id long, embedding array<double>, list int")
    # at most MOST_LISTS rows of counts
    counts = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    held = np.array([counts.get(name, 0) for name in range(len(index.centroids))], dtype=np.int64)

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                data = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                # rows with the query's own id are no neighbours
                line, lists = shared.value.probed(data, held, k + batch.column("own").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(line)) for c in ("vec_id", "embedding")), pa.array(lists)],
                                                 names=["vec_id", "embedding", "list"])

    repeated = rows.groupBy("vec_id").agg(F.count("*").alias("own")).where("own > 1")
    asked = asked.join(repeated, "vec_id", "left").select("vec_id", "embedding", F.coalesce("own", F.lit(1)).alias("own"))
    lookups = asked.mapInArrow(probe, "vec_id long, embedding array<double>, list int")
    # a list's vectors are copied for each strip of the queries that probe it, these for each block of its vectors
    probing = {r["list"]: r["count"] for r in lookups.groupBy("list").count().collect()}
    sizes = F.broadcast(spark.createDataFrame([(name, ceil(n / block), ceil(probing[name] / queries_block)) for name, n in counts.items() if name in probing],
                                              "list int, blocks int, strips int"))
    data, lookups = dealt(listed, lookups, sizes)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vector": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="float64")})
        right = right.reset_index(drop=True)
        row, member, score = scan(np.stack(left["embedding"].to_list()), left["vec_id"].to_numpy(), np.stack(right["embedding"].to_list()),
                                  right["vec_id"].to_numpy(), shared.value.rotation, k)
        return pd.DataFrame({"query_id": right["vec_id"].to_numpy()[row], "vector": right["vector"].to_numpy()[row], "vec_id": member, "score": score})

    keys = ["list", "block", "strip"]
    found = data.groupBy(*keys).cogroup(lookups.withColumn("vector", F.xxhash64("embedding")).groupBy(*keys)).applyInPandas(
        meet, "query_id long, vector long, vec_id long, score double")
    best = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
