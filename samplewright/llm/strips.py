"""Whole-number vectors, and a stated set of query vectors against all rows of a table in strips.

A strip is a bounded run of query vectors. It is broadcast, every task passes its own rows by it once, and what the tasks
find is small, so no vector is shuffled or copied. Its result is written before the next strip begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import written

# Bytes of the query vectors of one strip, as doubles.
STRIP_BYTES = 16 << 20
# Rows and queries of one tile of scores.
TILE_ROWS = 2048
TILE_QUERIES = 1024
# Scores are exact below this bound; beyond it the operators raise.
EXACT = 1 << 50


def usable(vectors: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """``vec_id, embedding`` (doubles) and extra columns of rows with an id and a vector whose components are all finite."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          *[column.alias(name) for name, column in (extra or {}).items()])
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))


def matrix(column: pa.Array, scale: float, width: int | None = None) -> np.ndarray:
    """``floor(scale * x)`` of the components, one row a vector; shorter vectors are followed by zeros.

    ``width`` cuts longer vectors off: what lies beyond a strip's longest query meets zeros only.
    """
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), width))
    inside = place < width
    out[row[inside], place[inside]] = values[inside]
    return out


class Strip:
    """Query vectors of one strip, ordered by id, with columns that go with them."""

    def __init__(self, rows: pa.Table, scale: float):
        rows = rows.combine_chunks().sort_by("vec_id")
        self.scale = scale
        self.ids = rows["vec_id"].to_numpy()
        column = rows["embedding"]
        self.vectors = matrix(column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float64())), scale)
        self.columns = {name: rows[name].to_numpy() for name in rows.column_names if name not in ("vec_id", "embedding")}
        self.reach = np.abs(self.vectors).sum(axis=1).max(initial=0.0)

    def __len__(self) -> int:
        return len(self.ids)

    def tiles(self, batches: Iterator[pa.RecordBatch], slices: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, slice, list[np.ndarray], int]]:
        """``rows, ids, queries, partial scores by column slice, bound`` of every tile of a task's rows, rows ordered by id.

        No partial score is beyond the bound; a row and the query of its own id have one below ``-bound`` in every slice.
        Whole numbers below 2^24 are exact in single precision, those below 2^53 in double.
        """
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column("vec_id").to_numpy(), kind="stable")))
            for first in range(0, batch.num_rows, TILE_ROWS):
                rows = batch.slice(first, TILE_ROWS)
                ids = rows.column("vec_id").to_numpy()
                x = matrix(rows.column("embedding"), self.scale, self.vectors.shape[1])
                bound = float(np.abs(x).max(initial=0.0) * self.reach)
                if bound >= EXACT:
                    raise ValueError("components are too large for exact scores")
                kind = np.float32 if bound < 1 << 24 else np.float64
                x = x.astype(kind)
                for start in range(0, len(self), TILE_QUERIES):
                    queries = slice(start, min(start + TILE_QUERIES, len(self)))
                    q = self.vectors[queries].astype(kind)
                    parts = [x[:, columns] @ q[:, columns].T for columns in cut(q.shape[1], slices)]
                    begin, end = (np.searchsorted(self.ids[queries], ids, side) for side in ("left", "right"))
                    own = np.repeat(np.arange(len(ids)), end - begin)
                    mine = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange(len(own))
                    for part in parts:
                        part[own, mine] = -bound - 1
                    yield rows, ids, queries, parts, int(bound)


def cut(width: int, slices: int) -> list[slice]:
    """Column slices of nearly equal width; at least one, empty for vectors without components."""
    slices = max(1, min(slices, width))
    border = [width * i // slices for i in range(slices + 1)]
    return [slice(a, b) for a, b in zip(border[:-1], border[1:])]


def leading(values: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest values of each column that reach the column's ``least``; ties to the smaller row."""
    mask = values >= least
    crowded = np.flatnonzero(mask.sum(axis=0) > k)
    if len(crowded):
        n = len(values)
        # distinct whole numbers in the wanted order
        key = values[:, crowded].astype(np.int64) * n - np.arange(n)[:, None]
        mask[:, crowded] &= key >= np.partition(key, n - k, axis=0)[n - k]
    return np.nonzero(mask)


class Best:
    """The ``k`` best entries of each of ``n`` lists so far: largest score, ties to the smaller id. Further values go along."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.owner, self.score, self.id, self.value = (np.zeros(0, np.int64) for _ in range(4))
        # what a further entry must reach to matter
        self.least = np.full(n, -float(EXACT))

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray, value: np.ndarray | None = None) -> None:
        if not len(owner):
            return
        value = score if value is None else value
        owner, score, ids, value = (np.concatenate([held, np.asarray(new).astype(np.int64)]) for held, new in (
            (self.owner, owner), (self.score, score), (self.id, ids), (self.value, value)))
        order = np.lexsort((ids, -score, owner))
        begin = np.searchsorted(owner[order], np.arange(self.n + 1))
        order = order[np.arange(len(order)) - begin[owner[order]] < self.k]
        self.owner, self.score, self.id, self.value = owner[order], score[order], ids[order], value[order]
        begin = np.searchsorted(self.owner, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(begin) == self.k)
        self.least[full] = self.score[begin[full + 1] - 1]


def strips(queries: DataFrame, scale: float) -> Iterator[tuple[int, Strip, Broadcast]]:
    """The queries (``vec_id, embedding`` and further columns) strip by strip, each broadcast while it is worked on.

    Different queries are dealt by hash, so strips are about equally large; only one is on the driver at a time.
    """
    spark = queries.sparkSession
    queries = written(queries, "queries")
    size = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    number = max(1, -(-size[0] * 8 * max(size[1], 1) // STRIP_BYTES)) if size[0] else 0
    for i in range(number):
        strip = Strip(queries.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(number)) == i).toArrow(), scale)
        if len(strip):
            shared = spark.sparkContext.broadcast(strip)
            yield i, strip, shared
            shared.destroy()
