"""Image tables and index tables."""

from __future__ import annotations

import re
from itertools import accumulate
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from samplewright.functions.columns import hash_hex, hex_number
from samplewright.functions.fixed import DEFAULT_SEED
from samplewright.operators.lookup import fetch_by_index, locate_shard
from samplewright.session import broadcast_if_small

IMAGE_SCHEMA = "image binary, label string, filename string"


def with_sample_idx(table: DataFrame, out: str = "sample_idx", starts: DataFrame | None = None) -> DataFrame:
    """Add the 0-based storage position of every row of a Parquet table.

    The position inside a file comes from the reader. Several files follow one
    another in the order they were written (``write_order``); their row counts come
    from the footers alone, or ``starts`` has each file's first position (``_file, _start``).
    """
    if starts is None:
        counts = table.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy(*write_order("_file")).rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = table.select(*table.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    joined = placed.join(broadcast_if_small(starts), "_file")
    return joined.select(*table.columns, (F.col("_start") + F.col("_row")).alias(out))


class FileIndex:
    """The files of a Parquet table in write order, and the rows of as many of them as were asked for.

    Counts come from the footers; files whose counts are not needed are listed only. There is one entry per file, as in
    the listing that the driver holds of any table it reads.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None):
        self.spark, self.path = spark, path
        self.table = (spark.read.schema(schema) if schema else spark.read).parquet(path)
        self.files = sorted(self.table.inputFiles(), key=_write_key)
        self.rows: list[int] = []
        self.names: list[str] = []  # as the reader reports them

    def _of(self, files: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.table.schema)
        # a single file is no folder with partition columns
        if not re.search(r"[*?{\[]", self.path) and not all(_plain(file).endswith(_plain(self.path)) for file in self.files):
            reader = reader.option("basePath", self.path)
        # the listing has encoded URIs, the reader takes plain paths
        return reader.parquet(*map(unquote, files))

    def count(self, until: int | None = None) -> int:
        """Count the rows of the first files until there are ``until`` of them (all by default); how many files that took."""
        step = 64
        while len(self.rows) < len(self.files) and (until is None or sum(self.rows) < until):
            part = self.files[len(self.rows):len(self.rows) + step]
            counts = self._of(part).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
            found = {_plain(r.file): (r.file, r.n) for r in counts.collect()}
            for file in part:
                name, n = found.get(_plain(file), (file, 0))
                self.names.append(name)
                self.rows.append(n)
            step *= 4
        taken, total = 0, 0
        while taken < len(self.rows) and (until is None or total < until):
            total += self.rows[taken]
            taken += 1
        return taken

    def read(self, numbers: list[int], out: str = "sample_idx") -> DataFrame:
        """The rows of the files with these numbers, which are counted, with their positions; no other file is opened."""
        if not numbers:
            return self.table.limit(0).withColumn(out, F.lit(0).cast("bigint"))
        first = list(accumulate(self.rows, initial=0))
        starts = [(self.names[i], first[i]) for i in numbers]
        return with_sample_idx(self._of([self.files[i] for i in numbers]), out, self.spark.createDataFrame(starts, "_file string, _start bigint"))


def _plain(uri: str) -> str:
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(uri))


def _write_key(path: str) -> tuple[str, int, int, str]:
    """``write_order`` of one path."""
    part, counter = (re.search(pattern, path) for pattern in _NUMBERS)
    return path[:path.rindex("/") + 1], int(part[1]) if part else -1, int(counter[1]) if counter else -1, path


_NUMBERS = (r"/part-(\d+)[^/]*$", r"-c(\d+)\.[^/]*$")


def write_order(path: str) -> list[Column]:
    """Sort keys of written files: directory, part number, file counter of the task, then the path itself.

    Writers pad numbers to a fixed width and go on past it, so paths as text are not in write order. The counter stands
    right before the extension; the hexadecimal groups of the writer's identifier may look like one.
    """
    directory = F.regexp_replace(path, "[^/]*$", "")
    numbers = [F.regexp_extract(path, pattern, 1).try_cast("bigint") for pattern in _NUMBERS]
    return [directory, *[F.coalesce(n, F.lit(-1)) for n in numbers], F.col(path)]


def take_prefix(df: DataFrame, max_samples: int | None, idx: str = "sample_idx") -> DataFrame:
    """The first ``max_samples`` rows in storage order; ``None`` keeps all."""
    return df if max_samples is None else df.where(F.col(idx) < max_samples)


def read_parquet_table(spark: SparkSession, path: str, schema: str | None = None, max_samples: int | None = None) -> DataFrame:
    """A Parquet table (of a given schema) with ``sample_idx``; of a prefix only the files that hold it are opened."""
    if max_samples is None:
        return with_sample_idx((spark.read.schema(schema) if schema else spark.read).parquet(path))
    index = FileIndex(spark, path, schema)
    return take_prefix(index.read(list(range(index.count(max_samples)))), max_samples)


def fetch_rows(spark: SparkSession, path: str, index_df: DataFrame, idx: str = "sample_idx", schema: str | None = None,
               columns: list[str] | None = None, on_missing: str = "error") -> DataFrame:
    """Rows of a Parquet table at the positions of ``index_df``, see ``lookup.fetch_by_index``; only files with hits are opened."""
    index = FileIndex(spark, path, schema)
    index.count()
    counts = spark.createDataFrame(list(enumerate(index.rows)), "shard_id int, n bigint")
    hit = locate_shard(index_df.select(idx).where(F.col(idx).between(0, sum(index.rows) - 1)).distinct(), counts, idx, on_missing="drop")
    files = sorted(r.shard_id for r in hit.select("shard_id").distinct().collect())  # one row per file
    rows = index.read(files, idx)
    return fetch_by_index(rows.select(idx, *(columns or index.table.columns)), index_df, idx, on_missing)


def read_image_table(spark: SparkSession, path: str, max_samples: int | None = None,
                     schema: str = IMAGE_SCHEMA) -> DataFrame:
    """``sample_idx, image, label`` (and the other columns of ``schema``)."""
    return read_parquet_table(spark, path, schema, max_samples)


def random_indices(spark: SparkSession, k: int, n: int, seed: int = DEFAULT_SEED, out: str = "sample_idx") -> DataFrame:
    """``draw, sample_idx``: ``k`` draws with replacement from ``0..n-1``, fixed by ``seed``."""
    draws = spark.range(k).withColumnRenamed("id", "draw")
    return draws.withColumn(out, hex_number(hash_hex(seed, F.col("draw")), 1, 15) % F.lit(n).cast("bigint"))


def cyclic_indices(spark: SparkSession, m: int, w: int, out: str = "sample_idx") -> DataFrame:
    """``op, sample_idx``: operation ``i`` of ``m`` uses item ``i mod w``."""
    return spark.range(m).select(F.col("id").alias("op"), (F.col("id") % w).alias(out))
