"""Blob shards: numbered directories with ``data.bin`` and ``offsets.npy``."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions.columns import hex_number, int_div, label_from_path
from samplewright.operators.lookup import shard_ranges
from samplewright.session import broadcast_if_small
from samplewright.sources.ranges import read_ranges


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``shard_id, local_idx, sample_idx, path, start, end, length`` of every record.

    Directories whose name is not a number are ignored.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "offsets.npy").load(root).select("path", "content")
    )
    shards = files.withColumn("shard", label_from_path("path")).where(F.col("shard").rlike("^[0-9]+$"))
    shards = shards.select(
        F.col("shard").cast("int").alias("shard_id"),
        F.regexp_replace("path", "offsets\\.npy$", "data.bin").alias("path"), "content",
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, path, content in frame.itertuples(index=False):
                offsets = np.load(io.BytesIO(content)).reshape(-1, 2)
                yield pd.DataFrame({
                    "shard_id": np.full(len(offsets), shard, dtype=np.int32),
                    "local_idx": np.arange(len(offsets), dtype=np.int64),
                    "path": path, "start": offsets[:, 0], "end": offsets[:, 1],
                })

    records = shards.mapInPandas(run, "shard_id int, local_idx bigint, path string, start bigint, end bigint")
    # Record counts from the index headers: 10 bytes, the header text, 16 bytes per record.
    header = hex_number(F.hex(F.substring("content", 9, 1)), 1, 2) + 256 * hex_number(F.hex(F.substring("content", 10, 1)), 1, 2)
    counts = shards.select("shard_id", int_div(F.octet_length("content") - 10 - header, 16).alias("n"))
    firsts = broadcast_if_small(shard_ranges(counts).select("shard_id", "first_idx"))
    return records.join(firsts, "shard_id").select(
        "shard_id", "local_idx", (F.col("first_idx") + F.col("local_idx")).alias("sample_idx"),
        "path", "start", "end", (F.col("end") - F.col("start")).alias("length"),
    )


def read_shards(manifest: DataFrame, total_bytes: int | None = None) -> DataFrame:
    """Add the ``payload`` of each manifest row (any subset of the records)."""
    return read_ranges(manifest, total_bytes=total_bytes)


def read_all_shards(spark: SparkSession, root: str) -> DataFrame:
    """Every record with its payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "data.bin").load(root)
    total = files.agg(F.sum("length")).first()[0] or 0
    return read_shards(read_manifest(spark, root), total)
